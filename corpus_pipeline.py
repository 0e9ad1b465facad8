"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes each result as Parquet in the shared folder and reads it again
as the next stage's documents. All but the last keep the columns of documents, and those only, whatever their names. An empty table gives an
empty table at each stage; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm import lines, packing, quality, simhash, toxicity
from linkweave.llm.common import materialize, packed, passing_tables, table, unpacked


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go. Null and empty texts fail; a bound itself passes; repeated rows are judged each alike."""
    judged = quality.judge(docs.select(packed(docs, "document"), "text"))
    return judged.where("kept").select(*unpacked(docs, "document"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. Learned from the labelled rows of the whole table. Null and empty texts stay; a score of 0.5 goes."""
    field = toxicity.fit(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.keep_clean(docs, field)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from all but the first document; n_chars follows the text. Null texts stay null; equal rows are treated alike."""
    cut = lines.dedup_lines(docs.select(packed(docs.drop("text"), "document"), "doc_id", "text"))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return cut.select(*[own.get(c, F.col("document")[c].alias(c)) for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id stays.

    Null and empty texts are one group. Rows that repeat an id are one document and stay or go together, if their texts are near; of others, those
    with an id that is the smallest of any of its groups stay. Rows without an id can't be told apart and all stay.
    """
    groups = simhash.near_duplicates(docs)
    stay = groups.where("doc_id = component_id").select(F.col("doc_id").alias("staying_id")).distinct()
    kept = docs.join(stay, docs["doc_id"] == stay["staying_id"], "left_semi")
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences. Null and empty texts are one piece of the end mark; repeated rows are each packed."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_dedup),
    ("best-fit packing", best_fit_packing),
]

#: A conditional random field and tokenization aren't SQL; tests hold each stage against a plain version of its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with passing_tables(spark) as made:
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        made.pop()
    return docs
