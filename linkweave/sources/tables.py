"""Readers and writers: tab-separated entity tables, ground truth, results, splits and the scoreboard.

Fields are never quoted, and empty ones are empty strings: Spark reads those as null, so each reader fills them.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
MATCH_HEADER = ("source1_entity_id", "matched_entity_ids")
CANDIDATE_HEADER = ("source1_entity_id", "candidate_entity_ids")
SCOREBOARD_SCHEMA = T.StructType(
    [T.StructField("experiment_id", T.StringType()), T.StructField("timestamp", T.StringType()), T.StructField("description", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("candidate_recall", "precision", "recall", "macro_f05", "singleton_accuracy")]
    + [T.StructField("false_merges", T.LongType()), T.StructField("avg_predicted_matches", T.DoubleType())]
    + [T.StructField(c, T.LongType()) for c in ("max_predicted_matches", "candidate_count")]
    + [T.StructField(c, T.DoubleType()) for c in ("p50_candidates", "p95_candidates", "runtime_s", "peak_ram_mb")]
    + [T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]
)
#: What a writer leaves when all its files are there.
SUCCESS = "_SUCCESS"
#: Digits after the point that the scoreboard keeps.
SCOREBOARD_DIGITS = {
    "candidate_recall": 4, "precision": 4, "recall": 4, "macro_f05": 4, "singleton_accuracy": 4,
    "avg_predicted_matches": 2, "p50_candidates": 1, "p95_candidates": 1, "runtime_s": 2, "peak_ram_mb": 1,
}


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    df = spark.read.schema(schema).csv(path, sep="\t", header=True, quote="", escape="")
    return df.select(*[F.coalesce(F.col(f.name), F.lit("")).alias(f.name) for f in schema.fields])


def read_source(spark: SparkSession, path: str, source: str) -> DataFrame:
    if source not in ("1", "2", "3"):
        raise ValueError(f"no source {source}")
    return read_tsv(spark, path, ENTITY_SCHEMA)


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """One row an id. Which of several stays is fixed by their values, not by the order of the file."""
    df = read_tsv(spark, path, ENTITY_SCHEMA)
    rest = [c for c in df.columns if c != "entity_id"]
    return df.groupBy("entity_id").agg(F.max(F.struct(*rest)).alias("r")).select("entity_id", "r.*")


def id_list(c: Column, empty_words: bool = False) -> Column:
    """A comma list as trimmed, non-empty ids. empty_words: a field of `nan` or `none` is empty too."""
    ids = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    if empty_words:
        return F.when(F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("", "nan", "none"), F.array().cast("array<string>")).otherwise(ids)
    return ids


def read_truth(spark: SparkSession, path: str, empty_words: bool = False) -> DataFrame:
    """s1_id, ids."""
    df = read_tsv(spark, path, TRUTH_SCHEMA)
    return df.select(F.col("source1_entity_id").alias("s1_id"), id_list(F.col("matched_entity_ids"), empty_words).alias("ids"))


def truth_links(truth: DataFrame) -> DataFrame:
    return truth.select("s1_id", F.explode("ids").alias("tid"))


def with_ids(df: DataFrame, ids: DataFrame, column: str = "entity_id") -> DataFrame:
    """The rows whose id is listed, by a semi-join; the planner broadcasts the list if its size allows."""
    return df.join(ids.select(column).distinct(), column, "left_semi")


def head(df: DataFrame, n: int, column: str = "entity_id") -> DataFrame:
    return df.orderBy(column).limit(n)


def result_rows(heads: DataFrame, pairs: DataFrame, header: tuple[str, str] = MATCH_HEADER) -> DataFrame:
    """One row each query entity, its ids comma-joined in order of rank, those without any included. heads: s1_id; pairs: s1_id, cand_id, rank."""
    first = pairs.groupBy("s1_id", "cand_id").agg(F.min("rank").alias("rank"))
    lists = first.groupBy("s1_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cand_id"))), lambda x: x["cand_id"]), ",").alias("ids"))
    return heads.select("s1_id").join(lists, "s1_id", "left").select(F.col("s1_id").alias(header[0]), F.coalesce("ids", F.lit("")).alias(header[1]))


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, sep="\t", header=True, quote="", escape="", emptyValue="", nullValue="")


def normalize_files(spark: SparkSession, path: str, out: str, normalize: Callable[[DataFrame], DataFrame]) -> None:
    """A table normalized file by file, written as Parquet."""
    normalize(read_tsv(spark, path, ENTITY_SCHEMA)).write.mode("overwrite").parquet(out)


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at path, made first if there is none. One whose writing broke off has no mark of success and is made anew."""
    if SUCCESS not in _files(spark, path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def log_experiment(spark: SparkSession, path: str, **values: object) -> None:
    """Appends one row to the scoreboard, rounded as its columns say. timestamp: now, if not given; values that have no column go to metadata, as text."""
    columns = [f.name for f in SCOREBOARD_SCHEMA.fields[:-1]]
    row = {c: values.get(c) for c in columns}
    row |= {k: round(float(row[k]), n) for k, n in SCOREBOARD_DIGITS.items() if row[k] is not None}
    row["timestamp"] = row["timestamp"] or time.strftime("%Y-%m-%d %H:%M:%S")
    row["metadata"] = {k: str(v) for k, v in values.items() if k not in columns}
    spark.createDataFrame([row], SCOREBOARD_SCHEMA).write.mode("append").parquet(path)


def scoreboard(spark: SparkSession, path: str) -> DataFrame:
    """The scoreboard, or an empty one with its columns."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(SCOREBOARD_SCHEMA).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], SCOREBOARD_SCHEMA)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, n_bytes, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def log_run(spark: SparkSession, path: str, experiment: str, **result: object) -> None:
    """Appends one run to a registry of lines of JSON."""
    line = json.dumps(result | {"experiment": experiment, "timestamp": time.strftime("%Y-%m-%dT%H:%M:%S")}, default=str)
    spark.createDataFrame([(line,)], "value string").write.mode("append").text(path)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """experiment, timestamp, result (by name, as text) of a registry; lines that aren't JSON are passed over, and without a registry there are none."""
    from pyspark.errors import AnalysisException

    try:
        lines = spark.read.text(path)
    except AnalysisException:
        lines = spark.createDataFrame([], "value string")
    found = lines.select(F.from_json("value", "map<string,string>").alias("result")).where(F.col("result")["experiment"].isNotNull())
    own = F.map_filter("result", lambda k, _: ~k.isin("experiment", "timestamp"))
    return found.select(F.col("result")["experiment"].alias("experiment"), F.col("result")["timestamp"].alias("timestamp"), own.alias("result"))


def write_report(rows: DataFrame, path: str, title: str) -> None:
    """A small table as a file of comma-separated values and as lines of text, a paragraph a row. rows: a report, so few."""
    names = rows.columns
    text = F.concat_ws("\n", *[F.concat(F.lit(f"  {c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in names], F.lit(""))
    rows.coalesce(1).write.mode("overwrite").csv(f"{path}/table", header=True)
    head = rows.sparkSession.createDataFrame([(f"{title}\n{'=' * len(title)}\n",)], "value string")
    head.unionByName(rows.select(text.alias("value"))).coalesce(1).write.mode("overwrite").text(f"{path}/summary")


def save_split(split: DataFrame, links: DataFrame, path: str) -> None:
    """A split as tables: ids with bucket and split, the links of each part, and a row of figures. split: s1_id, bucket, split; links: s1_id, tid."""
    split.write.mode("overwrite").parquet(f"{path}/ids")
    ids = split.sparkSession.read.parquet(f"{path}/ids")
    lists = links.groupBy("s1_id").agg(F.array_sort(F.collect_set("tid")).alias("ids"))
    ids.select("s1_id", "split").join(lists, "s1_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>"))).write.mode("overwrite").partitionBy("split").parquet(f"{path}/truth")
    from linkweave.operators.split import metadata

    metadata(ids, links).withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def read_split(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/ids")


def get_or_make_split(spark: SparkSession, path: str, heads: DataFrame, links: DataFrame, fraction: float = 0.15, seed: int = 42) -> DataFrame:
    """The split stored at path; if there is none, the stratified one is made and stored first."""
    from pyspark.errors import AnalysisException

    from linkweave.operators.split import stratified

    try:
        return read_split(spark, path)
    except AnalysisException:
        save_split(stratified(heads, links, fraction, seed), links, path)
        return read_split(spark, path)


def _files(spark: SparkSession, path: str) -> dict[str, int]:
    """Sizes of the files under path by name from there; none if there is no such folder."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return {}
    base, found, out = fs.makeQualified(top).toUri().getPath(), fs.listFiles(top, True), {}
    while found.hasNext():
        f = found.next()
        out[f.getPath().toUri().getPath()[len(base) :].lstrip("/")] = f.getLen()
    return out


def status(spark: SparkSession, path: str) -> tuple[int, int]:
    """How many files stand under path, and their bytes."""
    sizes = _files(spark, path)
    return len(sizes), sum(sizes.values())


def sync(spark: SparkSession, source: str, target: str) -> list[str]:
    """Copies the files under source to target, but those that are there with the same size, and names those copied. For reports, models and the like."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf, there, copied = spark._jsc.hadoopConfiguration(), _files(spark, target), []
    for name, size in sorted(_files(spark, source).items()):
        if size == 0 or there.get(name) != size:
            a, b = fs.Path(f"{source}/{name}"), fs.Path(f"{target}/{name}")
            fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)
            copied.append(name)
    return copied


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir; if that is unset, in the warehouse, on one machine only."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{top or spark.conf.get('spark.sql.warehouse.dir') + '/shared_checkpoints'}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: computed once, however many read it, and safe when executors are lost."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
