"""Entity tables derived from documents, and their profiles: the input of the linkage queries.

An entity's name is tokens 1 to 6 of a document, its address tokens 7 to 14; rows are dealt to three sources by id. Tokens are ASCII by
construction, so their normalization needs no Python. Queries read entities for several sides of their joins, so the table, short rows cut
from whole texts, is kept in memory or on executors' disks until the cache is cleared; a lost part is cut again.
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions import text as T


#: Tokens of a document that an entity is made of.
TOKENS = 14
#: Entities of a folder by session: their plan is made and their files are listed once.
_entities: WeakKeyDictionary[SparkSession, dict[str, DataFrame]] = WeakKeyDictionary()


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _entities.setdefault(spark, {})
    if sf_dir not in made:
        made[sf_dir] = derived(spark, sf_dir)
    rows = made[sf_dir]
    return rows if rows.storageLevel.useMemory else rows.persist(StorageLevel.MEMORY_AND_DISK)


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    # Tokens after the last that a column takes are never cut from the text.
    start_of = F.regexp_extract(T.blank_if_null(F.col("text")), rf"^(?:[^A-Za-z0-9]*+[A-Za-z0-9]++){{0,{TOKENS}}}", 0)
    cut = docs.select("doc_id", "lang", F.regexp_extract_all(T.ascii_lower(start_of), F.lit("[a-z0-9]+"), 0).alias("k"))
    part = lambda start, n: F.array_join(F.slice("k", start, n), " ")
    return cut.select(
        F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        part(1, 6).alias("business_name"),
        part(7, 8).alias("business_address"),
        F.when(F.col("lang") == "en", "USA").otherwise(F.coalesce("lang", F.lit(""))).alias("country"),
        F.when(F.size("k") >= 12, part(5, 8)).otherwise("").alias("link_key"),
    )


def named(df: DataFrame, unicode: bool = False) -> DataFrame:
    """df with source, and normalized name, address and country."""
    return df.withColumns(
        {
            "src": F.substring("entity_id", 1, 2),
            "norm_name": T.normalize_name(F.col("business_name"), unicode),
            "norm_addr": T.normalize_address(F.col("business_address"), unicode),
            "norm_country": T.normalize_country(F.col("country")),
        }
    )


def profiles(df: DataFrame, legal: list[str] | None = None, digits: int = 3) -> DataFrame:
    """Stems, token lists and numbers of named entities; c is the normalized country."""
    out = df.withColumns({"c": F.col("norm_country"), "tokens": T.without_legal(F.col("norm_name"), legal or T.LEGAL_BASE), "nums": T.digit_words(F.col("norm_addr"), digits)})
    return out.withColumns(
        {
            "sorted_tokens": F.array_sort("tokens"),
            "stem_name": T.joined(F.col("tokens"), F.col("norm_name")),
            "sorted_stem": T.joined(F.array_sort("tokens"), F.col("norm_name")),
        }
    )


def wide_named(df: DataFrame, unicode: bool = True) -> DataFrame:
    """As named, with accents stripped and everything in lower case first."""
    plain = lambda c: F.lower(T.strip_accents(T.blank_if_null(F.col(c))) if unicode else T.blank_if_null(F.col(c)))
    return df.withColumns(
        {
            "src": F.substring("entity_id", 1, 2),
            "norm_name": T.normalize_name(plain("business_name"), unicode),
            "norm_addr": T.normalize_address(plain("business_address"), unicode),
            "norm_country": T.normalize_country(F.col("country")),
        }
    )


def base_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(named(entities(spark, sf_dir)))


def wide_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(wide_named(entities(spark, sf_dir), unicode=False), T.LEGAL_ALL, 2)


#: Legal forms for blocking without quotas on names.
LEGAL_OPEN = [t for t in T.LEGAL_BASE if t != "lp"]


def open_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(named(entities(spark, sf_dir)), LEGAL_OPEN)


def tokened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named entities with name and address tokens and numbers, as the token strategies read them."""
    return with_tokens(named(entities(spark, sf_dir)))


def with_tokens(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "name_toks": T.name_tokens(F.col("norm_name")),
            "addr_toks": T.address_tokens(F.col("norm_addr")),
            "addr_nums": T.numeric_tokens(F.col("norm_addr")),
        }
    )


def heads(df: DataFrame) -> DataFrame:
    """The reference source's rows."""
    return df.where(F.col("entity_id").startswith("S1-"))


def targets(df: DataFrame) -> DataFrame:
    return df.where(~F.col("entity_id").startswith("S1-"))


def links(df: DataFrame) -> DataFrame:
    """s1_id, tid: the true links of derived entities."""
    keyed = df.where("link_key <> ''").select("entity_id", "country", "link_key")
    a, b = heads(keyed).withColumnRenamed("entity_id", "s1_id"), targets(keyed).withColumnRenamed("entity_id", "tid")
    return a.join(b, ["country", "link_key"]).select("s1_id", "tid")


def totals(df: DataFrame) -> DataFrame:
    """n_s1, total_links, n_t in one row: query entities, true links, which are counted by key and never listed, and targets."""
    is_head = F.col("entity_id").startswith("S1-")
    both = df.groupBy("country", "link_key").agg(F.count_if(is_head).alias("a"), F.count_if(~is_head).alias("b"))
    linked = F.when((F.col("link_key") != "") & F.col("country").isNotNull(), F.col("a") * F.col("b")).otherwise(0)
    return both.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n_s1"), F.coalesce(F.sum(linked), F.lit(0)).alias("total_links"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_t"))
