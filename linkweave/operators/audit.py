"""Audits of sources, ground truth and shifts between sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source_audit(df: DataFrame) -> DataFrame:
    """One row a source: rows, missing values, ids, countries, and statistics of lengths, in one pass beside the id counts."""
    ids = df.groupBy("src", "entity_id").agg(F.count("*").alias("n")).groupBy("src").agg(F.count("*").alias("unique_ids"), F.count_if(F.col("n") > 1).alias("duplicate_ids"))
    stats = []
    for c, p in (("business_name", "name"), ("business_address", "address")):
        n = F.length(c)
        stats += [F.round(F.avg(n), 2).alias(f"{p}_mean"), F.round(F.stddev_pop(n), 2).alias(f"{p}_std"), F.min(n).cast("long").alias(f"{p}_min"), F.max(n).cast("long").alias(f"{p}_max")]
    main = df.groupBy("src").agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(F.coalesce(F.col(c), F.lit("")) == "").alias(f"missing_{p}") for c, p in (("business_name", "name"), ("business_address", "address"), ("country", "country"))],
        F.array_join(F.array_sort(F.collect_set("country")), ",").alias("countries"),
        *stats,
    )
    return main.join(ids, "src")


def truth_audit(heads: DataFrame, links: DataFrame, known: DataFrame) -> DataFrame:
    """Histogram of matches a query entity, and links whose ids are unknown or point to the reference source. known: entity_id."""
    n = heads.select("s1_id").join(links.groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    histogram = n.agg(
        *[F.count_if(F.col("n") == k).alias(f"with_{k}") for k in (0, 1, 2)], F.count_if(F.col("n") >= 3).alias("with_3_or_more"), F.max("n").alias("most"), F.sum("n").alias("n_links")
    )
    bad = links.join(known.select(F.col("entity_id").alias("tid")), "tid", "left_anti").agg(F.count("*").alias("unknown_targets"))
    own = links.agg(F.count_if(F.col("tid").startswith("S1-")).alias("own_source_targets"))
    # Three tables of one row.
    return histogram.join(bad, how="cross").join(own, how="cross")


def table_counts(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> DataFrame:
    """name, n: rows of each table; Parquet counts come from footers."""
    one = [spark.read.parquet(f"{sf_dir}/{t}.parquet").agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in names]
    out = one[0]
    for df in one[1:]:
        out = out.unionByName(df)
    return out


def country_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("country").agg(F.count("*").alias("n"))


def distribution_shift(df: DataFrame) -> DataFrame:
    """Rates and means that tell how sources differ: missing values, countries, lengths, marks, digits and colliding names."""
    name, address = F.col("business_name"), F.col("business_address")
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 5)
    tokens = lambda c: F.size(F.filter(F.split(c, " "), lambda w: w != ""))
    collisions = df.where("norm_name <> ''").groupBy("src", "norm_name").agg(F.count("*").alias("n")).groupBy("src").agg(F.round(1 - F.count("*") / F.sum("n"), 5).alias("name_collision_rate"))
    main = df.groupBy("src").agg(
        F.count("*").alias("n_rows"),
        rate(name == "").alias("missing_name_rate"),
        rate(address == "").alias("missing_address_rate"),
        *[F.round(100 * F.avg(F.when(F.col("norm_country") == c, 1.0).otherwise(0.0)), 2).alias(f"country_{c}_pct") for c in ("India", "US", "France")],
        F.round(F.avg(F.length(name)), 2).alias("mean_name_len"),
        F.round(F.avg(tokens(name)), 2).alias("mean_name_tokens"),
        F.round(F.avg(F.length(address)), 2).alias("mean_address_len"),
        F.round(F.avg(tokens(address)), 2).alias("mean_address_tokens"),
        rate(name.rlike(r"[^\x00-\x7F]")).alias("name_non_ascii_rate"),
        rate(address.rlike(r"[^\x00-\x7F]")).alias("address_non_ascii_rate"),
        rate(name.rlike(r"[!-/:-@\[-`{-~]")).alias("name_marks_rate"),
        rate(address.rlike("[0-9]")).alias("address_digits_rate"),
    )
    return main.join(collisions, "src", "left")
