import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkweave.llm import common

SIZES = pa.schema([("n", pa.int64())])


@pytest.mark.parametrize("share", [1, 4, 1000])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_values_is_a_join(spark, monkeypatch, share, how):
    monkeypatch.setattr(common, "HOT_SHARE", share)
    rng = random.Random(share)
    rows = [(rng.choice([1, 1, 1, 2, rng.randint(3, 40)]), k % 37) for k in range(400)] + [(99, 1), (99, 1)]
    left = spark.createDataFrame(rows, "a long, x long")
    values = left.where("a <> 5 AND a < 30").groupBy("a").agg(F.sum("x").alias("v"), F.count("*").alias("n"))
    got = common.join_values(left, values, ["a"], len(rows), how)
    want = left.join(values.drop("n"), "a", how)
    assert got.columns == ["a", "x", "v"] and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert common.join_values(left.limit(0), values, ["a"], 0, how).count() == 0


def test_hot_rows_are_dealt_out(spark):
    left = spark.range(4000).select(F.lit(7).cast("long").alias("a"), F.col("id").alias("x"))
    values = left.groupBy("a").agg(F.max("x").alias("v"), F.count("*").alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r.n for r in common.join_values(left, values, ["a"], 4000).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 4000 and max(sizes) < 2000


def session(master, **conf):
    class Session:
        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

    Session.conf, Session.sparkContext.master = conf, master
    return Session


def test_shared_folder_is_never_one_machines_own_on_a_cluster():
    unset = {"spark.sql.warehouse.dir": "/w"}
    assert common.shared_dir(session("local[8]", **unset)) == "/w/shared_checkpoints"
    for master in ("local-cluster[3,2,1000]", "yarn", "spark://x:7077"):
        with pytest.raises(ValueError):
            common.shared_dir(session(master, **unset))
        assert common.shared_dir(session(master, **unset, **{"spark.checkpoint.dir": "hdfs://c"})) == "hdfs://c"


def test_passing_tables_go(spark):
    with common.passing_tables(spark) as made:
        gone = common.materialize(spark.range(3), "gone")
        kept = common.materialize(gone.select((F.col("id") + 1).alias("id")), "kept")
        made.pop()
    assert kept.count() == 3 and not common._made
    with pytest.raises(Exception, match="(?i)not exist|not found|not_found"):
        gone.count()


def test_batches_are_bounded_by_bytes(spark):
    common.small_batches(spark)
    sizes = common.map_batches(spark.createDataFrame([(k, "x" * 3_000_000) for k in range(24)], "k long, text string").coalesce(1), lambda b: common.batch_of(SIZES, [b.num_rows]), "n long")
    assert max(r.n for r in sizes.collect()) <= 8
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    common.small_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10"
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")



