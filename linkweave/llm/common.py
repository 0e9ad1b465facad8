"""What every operator here needs: scans, the shared folder, and Arrow batches of documents."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed, carriage return: what parts words.
SPACE_CHARS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows and bytes in an Arrow batch; the bytes bound a batch of long texts, but for a single text that is longer.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: A key is hot if it holds more than one in so many rows; there are fewer hot keys than this, whatever the input.
HOT_SHARE = 1000
#: What passing_tables() watches now.
_made: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A table of the data folder; any path that Spark's readers open."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; if that is unset, one in the warehouse, on one machine only."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return where or f"{spark.conf.get('spark.sql.warehouse.dir')}/shared_checkpoints"


def materialize(df: DataFrame, tag: str, folder: str = "") -> DataFrame:
    """df as written Parquet in the shared folder, or one in it: computed once, and safe when executors are lost."""
    path = new_folder(df.sparkSession, tag, folder)
    df.write.parquet(path)
    for made in _made:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Removes the tables that materialize() writes within, but those taken out of the list it gives."""
    made: list[str] = []
    _made.append(made)
    try:
        yield made
    finally:
        _made.remove(made)
        for path in made:
            remove(spark, path)


def new_folder(spark: SparkSession, tag: str, folder: str = "") -> str:
    """A name for a folder of tables in the shared folder, or in one in it; remove() takes it away as a whole."""
    return f"{folder or shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches, never above what the session has. Plans read these settings when they run, so they can't be put back here."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(\d+)[bB]?", spark.conf.get(key))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def packed(df: DataFrame, name: str) -> Column:
    """All columns of df as one, under a name of ours: then no name in df can clash with others of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def unpacked(df: DataFrame, name: str, without: tuple[str, ...] = ()) -> list[Column]:
    """The columns that packed() put together, but for some."""
    return [F.col(name)[c].alias(c) for c in df.columns if c.lower() not in without]


def join_values(rows: DataFrame, values: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined to values, one row a key, with n, how many of rows have that key; total: how many rows there are, about.

    Hot keys, those of more than one in HOT_SHARE of all rows, are fewer than HOT_SHARE and so broadcast; their rows are dealt out by hash of all
    columns and never meet in one task. All other keys meet by shuffle. how: inner or left. Keys must not be null.
    """
    hot = F.col("n") > total / HOT_SHARE
    names = [c for c in values.columns if c not in (*keys, "n")]
    few = values.where(hot).select(*keys, F.lit(True).alias("is_hot"), *[F.col(c).alias(f"hot_{c}") for c in names])
    # Fewer than HOT_SHARE rows.
    told = rows.join(F.broadcast(few), keys, "left").withColumn("deal", F.when(F.col("is_hot"), F.xxhash64(*rows.columns)).otherwise(0))
    rest = values.where(~hot).select(*keys, F.lit(0).cast("long").alias("deal"), F.lit(True).alias("is_met"), *[F.col(c).alias(f"met_{c}") for c in names])
    joined = told.join(rest, [*keys, "deal"], "left")
    if how == "inner":
        joined = joined.where("is_hot OR is_met")
    return joined.select(*rows.columns, *[F.when(F.col("is_hot"), F.col(f"hot_{c}")).otherwise(F.col(f"met_{c}")).alias(c) for c in names])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def space_words(c: Column) -> Column:
    """Runs of characters other than SPACE_CHARS; none for null."""
    spaced = F.translate(F.coalesce(c, F.lit("")), SPACE_CHARS, " " * len(SPACE_CHARS))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, as the variable of a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def id_hash(doc_id: Column) -> Column:
    """crc32 of the id as text, as the folds are drawn."""
    return F.crc32(doc_id.cast("string"))


def crc_of_id(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, setup: Callable | None = None) -> DataFrame:
    """fn over each Arrow batch; setup() runs once a task and its result is fn's second argument."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for b in batches:
            yield fn(b, state) if setup else fn(b)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(name).to_pylist()


def batch_of(schema: pa.Schema, *columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
