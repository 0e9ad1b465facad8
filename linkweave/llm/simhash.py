"""SimHash near-duplicates: tiled exact comparison of fingerprints with numpy exclusive-or and bit counts.

Fingerprints are made once and their distinct values compared. A value's population counts in four lanes of 16 bits name its tile;
two values within the radius differ by at most the radius in the sum of their lane counts, so pairs of tiles beyond that are skipped and
all others compared in full. Tiles are cut into blocks of bounded size. A pair of blocks yields a spanning forest of its links, never
all pairs, and components are joined by alternating large and small stars over shuffles.

Null and empty texts have fingerprint 0 and link like any other. Repeated rows and equal texts have equal fingerprints and share a
component; rows of one id are fingerprinted each by its text, and rows without an id have a component by the ids of others, or null if there is
none. Fewer words than a shingle: the whole sequence is one shingle. A bit that exactly half the hashes set is 0. Of equal ids any is the
component's. A very long text is hashed in pieces, in memory that grows with its own words only. An empty table gives an empty table.
Other columns of the input are ignored, whatever their names.

Keys that may be hot, a fingerprint of very many rows and the centre of a star, are joined by join_values(); blocks of a large tile are
dealt out in groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm.common import join_values, map_batches, materialize, new_folder, remove, small_batches, table

SHINGLE = 3
RADIUS = 2
SEED = 42
LANES, LANE_BITS = 4, 16
#: Values in a block at most, about; a comparison then takes some 8 MB.
BLOCK = 1024
#: Blocks of a tile in a group, about. Groups meet other tiles' blocks one by one.
GROUP = 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = len(words)
    body = b" ".join(words)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(body, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends - [len(w) + 1 for w in words])[: n - shingle + 1].tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(body[a:b], SEED) for a, b in zip(starts, stops, strict=True)]
    return majority(np.array(hashes, dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes, counted in pieces of bounded size."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.nonzero(counts * 2 > len(hashes))[0].astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, a signed long with the fingerprint's bits."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], schema=schema)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def lane_counts(fp: Column) -> list[Column]:
    mask = F.lit((1 << LANE_BITS) - 1)
    return [F.bit_count(F.shiftrightunsigned(fp, LANE_BITS * k).bitwiseAND(mask)) for k in range(LANES)]


def offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of lane counts that add up to the radius at most, one of each pair of opposite ones."""
    zero = (0,) * LANES
    return [d for d in product(range(-radius, radius + 1), repeat=LANES) if sum(map(abs, d)) <= radius and d >= zero]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links i-j among n nodes: the nodes that aren't the least of their component, and those least ones."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        for at in (i, j, label[i], label[j]):
            np.minimum.at(new, at, least)
        new = new[new]
        if np.array_equal(new, label):
            moved = np.nonzero(label != np.arange(n))[0]
            return moved, label[moved]
        label = new


def links(fps: DataFrame, radius: int = RADIUS, folder: str = "") -> DataFrame:
    """u, v: links among the distinct values fp that make the same components as all pairs within the radius."""
    counts = lane_counts(F.col("fp"))
    base = LANE_BITS + 1 + 2 * radius
    code = lambda cs: sum((c * base ** (LANES - 1 - k) for k, c in enumerate(cs)), F.lit(0))
    tiled = fps.select("fp", code([c + radius for c in counts]).alias("tile"))
    # At most (LANE_BITS + 1) ** LANES rows, whatever the input.
    sizes = tiled.groupBy("tile").agg(F.count("*").alias("n"))
    blocks = (
        tiled.join(F.broadcast(sizes), "tile")
        .withColumn("block", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / BLOCK)).cast("int"))
        .groupBy("tile", "block")
        .agg(F.collect_list("fp").alias("fps"))
    )
    blocks = materialize(blocks, "simhash-blocks", folder)
    steps = [sum(d * base ** (LANES - 1 - k) for k, d in enumerate(off)) for off in offsets(radius)]
    groups = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("n") / BLOCK) / GROUP)).cast("int")
    near_sizes = sizes.select(F.col("tile").alias("near"), groups.alias("n_groups"))
    left = blocks.select("tile", F.col("block").alias("block_a"), F.col("fps").alias("a"), F.explode(F.array(*map(F.lit, steps))).alias("step"))
    # As small as sizes. Only tiles that exist are met, and each group of their blocks by itself.
    left = left.withColumn("near", F.col("tile") + F.col("step")).join(F.broadcast(near_sizes), "near")
    left = left.withColumn("near_group", F.explode(F.sequence(F.lit(0), F.col("n_groups") - 1)))
    right = blocks.join(F.broadcast(near_sizes), blocks.tile == near_sizes.near)
    right = right.select("near", F.pmod("block", "n_groups").alias("near_group"), F.col("block").alias("block_b"), F.col("fps").alias("b"))
    pairs = left.join(right, ["near", "near_group"]).where((F.col("step") != 0) | (F.col("block_a") <= F.col("block_b")))
    pairs = pairs.select("a", "b", ((F.col("step") == 0) & (F.col("block_a") == F.col("block_b"))).alias("same"))
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for k in range(batch.num_rows):
                a, b = (batch.column(c)[k].values.to_numpy().view(np.uint64) for c in ("a", "b"))
                if batch.column("same")[k].as_py():
                    i, j = np.nonzero(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= radius, 1))
                    nodes = a
                else:
                    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
                    j, nodes = j + len(a), np.concatenate([a, b])
                if len(i):
                    moved, to = forest(len(nodes), i, j)
                    us.append(nodes[moved])
                    vs.append(nodes[to])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], schema=out)

    small_batches(fps.sparkSession)
    return pairs.mapInArrow(compare, "u long, v long")


def components(edges: DataFrame, within: str = "") -> DataFrame:
    """node, root for every node of edges (u, v): the least node of its component. Alternates large and small stars until nothing changes.

    A round's tables, in the shared folder or one in it, are removed when the next round's are written.
    """
    spark = edges.sparkSession
    folder = new_folder(spark, "stars", within)
    stars = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars", folder)
    state = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sum")).first()
    now = state(stars)
    while True:
        again = new_folder(spark, "stars", within)
        # Large star: each node's greater neighbours go to its least neighbour or itself.
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = join_values(both, least, ["u"], 2 * now.n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star", again)
        # Small star: each node and its lesser neighbours go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_values(large, least, ["u"], now.n).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        after = materialize(small.select("e.u", "e.v").where("u != v").distinct(), "small-star", again)
        then = state(after)
        remove(spark, folder)
        stars, folder, changed, now = after, again, then != now, then
        if not changed:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links reach."""
    made = materialize(fingerprints(docs, shingle), "fingerprints")
    folder = new_folder(docs.sparkSession, "simhash")
    values = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "fingerprint-values", folder)
    roots = components(links(values.select("fp"), radius, folder), folder)
    rooted = values.join(roots, values.fp == roots.node, "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    total = values.agg(F.count("*").alias("values"), F.sum("n").alias("rows")).first()
    by_value = join_values(rooted.withColumnRenamed("n", "n_own"), least, ["root"], total["values"])
    by_value = materialize(by_value.select("fp", "component_id", F.col("n_own").alias("n")), "components")
    remove(docs.sparkSession, folder)
    return join_values(made, by_value, ["fp"], total["rows"] or 0).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
