"""Best-fit packing by minimum bin slack over the histogram of piece lengths.

Documents are tokenized once, cut, and written as small rows of piece lengths. For each bin, a bitset subset-sum over the lengths still
available, around the longest of them, finds the fullest feasible combination, which is removed; a combination is removed as often as
its lengths allow in one step, so the plan's size depends on the bin's capacity and not on the corpus. Pieces take places in the plan by
their rank among those of their length, from counts by salt, so a length that a third of all pieces share is no single task.

Null and empty texts are one piece of one token, the end mark. Ties between pieces of a length go by a hash of the id, the piece and its ids'
checksum; which of wholly equal pieces comes first makes no difference. Repeated ids are each packed, rows without an id too. Very long
texts are tokenized whole, in memory that grows with the text. An empty table gives an empty table. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkweave.llm.common import map_batches, materialize, small_batches, table

CAPACITY = 2048
END_ID = 0
#: Pieces of a length and salt, about.
RANK_GROUP = 200_000
LEAST_SALTS = 64
#: Characters whose classes the fast library's pattern surely tells as the file's does: tests go through all of them, alone and between others.
_OTHER = re.compile(r"[^\x00-ɏ‐-‧]")
#: Runs of white space that are too long for the fast library, which reads them by a stack.
_LONG_SPACE = re.compile(r"\s{10000}")


class Encoder:
    """Ids of texts by a tokenizers file, as its library gives them.

    Texts of Latin letters go through the same merges as ranks in another library, at four times the speed. That gives equal ids by
    construction: the same pattern parts the text and the same merges in the same order join its bytes. It doesn't hold, and the file's own
    library is asked, for texts with characters that the two might class otherwise, with a string of an added token, or with a very long run of white space.
    """

    def __init__(self, name: str = "byte_bpe_50k") -> None:
        import json

        import public_tokenizers
        import tiktoken

        self.name, self.file = name, public_tokenizers.path(f"{name}.json")
        with open(self.file, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f)["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.loaded = None

    @property
    def own(self):
        """The tokenizers file, loaded when a text first needs it, and left as it is."""
        if self.loaded is None:
            from tokenizers import Tokenizer

            self.loaded = Tokenizer.from_file(self.file)
        return self.loaded

    def __call__(self, text: str) -> np.ndarray:
        if _OTHER.search(text) or _LONG_SPACE.search(text) or self.added.search(text):
            return np.array(self.own.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


def encoder(name: str) -> Encoder:
    """The worker's encoder of this vocabulary: workers serve many tasks, and loading takes longer than a small task."""
    import sys

    kept = sys.__dict__.setdefault("_encoders", {})
    if name not in kept:
        kept[name] = Encoder(name)
    return kept[name]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of each piece of n tokens; only the first may be shorter than the capacity, if there are several."""
    pieces = -(-n // capacity)
    first = n - (pieces - 1) * capacity
    return [(0, first)] + [(first + k * capacity, capacity) for k in range(pieces - 1)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(b: pa.RecordBatch, encode: Encoder) -> pa.RecordBatch:
        rows = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
            rows += [(doc_id, k, start, n, zlib.crc32(ids[start : start + n].tobytes())) for k, (start, n) in enumerate(cut(len(ids), capacity))]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(schema)], schema=schema)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long", lambda: encoder(tokenizer))


def fullest(counts: dict[int, int], capacity: int) -> list[int]:
    """Lengths of one bin: the longest there is, and of the others those that leave the least slack. Bit s of a set: sum s can be made."""
    lengths = sorted((x for x, n in counts.items() if n), reverse=True)
    longest = lengths[0]
    room = capacity - longest
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for x in lengths:
        if x > room:
            continue
        left, chunk = min(counts[x] - (x == longest), room // x), 1
        while left > 0:  # by doubled chunks, so many equal pieces take few steps
            take = min(chunk, left)
            steps.append((x, take, reach))
            reach |= (reach << (x * take)) & mask
            left -= take
            chunk *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    out = [longest]
    for x, take, before in reversed(steps):
        if not before >> total & 1:
            out += [x] * take
            total -= x * take
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, rank past the last, pieces a bin, first bin, place in the bin of the first such piece)."""
    counts, ranks, runs, bins = dict(counts), dict.fromkeys(counts, 0), [], 0
    while any(counts.values()):
        combination = fullest(counts, capacity)
        times = {x: combination.count(x) for x in combination}
        again = min(counts[x] // n for x, n in times.items())
        at = 0
        for x, n in times.items():
            runs.append((x, ranks[x], ranks[x] + n * again, n, bins, at))
            ranks[x] += n * again
            counts[x] -= n * again
            at += x * n
        counts = {x: n for x, n in counts.items() if n}
        bins += again
    return runs


def ranked(made: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """made with rank among the pieces of its length, and the count of each length (at most as many as the capacity)."""
    counts = {r.length: r.n for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = max(LEAST_SALTS, -(-max(counts.values(), default=1) // RANK_GROUP))
    salted = made.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    by_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = by_salt.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    local = salted.withColumn("local", F.row_number().over(Window.partitionBy("length", "salt").orderBy(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "ids_crc32")))
    return local.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("local") - 1).drop("salt", "local", "before"), counts


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    made = materialize(pieces(docs, capacity, tokenizer), "pieces")
    placed, counts = ranked(made)
    by_length: dict[int, np.ndarray] = {}
    for run in plan(counts, capacity):
        by_length.setdefault(run[0], []).append(run[1:])
    by_length = {x: np.array(runs, dtype=np.int64) for x, runs in by_length.items()}
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            bins, at = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for x in np.unique(length):
                runs, here = by_length[int(x)], np.nonzero(length == x)[0]
                r = runs[np.searchsorted(runs[:, 0], rank[here], side="right") - 1]
                slot = rank[here] - r[:, 0]
                bins[here] = r[:, 3] + slot // r[:, 2]
                at[here] = r[:, 4] + slot % r[:, 2] * x
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(bins), pa.array(at)], names=[*names, "sequence_id", "offset"])

    small_batches(docs.sparkSession)
    return placed.select(*names, "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))
