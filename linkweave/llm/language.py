"""Language identification by error-correcting output codes over hashed n-grams.

Each language has a codeword; for each of its bits a binary classifier weighs hashed byte trigrams by their log odds between the languages
with that bit and those without, from counts over all learning rows. A text's margins are decoded by the loss to each codeword, weighted
by how well a bit parts the languages; the nearest codeword wins, and a near second flags the text as ambiguous.

Learning rows: those with a language whose crc32 of the id, as text, leaves another remainder than 2 by 4. Only text and lang are learned.
Null texts and texts without a letter get `und` and score 0; so does every text if there is nothing to learn from. Ties between codewords
go to the first language by name. Repeated rows count as often as they occur, a row without an id is neither learned from nor held out; each
row is judged by its own text. Very long texts are counted whole, in pieces of a megabyte. An empty table gives an empty table. Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm.common import id_hash, map_batches, small_batches, table

#: Hash buckets of n-grams, a power of 2.
BITS = 13
BUCKETS = 1 << BITS
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Bits of a codeword, if there are more languages than exhaustive codes suit.
CODE_BITS = 63
EXHAUSTIVE = 6
#: How much nearer than the second the first codeword must be, as a share of the second's loss.
CLEAR = 0.1


def ngram_counts(text: str) -> np.ndarray:
    """How often each bucket's byte trigrams occur in the lower-case text, parted by one space at either end."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), dtype=np.uint8)
    out = np.zeros(BUCKETS, dtype=np.int64)
    for k in range(0, max(len(raw) - 2, 0), 1 << 20):
        b = raw[k : k + (1 << 20) + 2].astype(np.uint32)
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        out += np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=BUCKETS)
    return out


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all partings of the languages if they are few, else seeded random ones."""
    if n <= EXHAUSTIVE:
        columns = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest] or [(1,) * n]
        return np.array(columns, dtype=np.int8).T
    rng = np.random.default_rng(20240 + n)
    best, distance = None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, CODE_BITS))
        apart = (CODE_BITS - code.astype(int) @ code.T) // 2 + np.eye(n, dtype=int) * CODE_BITS
        if apart.min() > distance and (np.abs(code.sum(axis=0)) < n).all():
            best, distance = code, apart.min()
    return best


class Model:
    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        self.languages = sorted(counts)
        if not self.languages:
            return
        totals = np.array([counts[x] for x in self.languages], dtype=np.float64)
        share = (totals + 0.5) / (totals + 0.5).sum(axis=1, keepdims=True)
        self.code = codewords(len(share)).astype(np.float64)
        ups, downs = ([share[self.code[:, k] == s].mean(axis=0) if (self.code[:, k] == s).any() else share.mean(axis=0) for k in range(self.code.shape[1])] for s in (1, -1))
        self.weights = np.log(np.array(ups) / np.array(downs)).T
        expected = (share @ self.weights) * self.code
        trust = np.maximum(expected.min(axis=0), 1e-6)
        self.trust = trust / trust.sum()
        self.scale = 4 / max(float(np.abs(expected).mean()), 1e-6)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        counts = ngram_counts(text)
        margins = (counts @ self.weights) / counts.sum() * self.scale
        loss = np.logaddexp(0, -self.code * margins) @ self.trust
        best = int(np.argmin(loss))
        odds = np.exp(-4 * (loss - loss[best]))
        second = np.partition(loss, 1)[1] if len(loss) > 1 else np.inf
        return self.languages[best], float(odds[best] / odds.sum()), bool(loss[best] > (1 - CLEAR) * second)


def fit(docs: DataFrame) -> Model:
    """Counts by language over all learning rows: sums of whole numbers, so the same however rows are dealt."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.pmod(id_hash(F.col("doc_id")), F.lit(FOLDS)) != HELD_OUT)).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0) + ngram_counts(text)
        for lang, n in sums.items():
            at = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], schema=schema)

    small_batches(docs.sparkSession)
    summed = learn.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for r in summed.collect():  # at most BUCKETS rows a language
        counts.setdefault(r.lang, np.zeros(BUCKETS))[r.bucket] = r.n
    return Model(counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [model.predict(t) for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *[pa.array([x[k] for x in found], type=schema[2 + k].type) for k in range(3)]], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.pmod(id_hash(F.col("doc_id")), F.lit(FOLDS)) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return identify(docs, fit(docs))
