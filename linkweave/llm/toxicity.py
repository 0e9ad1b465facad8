"""Toxic spans by a linear-chain conditional random field; forward-backward marginals give document scores and offsets.

Tokens are runs of letters. A token's features are its lower-case word and the word's beginnings of 3 to 10 letters, of which those count
that documents labelled toxic have significantly more often. Tokens of toxic documents with such a feature are the labelled toxic tokens; the
field's emissions and transitions are fitted by likelihood on windows around all tokens of the sample with such a feature and on plain ones. Learning is bounded: at most
TOXIC and CLEAN labelled documents, those with the least hash of the id, of the rows whose crc32 of the id as text is no multiple of 5. Of
near copies in that sample one is learned from, else the words of a much copied document would seem to tell.

Scoring reads whole texts. Long stretches of tokens without features are crossed by powers of one matrix, so forward and backward sums are
exact. The score is a logistic of the greatest marginal and the sum of those of tagged tokens, fitted on the same sample. Null and empty texts and those without such
tokens get the score of no evidence. Without labels of both kinds every score is 0. Repeated rows score alike, rows that share an id each by its text
(learning takes one of them), rows without an id too, which are not held out. A score of exactly 0.5 counts as toxic; features whose lead is equal go by their letters. Very long texts are
scored whole, in time that grows with their tokens. An empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm.common import id_hash, map_batches, table

FOLDS, HELD_OUT = 5, 0
#: Labelled documents that learning uses at most, by label.
TOXIC, CLEAN = 1500, 4500
#: Least documents of a feature, and least significance of its lead in toxic ones (log of a binomial tail, base e).
SUPPORT, SIGNIFICANCE = 5, 12.5
#: Least hashes of word triples by which near copies in the sample are told, each of another permutation.
SIGNS = 6
#: Features kept at most, the most significant first.
FEATURES = 4000
WINDOW = 3
#: Words whose evidence a task keeps.
KEPT = 100_000
TOKEN = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    w = word.lower()
    return [w + "$", *[w[:k] for k in range(3, min(len(w), 10) + 1)]]


def lead(toxic: int, clean: int, base: float) -> float:
    """How far the toxic share of a feature's documents is beyond the base share: their count times the relative entropy."""
    n = toxic + clean
    share = (toxic + 1e-9) / n
    if share <= base:
        return 0.0
    rest = (1 - share) * np.log(max(1 - share, 1e-12) / (1 - base)) if share < 1 else 0.0
    return n * (share * np.log(share / base) + rest)


class Field:
    """Two states, clean and toxic. emission[f] speaks for toxic; move[a, b] is the score of b after a."""

    def __init__(self, emission: dict[str, float], bias: float, move: np.ndarray, link: tuple[float, float, float]) -> None:
        self.emission, self.bias, self.move, self.link = emission, bias, move, link
        self.seen: dict[str, float | None] = {}
        plain = np.exp(move - move.max()) * np.array([1.0, np.exp(bias)])
        self.plain = plain / plain.max()

    def evidence(self, word: str) -> float | None:
        """The score for toxic of a token, or None if it has no feature."""
        if word in self.seen:
            return self.seen[word]
        if len(self.seen) >= KEPT:
            self.seen.clear()
        found = [self.emission[f] for f in features_of(word) if f in self.emission]
        self.seen[word] = out = self.bias + sum(found) if found else None
        return out

    def crossing(self, n: int) -> np.ndarray:
        """The matrix of n plain tokens, scaled."""
        out, power = np.eye(2), self.plain
        while n:
            if n & 1:
                out = out @ power
                out /= out.max()
            power = power @ power
            power /= power.max()
            n >>= 1
        return out

    def marginals(self, at: list[int], evidence: list[float], n: int) -> list[float]:
        """Probability of toxic for the tokens with features, at these places among n tokens."""
        step = np.exp(self.move - self.move.max())
        into = [self.crossing(b - a - 1) @ step for a, b in zip([-1, *at], at)]  # from the start or the last such token up to this one
        emit = [np.exp(np.array([0.0, e]) - max(0.0, e)) for e in evidence]
        forward, f = [], np.array([1.0, 0.0])
        for m, e in zip(into, emit):
            f = (f @ m) * e
            f = f / f.sum()
            forward.append(f)
        back, b = [], self.crossing(n - at[-1] - 1) @ np.ones(2)
        for k in range(len(at) - 1, -1, -1):
            back.append(b)
            b = into[k] @ (emit[k] * b)
            b = b / b.sum()
        both = [f * b for f, b in zip(forward, reversed(back))]
        return [float(x[1] / x.sum()) for x in both]

    def tags(self, text: str | None) -> tuple[float, list[tuple[int, int]]]:
        """The document's score, and where its toxic tokens begin and end."""
        words = TOKEN.findall(text or "")
        evidence = self.evidence
        found = [(k, e) for k, w in enumerate(words) if (e := evidence(w)) is not None]
        if not found:
            return self.score([]), []
        p = self.marginals([k for k, _ in found], [e for _, e in found], len(words))
        toxic = {k for (k, _), x in zip(found, p) if x >= 0.5}
        spans = [m.span() for k, m in enumerate(TOKEN.finditer(text)) if k in toxic] if toxic else []
        return self.score(p), spans

    def score(self, marginals: list[float]) -> float:
        a, b, c = self.link
        x = a + b * max(marginals, default=0.0) + c * tagged(marginals)
        return float(1 / (1 + np.exp(-x)))


def tagged(marginals: list[float]) -> float:
    """The sum of the marginals of tokens tagged toxic, 4 at most."""
    return min(sum(p for p in marginals if p >= 0.5), 4.0)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def fit_field(counted: Counter[tuple[tuple[tuple[int, ...], int], ...]], n_features: int, rounds: int = 120) -> tuple[np.ndarray, float, np.ndarray]:
    """Likelihood ascent over windows of equal length, each as often as it occurs; each token is (features, label)."""
    windows, times = list(counted), np.array(list(counted.values()), dtype=float)
    n, length = len(windows), len(windows[0])
    labels = np.array([[y for _, y in w] for w in windows])
    flat = [(i, k, f) for i, w in enumerate(windows) for k, (fs, _) in enumerate(w) for f in fs]
    row, col, feat = (np.array([x[j] for x in flat], dtype=np.int64) for j in range(3))
    theta, bias, move = np.zeros(n_features), -2.0, np.zeros((2, 2))
    moments = [np.zeros(n_features + 5), np.zeros(n_features + 5)]
    observed_move = np.zeros((2, 2))
    np.add.at(observed_move, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), times.repeat(length - 1))
    observed_feat = np.bincount(feat, weights=labels[row, col] * times[row], minlength=n_features)
    for t in range(1, rounds + 1):
        emit = np.full((n, length), bias)
        np.add.at(emit, (row, col), theta[feat])
        score = np.stack([np.zeros_like(emit), emit], axis=-1)
        fwd, bwd = [score[:, 0]], [np.zeros((n, 2))]
        for k in range(1, length):
            fwd.append(log_sum(fwd[-1][:, :, None] + move, 1) + score[:, k])
            bwd.append(log_sum(move[None] + (score[:, length - k] + bwd[-1])[:, None, :], 2))
        bwd = bwd[::-1]
        total = log_sum(fwd[-1], 1)
        p = np.stack([np.exp(f + b - total[:, None])[:, 1] for f, b in zip(fwd, bwd)], axis=1)
        pair = sum(np.exp(fwd[k][:, :, None] + move + (score[:, k + 1] + bwd[k + 1])[:, None, :] - total[:, None, None]).T @ times for k in range(length - 1)).T
        grad = np.concatenate(
            [observed_feat - np.bincount(feat, weights=p[row, col] * times[row], minlength=n_features) - 0.1 * theta, [times @ (labels - p).sum(axis=1)], (observed_move - pair - 0.1 * move).ravel()]
        )
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad**2
        step = 0.2 * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.99**t)) + 1e-8)
        theta, bias, move = theta + step[:n_features], bias + float(step[n_features]), move + step[n_features + 1 :].reshape(2, 2)
    return theta, bias, move


def signs(text: str) -> list[int]:
    """Min-hashes of the text's word triples; near copies share most."""
    w = text.lower().encode("utf-8", "surrogatepass").split()
    if not w:
        return []
    h = np.array([zlib.crc32(b" ".join(w[k : k + 3])) for k in range(max(1, len(w) - 2))], dtype=np.uint64)
    odd = (np.arange(1, SIGNS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return [int((((h + np.uint64(k)) * odd[k]) >> np.uint64(20)).min()) for k in range(SIGNS)]


def without_copies(sample: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The first text of each group of near copies: those that share two signs in a row with one kept before."""
    kept, seen = [], set()
    for text, y in sample:
        own = signs(text)
        pairs = {(k, own[k], own[k + 1]) for k in range(len(own) - 1)}
        if pairs and not pairs.isdisjoint(seen):
            continue
        seen |= pairs
        kept.append((text, y))
    return kept


def learn(sample: list[tuple[str, int]]) -> Field:
    """A field from (text, label) of a bounded sample, in a fixed order."""
    sample = without_copies(sample)
    none = Field({}, -2.0, np.zeros((2, 2)), (-50.0, 0.0, 0.0))
    n_toxic = sum(y for _, y in sample)
    if not n_toxic or n_toxic == len(sample):
        return none
    words = [(set(TOKEN.findall(t.lower())), y) for t, y in sample]
    toxic: Counter[str] = Counter()
    for ws, y in words:
        if y:
            toxic.update({f for w in ws for f in features_of(w)})
    toxic = Counter({f: n for f, n in toxic.items() if n >= SUPPORT})
    clean: Counter[str] = Counter()
    for ws, y in words:
        if not y:
            clean.update({f for w in ws for f in features_of(w) if f in toxic})
    base = n_toxic / len(sample)
    leads = sorted(((lead(n, clean[f], base), f) for f, n in toxic.items()), reverse=True)
    strong = [f for x, f in leads[:FEATURES] if x >= SIGNIFICANCE and toxic[f] / max(clean[f], 0.5) > 8 * base / (1 - base)]
    number = {f: k for k, f in enumerate(sorted(strong))}
    if not number:
        return none
    windows: Counter[tuple[tuple[tuple[int, ...], int], ...]] = Counter()
    for k, (t, y) in enumerate(sample):
        ws = TOKEN.findall(t)
        tokens = [tuple(number[f] for f in features_of(w) if f in number) for w in ws]
        centres = [i for i, fs in enumerate(tokens) if fs] + ([(k * 7919) % len(ws)] if ws else [])
        for c in centres:
            around = [tokens[i] if 0 <= i < len(ws) else () for i in range(c - WINDOW, c + WINDOW + 1)]
            windows[tuple((fs, int(bool(fs) and y == 1)) for fs in around)] += 1
    theta, bias, move = fit_field(windows, len(number))
    field = Field({f: float(theta[k]) for f, k in number.items()}, bias, move, (0.0, 0.0, 0.0))
    evidence = []
    for t, y in sample:
        ws = TOKEN.findall(t)
        found = [(i, e) for i, w in enumerate(ws) if (e := field.evidence(w)) is not None]
        p = field.marginals([i for i, _ in found], [e for _, e in found], len(ws)) if found else []
        evidence.append((1.0, max(p, default=0.0), tagged(p)))
    field.link = tuple(logistic(np.array(evidence), np.array([y for _, y in sample])))
    return field


def logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Weights by Newton's steps with a small penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ w)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    """A field from at most TOXIC and CLEAN labelled rows, which is what reaches the driver."""
    # Copies of the table may hold the label as another type.
    toxic = F.col("toxic").cast("double")
    rows = labels.where((F.pmod(id_hash(F.col("doc_id")), F.lit(FOLDS)) != HELD_OUT) & toxic.isin(0.0, 1.0)).select(F.col("doc_id").cast("long").alias("id"), toxic.cast("int").alias("toxic")).distinct()
    chosen = [rows.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in ((1, TOXIC), (0, CLEAN))]
    ids = {r.id: r.toxic for part in chosen for r in part.collect()}
    if not ids:
        return learn([])
    table_of = docs.sparkSession.createDataFrame(list(ids.items()), "id long, toxic int")
    # Bounded: TOXIC + CLEAN ids.
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    found = own.join(F.broadcast(table_of), "id")
    sample = {r.id: (r.text, r.toxic) for r in found.toLocalIterator()}
    return learn([sample[k] for k in sorted(sample)])


def score(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, predicted, spans: the offsets of toxic tokens as `begin-end`, comma-joined."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("spans", pa.string())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [field.tags(t) for t in b.column("text").to_pylist()]
        columns = [[s for s, _ in found], [int(s >= 0.5) for s, _ in found], [",".join(f"{x}-{y}" for x, y in spans) for _, spans in found]]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, type=schema[1 + k].type) for k, c in enumerate(columns)]], schema=schema)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double, predicted int, spans string")


def keep_clean(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of docs whose text isn't predicted toxic, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [field.tags(t)[0] < 0.5 for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(keep, type=pa.bool_()))

    from linkweave.llm.common import small_batches

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    field = fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return score(docs, field).select("doc_id", F.coalesce(F.pmod(id_hash(F.col("doc_id")), F.lit(FOLDS)) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted", "spans")
