"""Retrieval in tiles against comparing all pairs."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from linkweave.operators import tfidf
from linkweave.plans import fixtures


def plain(heads, targets, terms_of, top_k):
    """The rows of comparing each head with each target."""
    counted = {t: Counter(terms_of(x)) for t, x in targets}
    df = Counter(x for c in counted.values() for x in c)
    idf = {x: math.log((1 + len(targets)) / (1 + n)) + 1 for x, n in df.items() if n >= 2}

    def scaled(c):
        w = {x: (1 + math.log(n)) * idf[x] for x, n in c.items() if x in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {x: v / norm for x, v in w.items()}

    rows, b = [], {t: scaled(c) for t, c in counted.items()}
    for h, text in heads:
        a = scaled(Counter(terms_of(text)))
        sims = sorted((-round(sum(v * w[x] for x, v in a.items() if x in w), 6), t) for t, w in b.items())
        rows += [(h, t, -s, k + 1) for k, (s, t) in enumerate([x for x in sims if x[0] < 0][:top_k])]
    return sorted(rows)


def words(x):
    w = x.split()
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def grams(x):
    return [p[k : k + n] for p in (f" {w} " for w in x.split()) for n in (3, 4) for k in range(len(p) - n + 1)]


def retrieved(spark, monkeypatch, terms, top_k):
    monkeypatch.setattr(tfidf, "HEAD_BLOCK", 7)
    monkeypatch.setattr(tfidf, "TARGET_BLOCK", 11)
    rng = np.random.default_rng(5)
    some = ["the", *[f"w{k}x" for k in range(12)]]
    texts = [" ".join(["the", *(some[i] for i in rng.integers(0, len(some), 3))]) for _ in range(90)]
    heads, targets = ([(f"S{s}-{k}", x) for k, x in enumerate(part)] for s, part in ((1, texts[:30]), (2, texts[30:])))
    got = tfidf.top_similar(spark.createDataFrame(heads, "entity_id string, n string"), spark.createDataFrame(targets, "entity_id string, n string"), "n", terms, top_k)
    return heads, targets, sorted(map(tuple, got.select("s1_id", "cand_id", "sim", "rank").collect()))


def test_words_over_several_tiles(spark, monkeypatch):
    heads, targets, got = retrieved(spark, monkeypatch, tfidf.word_terms, 6)
    assert got == plain(heads, targets, words, 6)


def test_characters_over_several_tiles(spark, monkeypatch):
    heads, targets, got = retrieved(spark, monkeypatch, tfidf.char_terms, 4)
    assert got == plain(heads, targets, grams, 4)


@pytest.mark.parametrize("n", [0, 1, 40])
def test_ties_go_by_key_however_many(n):
    ids = [f"t{k:03}" for k in reversed(range(n))]
    targets = pa.table({"target": pa.array(ids, pa.string()), "terms": pa.array([[1, 2]] * n, pa.list_(pa.int32())), "weights": pa.array([[0.6, 0.8]] * n, pa.list_(pa.float64()))})
    heads = pa.table({"head": ["h"], "terms": pa.array([[2, 3]], pa.list_(pa.int32())), "weights": pa.array([[0.5, 0.5]], pa.list_(pa.float64()))})
    got = tfidf.nearest_in_tile(heads, targets, 5).to_pylist()
    assert got == [{"head": "h", "target": t, "sim": 0.4} for t in sorted(ids)[:5]]


def test_entities_take_the_first_tokens_of_any_text(spark, tmp_path):
    text = "--É " + " -- ".join(f"T{k}" for k in range(30)) + " ! " * 5000
    spark.createDataFrame([(0, text, "en"), (1, None, None), (2, "a b", "de"), (3, " ".join("abcdefghijkl"), "de")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.entity_id: r for r in fixtures.derived(spark, str(tmp_path)).collect()}
    assert (got["S1-0"].business_name, got["S1-0"].business_address, got["S1-0"].link_key) == ("t0 t1 t2 t3 t4 t5", "t6 t7 t8 t9 t10 t11 t12 t13", "t4 t5 t6 t7 t8 t9 t10 t11")
    assert (got["S2-1"].business_name, got["S3-2"].link_key, got["S1-3"].link_key) == ("", "", "e f g h i j k l")
