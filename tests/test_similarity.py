import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkweave.functions import similarity as S


def common_by_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    return row[-1]


@given(st.text("abc d", max_size=12), st.text("abc d", max_size=12))
@settings(max_examples=300, deadline=None)
def test_common_length(a, b):
    assert S.common_length(a, b) == common_by_table(a, b)


def best_window(short, long):
    windows = [long[max(k, 0) : k + len(short)] for k in range(1 - len(short), len(long))]
    return max(2 * common_by_table(short, w) / (len(short) + len(w)) for w in windows)


@given(st.text("ab c", min_size=1, max_size=8), st.text("ab c", min_size=1, max_size=12))
@settings(max_examples=400, deadline=None)
def test_partial_ratio_is_the_best_window(a, b):
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    want = max(best_window(a, b), best_window(b, a)) if len(a) == len(b) else best_window(short, long)
    assert S.partial_ratio(a, b) == pytest.approx(want, abs=1e-12) and S.partial_ratio(b, a) == S.partial_ratio(a, b)


def test_partial_ratio_of_equal_lengths():
    assert S.partial_ratio("abcd", "bcde") == pytest.approx(6 / 7) and S.partial_ratio("acme llc", "cme llcx") == pytest.approx(14 / 15)


def test_edit_ratios():
    assert S.ratio("abc", "abd") == pytest.approx(2 * 2 / 6)
    assert S.ratio("", "") == 1.0 and S.ratio("a", "") == 0.0
    assert S.token_sort_ratio("b a", "a b") == 1.0
    assert S.token_set_ratio("a b", "a b c") == 1.0 and S.token_set_ratio("", "a") == 0.0
    assert S.partial_ratio("foo", "a foo b") == 1.0
    assert S.weighted_ratio("foo bar", "bar foo") == pytest.approx(0.95) and S.weighted_ratio("", "a") == 0.0


def test_columns(spark):
    rng = random.Random(2)
    sets = [[rng.choice("abcd") for _ in range(rng.randint(0, 4))] for _ in range(40)]
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in range(40)]
    rows = [(k, a, b, x, y) for k, (a, b, x, y) in enumerate(zip(sets, sets[1:], words, words[1:]))]
    a, b, x, y = (F.col(c) for c in "abxy")
    df = spark.createDataFrame(rows, "k int, a array<string>, b array<string>, x string, y string")
    out = df.select(
        "*", S.jaccard(a, b).alias("j"), S.jaccard(a, b, 0.0).alias("j0"), S.containment(a, b).alias("c"), S.same_set(a, b).alias("s"), S.length_difference(x, y).alias("l"), S.positional_ratio(x, y).alias("p"), S.edit_ratios(x, y).alias("e")
    ).collect()
    for r in out:
        p, q = set(r.a), set(r.b)
        assert r.j == (len(p & q) / len(p | q) if p | q else 1.0) and r.j0 == (len(p & q) / len(p | q) if p | q else 0.0)
        assert r.c == (len(p & q) / len(p) if p else 0.0) and r.s == bool(p and p == q)
        n = max(len(r.x), len(r.y))
        assert r.l == (abs(len(r.x) - len(r.y)) / n if n else 0.0)
        same = sum(i == j for i, j in zip(r.x, r.y))
        assert r.p == (1.0 if r.x == r.y else 2 * same / (len(r.x) + len(r.y)) if r.x and r.y else 0.0)
        assert r.e.ratio == S.ratio(r.x, r.y) and r.e.weighted == S.weighted_ratio(r.x, r.y)
