"""Similarities of a pair: set measures and positional ratios as column expressions, edit ratios as one Arrow function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Shared over all distinct values; both_empty if neither has any."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def ngram_jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(jaccard(a, b))


def containment(a: Column, b: Column) -> Column:
    """The share of a's distinct values that b has; 0 if a has none."""
    n = F.size(F.array_distinct(a))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / n)


def numeric_jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(jaccard(a, b))


def same_set(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def length_difference(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.abs(F.length(a) - F.length(b)) / longest)


def positional_ratio(a: Column, b: Column) -> Column:
    """Twice the places with equal characters over both lengths."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(2 * same / (F.length(a) + F.length(b)))


def sorted_words(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, " "), lambda w: w != "")), " ")


def positional_token_ratio(a: Column, b: Column) -> Column:
    return positional_ratio(sorted_words(a), sorted_words(b))


def positional_partial(a: Column, b: Column) -> Column:
    """1 if one holds the other, else the positional ratio; 0 if one is empty."""
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(F.contains(a, b) | F.contains(b, a), F.lit(1.0)).otherwise(positional_ratio(a, b))


def places_of(a: str) -> dict[str, int]:
    """For each character of a, its places as bits of a whole number."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    return places


def common_length(a: str, b: str, places: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, by bits of whole numbers."""
    get = (places or places_of(a)).get
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & get(c, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Similarity by insertions and deletions: 1 for equal values, both empty included."""
    total = len(a) + len(b)
    return 1.0 if a == b else 2 * common_length(a, b) / total


def best_stretch(a: str, b: str) -> float:
    """The best ratio of a with a stretch of b of its length, or less at either end of b. a is the shorter, or of b's length.

    From one stretch to the next the common length grows by one at most, so stretches that can't beat the best so far are passed over.
    """
    n, m = len(a), len(b)
    places, best, at = places_of(a), 0, 0
    while at <= m - n:
        found = common_length(a, b[at : at + n], places)
        best = max(best, found)
        at += max(1, best - found + 1)
    out = best / n
    for size in range(n - 1, 0, -1):  # shorter ones, at either end
        if 2 * size / (n + size) <= out:
            break
        for part in (b[:size], b[m - size :]):
            out = max(out, 2 * common_length(a, part, places) / (n + size))
    return out


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter value with a stretch of the longer one; of values of one length, either way round."""
    if not a or not b:
        return float(a == b)
    if len(a) > len(b):
        a, b = b, a
    if a in b:
        return 1.0
    out = best_stretch(a, b)
    return max(out, best_stretch(b, a)) if len(a) == len(b) else out


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best of shared tokens against shared and own ones, and of both sides' shared and own ones; 0 if either has none."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and not (only_a and only_b):
        return 1.0
    with_a, with_b = (f"{both} {only}".strip() for only in (only_a, only_b))
    out = ratio(with_a, with_b)
    return max(out, ratio(both, with_a), ratio(both, with_b)) if both else out


def partial_token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    return 1.0 if x & y else partial_ratio(" ".join(sorted(x - y)), " ".join(sorted(y - x)))


def weighted_ratio(a: str, b: str) -> float:
    """The best of the ratios, those of tokens and of parts weighed down; parts count if one value is much longer."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    tokens = max(token_sort_ratio(a, b), token_set_ratio(a, b))
    if longer < 1.5:
        return max(ratio(a, b), 0.95 * tokens)
    scale = 0.9 if longer <= 8.0 else 0.6
    parts = max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_token_set_ratio(a, b))
    return max(ratio(a, b), scale * partial_ratio(a, b), 0.95 * scale * parts)


EDIT_FIELDS = ("ratio", "partial", "weighted", "token_sort", "token_set")
_EDIT = dict(zip(EDIT_FIELDS, (ratio, partial_ratio, weighted_ratio, token_sort_ratio, token_set_ratio)))


@F.pandas_udf(StructType([StructField(f, DoubleType()) for f in EDIT_FIELDS]))
def edit_ratios(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """All edit ratios of a pair in one pass; equal pairs in a batch are compared once."""
    seen: dict[tuple[str, str], list[float]] = {}
    rows = []
    for pair in zip(a.fillna(""), b.fillna("")):
        if pair not in seen:
            seen[pair] = [f(*pair) for f in _EDIT.values()]
        rows.append(seen[pair])
    return pd.DataFrame(rows, columns=list(EDIT_FIELDS))
