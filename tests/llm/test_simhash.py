import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from linkweave.llm import simhash

from .conftest import awkward


def brute_print(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\x0b\f\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=2):
    root = dict(enumerate(range(len(prints))))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(prints, dtype=np.uint64)
    for i in range(len(a)):
        for j in np.nonzero(np.bitwise_count(a ^ a[i]) <= radius)[0]:
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def check(frame, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(texts)).collect()}
    prints = [brute_print(t) for t in texts]
    assert got == {i: (f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, brute_components(prints)))}


def test_against_brute_force(frame):
    rng = random.Random(8)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta".split()) for _ in range(60)) for _ in range(5)]
    near = [b.replace("alpha", "ALPHA") + " tail" * (k % 2) for b in base for k in range(12)]
    check(frame, awkward() + base + near)


def test_links_and_components_of_bare_values(spark):
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(40)} | {0, 2**64 - 1}
    for v in list(values)[:12]:
        for _ in range(6):  # chains of small steps
            v ^= 1 << rng.randrange(64)
            values.add(v)
    listed = sorted(values)
    signed = [v - 2**64 if v >= 2**63 else v for v in listed]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    want = brute_components(listed)
    groups = {}
    for s, c in zip(signed, want):
        groups.setdefault(c, set()).add(s)
    got = {}
    for s in signed:
        got.setdefault(roots.get(s, s), set()).add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_small_blocks_find_the_same_links(spark, monkeypatch):
    values = [(v,) for v in range(300)]  # all near each other
    df = spark.createDataFrame(values, "fp long")
    monkeypatch.setattr(simhash, "BLOCK", 16)
    edges = simhash.links(df)
    assert edges.count() < 300 * 60  # forests, not all pairs
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert set(roots.values()) == {0} and len(roots) == 299


def test_null_only_and_empty_tables(frame):
    assert [tuple(r)[1:] for r in simhash.near_duplicates(frame([None, "", None])).collect()] == [("0" * 16, 0)] * 3
    assert simhash.near_duplicates(frame(["a"]).limit(0)).count() == 0


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40))
@settings(max_examples=50, deadline=None)
def test_majority(hashes):
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.majority(np.array(hashes, dtype=np.uint64)) == want


def test_offsets_cover_the_radius():
    both = set(simhash.offsets(2)) | {tuple(-x for x in d) for d in simhash.offsets(2)}
    assert len(both) == 41 and len(simhash.offsets(2)) == 21
