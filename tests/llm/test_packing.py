import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkweave.llm import packing

from .conftest import awkward


def check_bins(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_against_the_tokenizer(frame, capacity):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = awkward() + ["тест " * 40, "naïve café — “quoted”…", "한국어 텍스트"]
    rows = packing.pack(frame(texts), capacity).collect()
    n = check_bins(rows, capacity)
    total = 0
    for i, t in enumerate(texts):
        ids = own.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        parts = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(ids) // capacity))) and all(r.length == capacity for r in parts[1:])
        at = 0
        for r in parts:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert n <= 1.02 * -(-total // capacity) + 1


def test_fast_ids_are_the_tokenizers(frame):
    e = packing.Encoder()
    rng = random.Random(4)
    letters = "aB é ñ ß œ Ž\n\t  1!'s ɏ"
    for _ in range(400):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert e(t).tolist() == e.own.encode(t, add_special_tokens=False).ids


def brute_fullest(counts, capacity):
    pieces = sorted(Counter(counts).elements(), reverse=True)
    reach = {0}
    for x in pieces[1:]:
        reach |= {s + x for s in reach if s + x <= capacity - pieces[0]}
    return pieces[0] + max(reach)


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_fullest_is_fullest(counts):
    got = packing.fullest(counts, 30)
    assert max(got) == max(counts) and not Counter(got) - Counter(counts) and sum(got) == brute_fullest(counts, 30)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 500), min_size=1, max_size=12))
@settings(max_examples=100, deadline=None)
def test_plan_places_every_piece_once(counts):
    bins, ranks = {}, Counter()
    for x, first, past, each, start, at in packing.plan(counts, 40):
        assert ranks[x] == first
        ranks[x] = past
        for r in range(first, past):
            bins.setdefault(start + (r - first) // each, []).append((at + (r - first) % each * x, x))
    assert ranks == Counter(counts)
    for parts in bins.values():
        at = 0
        for offset, x in sorted(parts):
            assert offset == at
            at += x
        assert at <= 40


def test_one_length_alone_and_empty_table(frame):
    rows = packing.pack(frame(["a"] * 700), 9).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 700 and check_bins(rows, 9) == 175
    assert packing.pack(frame(["a"]).limit(0)).count() == 0


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(3, 4) == [(0, 3)]


@pytest.fixture(scope="module")
def untouched():
    """The tokenizers file as its library reads it; no code of ours has set anything on it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 1_000_000 + "a", "a" + "\n \t" * 300_000, "a" * 1_000_000, "7" * 300_000, "x <|endoftext|> y", "<|endoftext|>", "<|endoftext|", "é" * 200_000, " a" * 200_000, "a" + " " * 9_999 + "b" + " " * 10_000])
def test_any_text_has_the_tokenizers_ids(untouched, text):
    assert packing.Encoder()(text).tolist() == ids(untouched, text)


def test_every_character_of_the_fast_path(untouched):
    e = packing.Encoder()
    for c in map(chr, (*range(0x250), *range(0x2010, 0x2028))):
        for a, b in (("", ""), ("a", "b"), (" ", " "), ("1", "2"), (".", "!"), ("\n", "\t"), ("é", "ß"), ("'", "s"), (c, c)):
            t = f"{a}{c}{b}{c} {c}"
            assert e(t).tolist() == ids(untouched, t)


def test_fast_ids_of_whole_documents(untouched):
    import os

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data here")
    import pyarrow.parquet as pq

    e = packing.Encoder()
    for t in pq.read_table(path, columns=["text"]).column(0).to_pylist():
        assert e(t or "").tolist() == ids(untouched, t or "")


def test_rows_without_an_id_and_clashing_names(spark):
    df = spark.createDataFrame([(None, "a b", 1, 2), (None, "a b", 1, 2), (3, None, 1, 2)], "doc_id long, text string, length int, rank int")
    rows = packing.pack(df, 8).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in rows) == [(0, 0, 3), (0, 0, 3), (3, 0, 1)] and check_bins(rows, 8) == 1
