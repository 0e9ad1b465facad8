import math
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from linkweave.llm import quality, registry, toxicity
from linkweave.llm.common import materialize

from .test_lines_licenses import brute_lines
from .test_packing import check_bins
from .test_quality import brute as brute_quality
from .test_quality import split as split_words
from .test_simhash import brute_components, brute_print

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    before = docs
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, before, SF).persist()
        assert after.columns == columns, name
        assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
        before = after
    rows = before.collect()
    assert all(r.n_chars == len(r.text) for r in rows) and len(rows) < len(texts)
    packed = P.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows}


def plainly_kept(t):
    """The quality rules from their table, by loops."""
    n, word_chars, n_symbols, n_dup_lines, n_repeat, failed = brute_quality(t)
    words = split_words(t or "")
    lowered = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    measures = {
        "n_words": n, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat,
        "n_lines": sum(bool(split_words(x)) for x in (t or "").split("\n")), "n_stop_words": sum(w.rstrip(".,;:!?#*$%&|<>") in quality.STOP_WORDS for w in lowered),
        "n_same_again": sum(x == y for x, y in zip(words, words[1:])),
    }
    holds = lambda r: (r.low is None or measures[r.numerator] * 1000 >= r.low * measures[r.denominator]) and (r.high is None or measures[r.numerator] * 1000 <= r.high * measures[r.denominator])
    return not failed and all(map(holds, quality.RULES))


def plain_score(field, t):
    """The document score by forward and backward sums over every token, one at a time."""
    emit, marks = [], []
    for w in toxicity.TOKEN.findall(t or ""):
        found = [field.emission[f] for f in toxicity.features_of(w) if f in field.emission]
        marks.append(bool(found))
        emit.append(math.exp(min(field.bias + sum(found), 500)))
    step = np.exp(field.move)
    forward, f = [], np.array([1.0, 0.0])
    for e in emit:
        f = f @ step * (1, e)
        forward.append(f := f / f.sum())
    back, b = [], np.ones(2)
    for e in reversed(emit):
        back.append(b)
        b = step @ (b * (1, e))
        b = b / b.sum()
    both = [x * y for x, y in zip(forward, reversed(back))]
    p = [x[1] / x.sum() for x, m in zip(both, marks) if m]
    a, b, c = field.link
    return 1 / (1 + math.exp(-(a + b * max(p, default=0.0) + c * min(sum(x for x in p if x >= 0.5), 4.0))))


def test_each_stage_against_a_plain_version(spark):
    """Every stage on what the stage before kept, held against loops that share no code with its operator but the fitted field and the tables of rules."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id").cast("long"))
    field = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(P.STAGES)

    def step(name, want):
        nonlocal docs, rows
        docs = materialize(stages[name](spark, docs, SF), "test")
        rows = {r.doc_id: r.text for r in docs.collect()}
        assert rows == want, name

    step("quality rules", {i: t for i, t in rows.items() if plainly_kept(t)})
    step("toxicity", {i: t for i, t in rows.items() if plain_score(field, t) < 0.5})
    ordered = sorted(rows)
    step("line dedup", {i: t for i, (t, _) in zip(ordered, brute_lines([rows[i] for i in ordered]))})
    ordered = sorted(rows)
    components = brute_components([brute_print(rows[i]) for i in ordered])
    step("simhash near-dedup", {i: rows[i] for k, i in enumerate(ordered) if components[k] == k})
    packed = stages["best-fit packing"](spark, docs, SF).collect()
    check_bins(packed, 2048)
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in packed:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for i, t in rows.items():
        ids = own.encode(t or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 2048 + 1
        starts = [0, *range(first, len(ids), 2048)]
        want = [(k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))]
        assert sorted(pieces[i]) == want
    assert set(pieces) == set(rows)


def awkward_docs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, own string, document string"
    long = " ".join(f"the word{k} of" for k in range(40))
    rows = [(1, None), (None, long), (2, ""), (3, long), (3, long), (4, long + " more"), (None, None), (5, "short"), (6, long.upper())]
    return spark.createDataFrame([(i, t, None, None, None, "x", "y") for i, t in rows], schema)


def test_stages_of_awkward_rows(spark):
    docs = awkward_docs(spark)
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        assert {(r.own, r.document) for r in after.collect()} == {("x", "y")}
        if name == "toxicity":
            assert after.count() == docs.count()
        if name == "simhash near-dedup":
            # The texts of 3, 3 and 6 are alike, and so are those of 1 and 2; rows without an id stay.
            assert sorted((r.doc_id or 0) for r in after.collect() if r.doc_id != 4) == [0, 0, 1, 3, 3, 5]
    assert sorted({(r.doc_id or 0) for r in P.STAGES[-1][1](spark, docs, SF).collect()}) == [0, 1, 2, 3, 4, 5, 6]


def test_run_leaves_its_result_only(spark):
    from linkweave.llm import common

    import glob

    here = lambda: set(glob.glob(common.shared_dir(spark).removeprefix("file:") + "/*"))
    before = here()
    n = P.run(spark, SF).count()
    assert n and len([p for p in here() - before if "best-fit-packing" in p]) == 1 and len(here() - before) == 1


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_run_over_whole_tables(spark, name):
    table = "pages" if name == "op6_html_extraction" else "documents"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    rows = registry.QUERIES[name](spark, SF).collect()
    key = "page_id" if table == "pages" else "doc_id"
    assert len({r[key] for r in rows}) == n and (name.startswith("op10") or len(rows) == n)


def test_stages_in_order_and_an_empty_table(spark):
    assert [n for n, _ in P.STAGES] == ["quality rules", "toxicity", "line dedup", "simhash near-dedup", "best-fit packing"]
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, none, SF).count() == 0, name
