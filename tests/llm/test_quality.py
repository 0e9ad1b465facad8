import duckdb
import pytest

from linkweave.llm import quality

from .conftest import awkward

WS = " \t\n\x0b\f\r"


def split(t):
    for c in WS:
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def brute(t):
    t = t or ""
    words = split(t)
    grams = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for places in grams.values() if len(places) > 1 for i in places for k in range(8)}
    lines = [x for x in t.split("\n") if split(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_against_brute_force(frame):
    texts = awkward() + ["# a | b " * 9, "<p>" * 30, "one two three four five six seven eight " * 3, "r s t u v w x y z " * 40]
    out = {r.doc_id: r for r in quality.judge(frame(texts)).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), i
        assert not (r.kept and r.base_failed)
    assert len(out) == len(texts)


def test_clean_prose_stays_and_junk_goes(frame):
    clean = "It was the best of times and it was the worst of times, as the river ran on to the sea and men spoke with the birds that flew over it."
    junk = ["### *** $$$ %%% " * 12, "qqqq " * 40, " ".join(w for w in clean.split()[:12] for _ in range(5)), clean[:30]]
    kept = [r.kept for r in quality.judge(frame([clean, *junk])).orderBy("doc_id").collect()]
    assert kept == [True, False, False, False, False]


def test_empty_table(frame):
    assert quality.judge(frame(["a"]).limit(0)).count() == 0


def test_one_projection(frame):
    plan = quality.judge(frame(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_sql_gives_the_same_rows(frame):
    texts = [t for t in awkward(3) if t is None or "\x00" not in t]
    docs = frame(texts).select("doc_id", "text")
    table = docs.toArrow()
    got = sorted(tuple(r) for r in quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect())
    c = duckdb.connect()
    c.register("documents", table)
    assert got == sorted(c.sql(quality.OP9_SQL).fetchall())


@pytest.mark.parametrize("n", [7, 8, 9, 16, 17])
def test_windows_at_their_bounds(frame, n):
    t = " ".join(f"w{i % 8}" for i in range(n))
    assert quality.judge(frame([t])).first().n_repeat_words == brute(t)[4]


def test_names_that_clash(spark):
    df = spark.createDataFrame([("a b " * 20, 1, 2, "x", 3)], "text string, __m int, m int, `row` string, N_words int")
    out = quality.judge(df)
    assert out.columns[:4] == ["text", "__m", "m", "row"] and "N_words" not in out.columns
    assert tuple(out.first())[1:5] == (1, 2, "x", 40)


def test_words_of_equal_windows_are_compared(frame, monkeypatch):
    # A hash that tells nothing apart: only the words do.
    monkeypatch.setattr(quality.F, "xxhash64", lambda *_: quality.F.lit(1).cast("long"))
    texts = [" ".join(f"w{k}" for k in range(30)), "w " * 30]
    assert [r.n_repeat_words for r in quality.judge(frame(texts)).orderBy("doc_id").collect()] == [0, 30]
