import random

import duckdb
from pyspark.sql import functions as F

from linkweave.llm import licenses, lines

from .conftest import awkward


def brute_lines(texts):
    seen, out = {}, []
    for t in texts:
        if t is None:
            out.append((None, 0))
            continue
        split = t.split("\n")
        own = [i for i, x in enumerate(split) if x.strip(" \t\n\x0b\f\r")]
        gone = set()
        alone = [[i] for i in own if len(split[i].translate(str.maketrans("\t\x0b\f\r", "    ")).split(" ")) - split[i].translate(str.maketrans("\t\x0b\f\r", "    ")).split(" ").count("") >= 50]
        for at in [own[k : k + 3] for k in range(len(own) - 2)] + alone:
            w = tuple(split[i] for i in at)
            if w in seen:
                gone.update(at)
            seen[w] = True
        out.append(("\n".join(x for i, x in enumerate(split) if i not in gone), len(gone)))
    return out


def test_lines_against_brute_force(frame):
    texts = awkward(1)
    got = [(r.text, r.n_removed) for r in lines.dedup_lines(frame(texts)).orderBy("doc_id").collect()]
    assert got == brute_lines(texts)


def test_other_columns_stay(frame):
    df = frame(["a\nb\nc", "a\nb\nc\nd"])
    out = lines.dedup_lines(df)
    assert out.columns == [*df.columns, "n_removed"]
    rows = out.orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["a\nb\nc", "d"] and [r.id for r in rows] == [0, 7]
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_long_lines_are_windows_by_themselves(frame):
    long = " ".join(f"w{k}" for k in range(50))
    short = " ".join(f"w{k}" for k in range(49))
    rows = lines.dedup_lines(frame([f"a\n{long}\nb", f"c\n{long}\n\nd\n{short}", long, f"{long}\n{short}", short])).orderBy("doc_id").collect()
    assert [r.text for r in rows] == [f"a\n{long}\nb", f"c\n\nd\n{short}", "", short, short] and [r.n_removed for r in rows] == [0, 1, 1, 1, 0]


def test_rows_that_share_an_id_are_judged_each_by_their_text(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (1, "x\na\nb\nc"), (None, "p\nq\nr"), (2, "p\nq\nr\ns"), (None, "y"), (3, None)], "doc_id int, text string")
    texts = sorted(((r.doc_id or 0), r.text or "") for r in lines.dedup_lines(df).collect())
    # Of id 1 the text with the lesser hash keeps the passage; rows without an id come first.
    assert texts in ([(0, "p\nq\nr"), (0, "y"), (1, ""), (1, "x\na\nb\nc"), (2, "s"), (3, "")], [(0, "p\nq\nr"), (0, "y"), (1, "a\nb\nc"), (1, "x"), (2, "s"), (3, "")])


def test_a_window_that_most_documents_share(frame, monkeypatch):
    # Hot and other windows alike: most lines are one passage's.
    texts = ["a\nb\nc"] * 300 + [f"u{k // 2}\nv\nw" for k in range(60)] + ["a\nb\nc\nd"]
    assert [(r.text, r.n_removed) for r in lines.dedup_lines(frame(texts)).orderBy("doc_id").collect()] == brute_lines(texts)
    monkeypatch.setattr("linkweave.llm.common.HOT_SHARE", 4)
    assert [(r.text, r.n_removed) for r in lines.dedup_lines(frame(texts)).orderBy("doc_id").collect()] == brute_lines(texts)


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", 5, "k"), (2, "a\nb\nc", 6, "l")], "doc_id long, text string, __id long, `a.b` string").withColumns({"id": F.lit("i"), "own": F.lit("o"), "Cut": F.lit("c"), "places": F.lit("p")})
    out = lines.dedup_lines(df)
    assert out.columns == [*df.columns, "n_removed"]
    assert sorted(map(tuple, out.collect())) == [(1, "a\nb\nc", 5, "k", "i", "o", "c", "p", 0), (2, "", 6, "l", "i", "o", "c", "p", 3)]


def test_repeated_rows_are_alike(frame):
    df = frame(["a\nb\nc", "x\na\nb\nc"])
    rows = lines.dedup_lines(df.unionByName(df)).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(0, "a\nb\nc")] * 2 + [(1, "x")] * 2


def test_line_plan_has_no_python(frame):
    plan = lines.dedup_lines(frame(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def words_of(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    out, word = [], ""
    for c in low + " ":
        if c > "\x7f" or c.isascii() and (c.isdigit() or "a" <= c <= "z"):
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def brute_base(t):
    w = words_of(t)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_phrases_against_brute_force(frame):
    rng = random.Random(6)
    parts = ["MIT", "license", "License,", "apache", "general", "public", "the", "é", "x-y"]
    texts = awkward(2) + [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    for r in licenses.scan(frame(texts)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert (r.score == 1) or not r.n_base


def test_notices_with_changes_are_found(frame):
    notice = licenses.NOTICES[1][0].split()
    changed = " ".join([*notice[:9], "really", *notice[9:20], *notice[21:]])
    rows = licenses.scan(frame(["before " + changed + " after", "permission is granted", " ".join(reversed(notice))])).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == ["mit", "", ""] and 0.7 <= rows[0].score < 1 and rows[0].n_base == 0


def test_spans_are_in_order_and_of_bounded_width(frame):
    notice = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met".split()
    backwards = " filler ".join(f"{a} {b}" for a, b in reversed(list(zip(notice, notice[1:]))))
    spread = " ".join(w + " filler" * 6 * (k % 3 == 2) for k, w in enumerate(notice))
    drift = notice[:5] + ["x"] * 4 + notice[5:12] + ["y"] * 4 + notice[12:]
    too_far = notice[:5] + ["x"] * 17 + notice[5:12] + ["y"] * 17 + notice[12:]
    texts = [backwards, spread, " ".join(drift), " ".join(too_far), " ".join(notice), " ".join(notice * 3)]
    docs = frame(texts)
    assert [r.labels for r in licenses.scan(docs).orderBy("doc_id").collect()] == ["", "", "bsd", "", "bsd", "bsd"]
    c = duckdb.connect()
    c.register("documents", docs.select("doc_id", "text").toArrow())
    assert [r[0] for r in c.sql(f"SELECT labels FROM ({licenses.OP2_SQL}) ORDER BY doc_id").fetchall()] == ["", "", "bsd", "", "bsd", "bsd"]


def test_longest_reading_in_order(spark):
    rng = random.Random(7)
    rows = [([(rng.randint(0, 9), rng.randint(0, 12)) for _ in range(rng.randint(0, 9))],) for _ in range(150)]

    def brute(found):
        best = {}
        for x in sorted(found):
            best[x] = 1 + max((n for y, n in best.items() if y[0] < x[0] and y[1] < x[1]), default=0)
        return max(best.values(), default=0)

    df = spark.createDataFrame(rows, "found array<struct<place:int,at:int>>").select("found", licenses.in_order(F.col("found")).alias("n"))
    assert all(r.n == brute([tuple(x) for x in r.found]) for r in df.collect())


def test_rows_that_share_an_id_are_scanned_each(spark):
    df = spark.createDataFrame([(1, "the mit license"), (1, "mit"), (1, "the mit license"), (1, "license"), (None, "mit license"), (None, None)], "doc_id long, text string")
    assert sorted(((r.doc_id or 0), r.n_words, r.n_base) for r in licenses.scan(df).collect()) == [(0, 0, 0), (0, 2, 1), (1, 1, 0), (1, 1, 0), (1, 3, 1), (1, 3, 1)]


def test_sql_gives_the_same_rows(frame):
    texts = [t for t in awkward(4) if t is None or "\x00" not in t] + ["Released under the MIT License.", licenses.NOTICES[4][0] * 2]
    docs = frame(texts).select("doc_id", "text")
    c = duckdb.connect()
    c.register("documents", docs.toArrow())
    for df, sql in ((licenses.scan(docs), licenses.OP2_SQL), (lines.dedup_lines(docs), lines.OP4_SQL)):
        rel = c.sql(sql)
        assert sorted((tuple(r[x] for x in rel.columns) for r in df.collect()), key=str) == sorted(rel.fetchall(), key=str)


def test_license_plan_has_no_python(frame):
    assert licenses.scan(frame(["a"]).limit(0)).count() == 0
    plan = licenses.scan(frame(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
