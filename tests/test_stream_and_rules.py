import math
import random

from pyspark.sql import functions as F

from linkweave.operators import blocking, model, tfidf, validate
from linkweave.streaming import candidates as stream

SCHEMA = "entity_id string, c string, norm_name string"
KEYS = (blocking.Key("norm_name", ("c", "norm_name"), "norm_name <> ''"),)


def keyed(df):
    parts = df.withColumns({"tokens": F.split("norm_name", " "), "sorted_tokens": F.array_sort(F.split("norm_name", " ")), "nums": F.array().cast("array<string>"), "norm_addr": F.lit(""), "country": F.col("c")})
    return blocking.keyed(parts, KEYS)


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    heads = spark.createDataFrame([("S1-1", "US", "acme"), ("S1-2", "US", "zeta")], SCHEMA)

    def run():
        stream.stream_pairs(spark, source, heads.schema, keyed, keyed(heads), out, checkpoint).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(out).collect()))

    spark.createDataFrame([("S2-1", "US", "acme"), ("S2-2", "FR", "acme")], SCHEMA).coalesce(1).write.parquet(source)
    assert run() == [("S1-1", "S2-1", "norm_name")]
    spark.createDataFrame([("S3-1", "US", "zeta"), ("S3-2", "US", "acme")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    assert run() == [("S1-1", "S2-1", "norm_name"), ("S1-1", "S3-2", "norm_name"), ("S1-2", "S3-1", "norm_name")]


def test_cosines_against_plain_python(spark):
    rng = random.Random(12)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    rows = [(f"S{1 + i % 2}-{i}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))) for i in range(40)]
    df = spark.createDataFrame(rows, "entity_id string, n string")
    got = {(r.s1_id, r.cand_id): r.sim for r in tfidf.top_similar(df.where("entity_id LIKE 'S1%'"), df.where("entity_id LIKE 'S2%'"), "n", tfidf.word_terms, 100).collect()}

    def terms(s):
        w = s.split()
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    targets = [r for r in rows if r[0].startswith("S2") and r[1]]
    df_of = {}
    for _, s in targets:
        for t in set(terms(s)):
            df_of[t] = df_of.get(t, 0) + 1

    def vector(s):
        v = {t: (1 + math.log(terms(s).count(t))) * (math.log((1 + len(targets)) / (1 + df_of[t])) + 1) for t in set(terms(s)) if df_of.get(t, 0) >= 2}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / n for t, x in v.items()} if n else {}

    want = {}
    for i, a in rows:
        for j, b in targets:
            if i.startswith("S1"):
                s = round(sum(x * vector(b).get(t, 0) for t, x in vector(a).items()), 6)
                if s > 0:
                    want[i, j] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_nearest_targets_of_skewed_texts(spark):
    """A term in nearly all texts, one text that a third of the targets have, ties: the k nearest are those of comparing all, and few pairs are compared."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    name = lambda: " ".join(["group", *sorted(rng.sample(words, rng.randint(1, 3)))])
    rows = [(f"S1-{i:03}", name() if i % 4 else "group") for i in range(30)] + [(f"S2-{i:03}", "group" if i % 3 == 0 else name()) for i in range(300)] + [("S2-900", " "), ("S1-900", "")]
    df = spark.createDataFrame(rows, "entity_id string, n string")
    heads, targets = (df.where(F.col("entity_id").startswith(s)) for s in ("S1", "S2"))
    every = tfidf.top_similar(heads, targets, "n", tfidf.word_terms, 1000)
    few = sorted(map(tuple, tfidf.top_similar(heads, targets, "n", tfidf.word_terms, 7).collect()))
    assert few == sorted(tuple(r) for r in every.collect() if r.rank <= 7) and len(few) == 30 * 7


def test_character_runs_stay_within_words(spark):
    row = spark.createDataFrame([("ab cde",)], "n string").select(tfidf.char_terms(F.col("n")).alias("t")).first()
    assert sorted(row.t) == sorted([" ab", "ab ", " ab ", " cd", "cde", "de ", " cde", "cde "])


def test_files_that_cannot_be_read(spark, tmp_path):
    header = ["source1_entity_id", "matched_entity_ids"]
    (tmp_path / "good.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\t\n")
    (tmp_path / "commas.csv").write_text("source1_entity_id,matched_entity_ids\n")
    (tmp_path / "empty.tsv").write_text("")
    assert validate.file_problems(spark, str(tmp_path / "good.tsv"), header) == []
    assert validate.file_problems(spark, str(tmp_path / "commas.csv"), header) and validate.file_problems(spark, str(tmp_path / "empty.tsv"), header)
    assert validate.file_problems(spark, str(tmp_path / "none.tsv"), header) == ["no such file"]


def test_qa(spark):
    rows = spark.createDataFrame([("S1-1", ["S2-1", "S2-1"]), ("S1-2", ["X-1", "S3-1"]), ("S1-3", [])], "s1_id string, ids array<string>")
    pairs = spark.createDataFrame([("S1-1", "S2-1")], "s1_id string, cand_id string")
    r = validate.qa(rows, pairs).first()
    assert (r.n_rows, r.repeated_ids, r.wrong_prefixes, r.outside_candidates) == (3, 1, 1, 2)
    assert validate.summary(rows).first().n_links == 4


def test_models_are_saved(spark, tmp_path):
    df = spark.createDataFrame([("s", f"c{i}", i % 2, float(i % 2)) for i in range(40)], "s1_id string, cand_id string, label int, x double")
    trees = model.fit(df, ["x"], rounds=1, depth=1)
    model.save(trees, str(tmp_path / "m"))
    a, b = (sorted(map(tuple, model.score(m, df).collect())) for m in (trees, model.load(str(tmp_path / "m"))))
    assert a == b
