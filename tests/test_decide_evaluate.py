import random

import pytest
from pyspark.sql import functions as F

from linkweave.operators import decide, evaluate, features, split, validate
from linkweave.operators import model


def frames(spark, predicted, truth, heads):
    p = spark.createDataFrame([(s, c) for s, cs in predicted.items() for c in cs], "s1_id string, cand_id string")
    t = spark.createDataFrame([(s, c) for s, cs in truth.items() for c in cs], "s1_id string, tid string")
    return spark.createDataFrame([(h,) for h in heads], "s1_id string"), p, t


def one(spark, predicted, truth, empty_precision=1.0):
    h, p, t = frames(spark, {"a": predicted}, {"a": truth}, ["a"])
    r = evaluate.entity_scores(h, p, t, empty_precision).first()
    return r.precision, r.recall, r.f


CASES = [
    (["S2-00047", "S2-00193", "S3-00812"], ["S2-00047", "S3-00812"], (2 / 3, 1.0, 1.25 * (2 / 3) / (0.25 * 2 / 3 + 1))),
    ([], [], (1.0, 1.0, 1.0)),
    ([], ["S2-001"], (1.0, 0.0, 0.0)),
    (["S2-001"], [], (0.0, 1.0, 0.0)),
    (["S2-001", "S2-001"], ["S2-001"], (1.0, 1.0, 1.0)),
    (["C", "D"], ["A", "B"], (0.0, 0.0, 0.0)),
]


@pytest.mark.parametrize("predicted, truth, expected", CASES)
def test_entity_scores(spark, predicted, truth, expected):
    assert one(spark, predicted, truth) == pytest.approx(expected)


def test_strict_precision_of_a_miss(spark):
    assert one(spark, [], ["x"], 0.0) == (0.0, 0.0, 0.0)


def test_macro_and_singletons(spark):
    h, p, t = frames(spark, {"a": CASES[0][0], "c": ["z"]}, {"a": CASES[0][1]}, ["a", "b", "c"])
    scores = evaluate.entity_scores(h, p, t)
    m = evaluate.macro(scores).first()
    assert m.n_entities == 3 and m.f05 == pytest.approx((CASES[0][2][2] + 1 + 0) / 3, abs=1e-6)
    s = evaluate.singletons(scores).first()
    assert (s.n_singletons, s.n_correct, s.n_false_merges, s.accuracy) == (2, 1, 1, 0.5)
    empty = evaluate.macro(scores.limit(0)).first()
    assert (empty.n_entities, empty.f05) == (0, 0.0)


def test_candidate_recall(spark):
    _, p, t = frames(spark, {"a": ["x"]}, {"a": ["x", "y"]}, ["a"])
    r = evaluate.candidate_recall(p, t).first()
    assert (r.total_links, r.covered_links, r.missing_links, r.recall) == (2, 1, 1, 0.5)
    assert evaluate.candidate_recall(p, t.limit(0)).first().recall == 1.0


SCORES = [("a", "x", 0.9), ("a", "y", 0.7), ("a", "z", 0.64), ("b", "x", 0.79), ("c", "w", 0.80), ("c", "v", 0.80)]


def ids(df):
    return sorted((r.s1_id, r.cand_id) for r in df.collect())


def test_decisions_at_their_bounds(spark):
    s = spark.createDataFrame(SCORES, "s1_id string, cand_id string, score double")
    assert ids(decide.decide(s, gap=0.201)) == [("a", "x"), ("a", "y"), ("c", "v"), ("c", "w")]
    assert ids(decide.decide(s, cap=1)) == [("a", "x"), ("c", "v")]
    assert ids(decide.threshold(s, 0.64)) == sorted((a, b) for a, b, _ in SCORES)
    assert ids(decide.match_cap(s, 0.71, 1)) == [("a", "x"), ("b", "x"), ("c", "v")]
    assert ids(decide.singleton_gate(s, 0.75, 0.05)) == [("a", "x"), ("c", "v"), ("c", "w")]


def test_search_against_each_setting_alone(spark):
    rng = random.Random(3)
    heads = [f"S1-{i}" for i in range(15)]
    scored = [(h, f"S2-{j}", round(rng.random(), 2)) for h in heads[:12] for j in range(rng.randint(0, 6))]
    truth = {h: [f"S2-{rng.randint(0, 6)}"] for h in heads[::2]}
    h, _, t = frames(spark, {}, truth, heads)
    s = spark.createDataFrame(scored, "s1_id string, cand_id string, score double")
    grid = decide.settings(spark, (0.65, 0.8), (0.6, 0.7), (0.1, 0.3), (1, 3))
    got = {r.setting: r for r in decide.search(s, t, h, grid).collect()}
    for g in grid.collect():
        scores = evaluate.entity_scores(h, decide.decide(s, g.least, g.gate, g.gap, g.cap), t, 0.0)
        m = evaluate.macro(scores).first()
        assert got[g.setting].macro_f05 == pytest.approx(m.f05, abs=6e-5) and got[g.setting].precision == pytest.approx(m.precision, abs=6e-5)
        assert got[g.setting].false_merges == evaluate.singletons(scores).first().n_false_merges
    assert decide.best(decide.search(s, t, h, grid)).first().macro_f05 == max(r.macro_f05 for r in got.values())
    # A gate of 0.65 goes with one threshold, 0.8 with two.
    assert len(grid.collect()) == (1 + 2) * 2 * 2 and decide.settings(spark).count() == 384


def test_split(spark):
    heads = [f"S1-{i}" for i in range(200)]
    truth = {heads[0]: list("abcd")} | {h: ["x"] for h in heads[1:50]} | {h: ["x", "y"] for h in heads[50:60]}
    h, _, t = frames(spark, {}, truth, heads)
    rows = split.stratified(h, t).collect()
    n = {}
    for r in rows:
        n.setdefault(r.bucket, []).append(r.split == "val")
    assert {b: (len(x), sum(x)) for b, x in n.items()} == {"4+": (1, 1), "1": (49, 7), "2-3": (10, 2), "0": (140, 21)}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, split.stratified(h.repartition(3), t).collect()))
    assert split.leaks(split.stratified(h, t)).count() == 0


def test_training_pairs(spark):
    pairs = spark.createDataFrame([("a", f"c{i}") for i in range(100)] + [("b", f"c{i}") for i in range(3)], "s1_id string, cand_id string")
    links = spark.createDataFrame([("a", "c1"), ("a", "c2")], "s1_id string, tid string")
    got = features.training_pairs(pairs, links, ratio=5.0, most=8).collect()
    assert sum(r.label for r in got) == 2 and sum(r.s1_id == "a" and r.label == 0 for r in got) <= 8 and len(got) <= 12


def test_training_pairs_keep_the_least_hashes(spark):
    import hashlib

    rng = random.Random(8)
    pairs = [(f"h{i}", f"c{k}") for i in range(60) for k in rng.sample(range(500), 30)]
    links = [(a, b) for a, b in pairs if rng.random() < 0.03]
    got = {(r.s1_id, r.cand_id) for r in features.training_pairs(spark.createDataFrame(pairs, "s1_id string, cand_id string"), spark.createDataFrame(links, "s1_id string, tid string"), most=20).where("label = 0").collect()}
    md5 = lambda *x: hashlib.md5("|".join(x).encode()).hexdigest()
    own = []
    for head in {a for a, _ in pairs}:
        wrong = sorted((md5("42", a, b), b) for a, b in pairs if a == head and (a, b) not in links)
        own += [(head, b) for _, b in wrong[: min(max(1, 5 * sum(a == head for a, _ in links)), 20)]]
    want = sorted(own, key=lambda x: (md5("42", x[1], x[0]), *x))[: 5 * len(links)]
    assert got == set(want) and len(own) > len(want) > 0


def test_the_best_strategy_is_dispatched(spark):
    rng = random.Random(5)
    rows = [(f"h{i % 9}", f"c{i}", round(rng.random(), 3)) for i in range(80)]
    scored = spark.createDataFrame(rows, "s1_id string, cand_id string, score double")
    links = spark.createDataFrame([(a, b) for a, b, s in rows if s > 0.8], "s1_id string, tid string")
    heads = spark.createDataFrame([(f"h{i}",) for i in range(11)], "s1_id string")
    compared = {r.strategy: r.f05 for r in decide.compare(scored, links, heads, 0.5).collect()}
    best = decide.best_strategy(scored, links, heads, 0.5).collect()
    assert len(best) == 1 and best[0].f05 == max(compared.values()) == compared[best[0].strategy]
    got = {(r.s1_id, r.cand_id) for r in decide.dispatch(scored, decide.best_strategy(scored, links, heads, 0.5)).collect()}
    own = {"score gap": lambda: decide.score_gap(scored, 0.5, best[0].gap), "match cap": lambda: decide.match_cap(scored, 0.5, best[0].cap), "singleton gate": lambda: decide.singleton_gate(scored, 0.5, best[0].gate - 0.5), "pure threshold": lambda: decide.threshold(scored, 0.5)}
    want = next(f() for n, f in own.items() if best[0].strategy.startswith(n))
    assert got == {(r.s1_id, r.cand_id) for r in want.collect()}


def test_trees_part_what_is_apart(spark):
    rng = random.Random(1)
    rows = [("s", f"c{i}", i % 2, (i % 2) * 0.8 + rng.random() * 0.1, rng.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "s1_id string, cand_id string, label int, x double, y double")
    trees = model.fit(df, ["x", "y"], rounds=3, depth=2)
    assert model.importances(trees, ["x", "y"])[0][0] == "x"
    scores = {r.cand_id: r.score for r in model.score(trees, df).collect()}
    assert all((scores[c] > 0.5) == (y == 1) for _, c, y, _, _ in rows)
    parted = df.withColumn("s1_id", F.concat(F.lit("s"), "cand_id")).withColumn("split", F.when(F.crc32("cand_id") % 4 == 0, "val").otherwise("train"))
    links = parted.where("label = 1").select("s1_id", F.col("cand_id").alias("tid"))
    found, least, name = model.mined(parted, ["x", "y"], links, rounds=2)
    assert name in ("v1", "v2") and 0.1 <= least <= 0.9
    over = {r.cand_id for r in model.score(found, df).where(F.col("score") >= least).collect()}
    assert sum((c in over) == (y == 1) for _, c, y, _, _ in rows) >= 0.97 * len(rows)


def test_held_out_rows_end_a_fit(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(f"c{i}", int(rng.random() < 0.5), rng.random()) for i in range(120)], "cand_id string, label int, x double")
    trees = model.fit(df, ["x"], rounds=40, depth=2, validation=F.crc32("cand_id") % 3 == 0)
    assert trees.stages[-1].getNumTrees < 40


def test_headers():
    good = ["source1_entity_id", "matched_entity_ids"]
    assert validate.header_problem("source1_entity_id\tmatched_entity_ids\n", good) is None
    assert "commas" in validate.header_problem("a,b", good) and validate.header_problem("a\tb", good) and validate.header_problem("", good)
