import random

from pyspark.sql import functions as F

from linkweave.operators import blocking as B


def naive_fold(fold, lists, counts):
    chosen = []
    for s in fold.steps:
        n = counts.get(s.test or fold.test_channel, 0)
        if s.frequent is not None and s.frequent != (n > fold.bound):
            continue
        if len(chosen) >= s.below:
            continue
        ids = lists[s.channel][: s.quota] if s.head else lists[s.channel]
        taken = 0
        for i in ids:
            if i not in chosen:
                chosen.append(i)
                taken += 1
                if taken >= s.quota:
                    break
    return chosen[: fold.total]


def test_folds_against_a_loop(spark):
    rng = random.Random(4)
    for name, fold in B.FOLDS.items():
        channels = list(dict.fromkeys(s.channel for s in fold.steps))
        tests = B.tests_of(fold)
        rows = []
        for k in range(12):
            lists = {c: sorted({f"S2-{rng.randint(0, 120):03}" for _ in range(rng.choice([0, 2, 40, 90]))}) for c in channels}
            rows.append((k, lists, {t: rng.choice([0, 50, 51, 61, 200]) for t in tests}))
        schema = "k int" + "".join(f", {c} array<string>" for c in channels) + "".join(f", n_{t} long" for t in tests)
        df = spark.createDataFrame([(k, *ls.values(), *ns.values()) for k, ls, ns in rows], schema)
        got = {r.k: r.out for r in df.select("k", B.fold(fold).alias("out")).collect()}
        for k, lists, counts in rows:
            assert got[k] == naive_fold(fold, lists, counts), name


def test_ids_seen_but_not_taken_stay_eligible(spark):
    fold = B.Fold((B.Step("x", 1), B.Step("y", 5)), 10)
    df = spark.createDataFrame([(["a", "b"], ["b", "c"])], "x array<string>, y array<string>")
    assert df.select(B.fold(fold).alias("o")).first().o == ["a", "b", "c"]


def test_soft_cap_takes_whole_lists(spark):
    found = spark.createDataFrame([("s", f"c{i}", 0) for i in range(3)] + [("s", f"d{i}", 1) for i in range(3)] + [("s", "e", 2), ("t", "x", 5)], "s1_id string, cand_id string, pos int")
    for cap, expected in ((1, 3), (3, 3), (4, 6), (6, 6), (7, 7)):
        assert B.soft_cap(found, cap).where("s1_id = 's'").count() == expected
    assert B.soft_cap(found, 1).where("s1_id = 't'").count() == 1


def test_tokens_left_out_change_nothing(spark):
    rng = random.Random(7)
    tokens = [f"t{i}" for i in range(12)]
    heads = spark.createDataFrame([(f"S1-{i}", [rng.choice(tokens) for _ in range(5)]) for i in range(30)], "entity_id string, toks array<string>")
    targets = spark.createDataFrame([(f"S2-{i}", [tokens[min(11, int(rng.expovariate(0.4)))] for _ in range(3)]) for i in range(200)], "entity_id string, toks array<string>")
    for cap in (1, 10, 60, 500):
        whole, pruned = (sorted(map(tuple, B.soft_cap(B.shared_tokens(heads, targets, "toks", 1, c), cap).collect())) for c in (None, cap))
        assert whole == pruned and whole


def test_postings_hold_the_first_ids_and_count_all(spark):
    keys = spark.createDataFrame([("f", "hot", f"S2-{i:04}") for i in range(500)] + [("f", "cold", "S2-9")], "family string, key string, entity_id string")
    got = {r.key: r for r in B.postings(keys, 150).collect()}
    assert got["hot"].n == 500 and got["hot"].ids == [f"S2-{i:04}" for i in range(150)] and got["cold"].ids == ["S2-9"]


def test_frequency_subdivision_at_the_bound(spark):
    fold = B.FOLDS["v3"]
    base = {s.channel: [] for s in fold.steps} | {"ordered_pair": [f"p{i:02}" for i in range(60)], "sub_num": ["n"], "sub_3": ["t"]}
    schema = "".join(f"{c} array<string>, " for c in base) + "n_ordered_pair long"
    df = spark.createDataFrame([(*base.values(), 50), (*base.values(), 51)], schema)
    few, many = (r.o for r in df.select("n_ordered_pair", B.fold(fold).alias("o")).orderBy("n_ordered_pair").select("o").collect())
    assert few == base["ordered_pair"] and many == ["n", "t", *base["ordered_pair"][:25]]


def test_equal_values_and_union(spark):
    df = spark.createDataFrame([("S1-1", "a"), ("S2-1", "a"), ("S3-1", "a"), ("S2-2", ""), ("S1-2", "")], "entity_id string, norm_name string")
    found = B.equal_values(df.where(F.col("entity_id").startswith("S1")), df.where(~F.col("entity_id").startswith("S1")), ["norm_name"], "norm_name <> ''")
    assert sorted(map(tuple, found.collect())) == [("S1-1", "S2-1"), ("S1-1", "S3-1")]
    assert B.union(found, found).count() == 2


def test_first_targets_of_a_hot_key(spark):
    heads = spark.createDataFrame([(f"S1-{i}", "hot") for i in range(5)] + [("S1-9", "cold")], "entity_id string, k string")
    targets = spark.createDataFrame([(f"S2-{i:03}", "hot") for i in range(200)] + [("S2-900", "cold"), ("S2-901", "")], "entity_id string, k string")
    found = B.equal_values(heads, targets, ["k"], "k <> ''", 20)
    assert sorted(map(tuple, found.collect())) == sorted([(f"S1-{i}", f"S2-{k:03}") for i in range(5) for k in range(20)] + [("S1-9", "S2-900")])
    # Ranked before the join: no pair beyond the first is ever made.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("row_number")


def test_open_folds_as_pairs(spark):
    rng = random.Random(9)
    fold = B.FOLDS["open"]
    channels = [s.channel for s in fold.steps]
    keys = lambda n, p: [(f"{p}-{i:03}", c, c, f"k{min(3, int(rng.expovariate(0.8)))}") for i in range(n) for c in channels if rng.random() < 0.6]
    q, t = keys(12, "S1"), keys(260, "S2")
    schema = "entity_id string, channel string, family string, key string"
    got = {(r.s1_id, r.cand_id): r.step for r in B.open_pairs(spark.createDataFrame(q, schema), spark.createDataFrame(t, schema), fold).collect()}
    want = {}
    for s1, c, _, k in q:
        step = channels.index(c)
        ids = sorted(i for i, c2, _, k2 in t if (c2, k2) == (c, k))[: fold.steps[step].quota]
        for i in ids:
            want[s1, i] = min(step, want.get((s1, i), 99))
    assert got == want and len({s for s in want.values()}) == len(channels)


def test_tokens_of_too_many_targets_can_be_left_out(spark):
    heads = spark.createDataFrame([("S1-1", ["hot", "rare"])], "entity_id string, toks array<string>")
    targets = spark.createDataFrame([(f"S2-{i}", ["hot"]) for i in range(100)] + [("S3-1", ["rare"])], "entity_id string, toks array<string>")
    assert B.shared_tokens(heads, targets, "toks", 3).count() == 101
    assert [r.cand_id for r in B.shared_tokens(heads, targets, "toks", 3, most_targets=50).collect()] == ["S3-1"]


def test_strategies_are_resumed(spark, tmp_path):
    made = []
    make = lambda n: lambda: made.append(n) or spark.createDataFrame([("S1-1", f"S2-{n}"), ("S1-1", f"S2-{n}")], "s1_id string, cand_id string")
    for names in (["a"], ["a", "b"]):
        found = B.run_strategies({n: make(n) for n in names}, str(tmp_path), spark)
        assert sorted(map(tuple, found.select("strategy", "cand_id").collect())) == [(n, f"S2-{n}") for n in names]
    assert made == ["a", "b"]
