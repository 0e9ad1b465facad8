"""Candidate generation: key families, bounded posting lists, and ordered quota folds over channels.

A specification lists keys as plain columns of a profile. Targets become posting lists that hold the first ids of each key, no more than a
fold can use, and the number of all; query rows join those lists, so a hot key costs each query row a bounded list. Folds run in one
higher-order expression a query row.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkweave.sources.tables import cached, written

SEPARATOR = "\u0001"
#: Ids of one key that a fold can use at most.
ARRIVALS = 150
UNLIMITED = 1_000_000_000


@dataclass(frozen=True)
class Key:
    """A channel of query rows: the columns of its key, when a row has it, and the family of target keys it looks up."""

    channel: str
    columns: tuple[str, ...]
    guard: str
    family: str = ""

    @property
    def looks_up(self) -> str:
        return self.family or self.channel


@dataclass(frozen=True)
class Step:
    """Take up to quota ids not taken yet from a channel, while fewer than below are taken, if the frequency test holds.

    frequent: True needs the test channel's key to have more targets than bound, False no more. head: only the first quota ids count.
    """

    channel: str
    quota: int = UNLIMITED
    below: int = UNLIMITED
    frequent: bool | None = None
    head: bool = False
    test: str = ""


@dataclass(frozen=True)
class Fold:
    steps: tuple[Step, ...]
    total: int
    test_channel: str = ""
    bound: int = 50


NAME_KEYS = (
    Key("norm_name", ("c", "norm_name"), "norm_name <> ''"),
    Key("stem_name", ("c", "stem_name"), "stem_name <> ''"),
    Key("sorted_stem", ("c", "sorted_stem"), "sorted_stem <> ''"),
    Key("ordered_pair", ("c", "t0", "t1"), "nt >= 2"),
    Key("sorted_pair", ("c", "s0", "s1"), "nt >= 2"),
    Key("sub_num", ("c", "s0", "s1", "n0"), "nt >= 2 AND nn >= 1"),
    Key("sub_3", ("c", "s0", "s1", "s2"), "nt >= 3"),
    Key("sec_shingle", ("c", "s0", "s2"), "nt >= 3"),
    Key("sec_shingle", ("c", "s1", "s2"), "nt >= 3"),
    Key("single_tok", ("c", "t0"), "nt = 1 AND length(t0) >= 4"),
    Key("norm_addr", ("c", "norm_addr"), "norm_addr <> ''"),
    Key("addr_num", ("c", "n0", "t0"), "nn >= 1 AND nt >= 1"),
)

#: Pairs of sorted tokens share one family of lists, whichever places they have.
SHARED_TARGET_KEYS = (
    Key("norm_name", ("c", "norm_name"), "norm_name <> ''"),
    Key("stem_name", ("c", "stem_name"), "stem_name <> ''"),
    Key("sorted_stem", ("c", "sorted_stem"), "sorted_stem <> '' AND sorted_stem <> stem_name"),
    Key("pair", ("c", "s0", "s1"), "nt >= 2"),
    Key("pair", ("c", "s0", "s2"), "nt >= 3"),
    Key("pair", ("c", "s1", "s2"), "nt >= 3"),
    Key("sub_num", ("c", "s0", "s1", "n0"), "nt >= 2 AND nn >= 1"),
    Key("sub_3", ("c", "s0", "s1", "s2"), "nt >= 3"),
    Key("single_tok", ("c", "s0"), "nt = 1 AND length(s0) >= 4"),
    Key("norm_addr", ("c", "norm_addr"), "norm_addr <> ''"),
    Key("addr_num", ("c", "n0", "s0"), "norm_addr <> '' AND nn >= 1 AND nt >= 1"),
)
SHARED_QUERY_KEYS = (
    Key("norm_name", ("c", "norm_name"), "norm_name <> ''"),
    Key("sorted_stem", ("c", "sorted_stem"), "sorted_stem <> ''"),
    Key("stem_name", ("c", "stem_name"), "stem_name <> ''"),
    Key("first_pair", ("c", "s0", "s1"), "nt >= 2", "pair"),
    Key("second_pair", ("c", "s0", "s2"), "nt >= 3", "pair"),
    Key("third_pair", ("c", "s1", "s2"), "nt >= 3", "pair"),
    Key("sub_num", ("c", "s0", "s1", "n0"), "nt >= 2 AND nn >= 1"),
    Key("sub_3", ("c", "s0", "s1", "s2"), "nt >= 3"),
    Key("single_tok", ("c", "s0"), "nt = 1 AND length(s0) >= 4"),
    Key("norm_addr", ("c", "norm_addr"), "norm_addr <> ''"),
    Key("addr_num", ("c", "n0", "s0"), "nn >= 1 AND nt >= 1"),
)
TIER_KEYS = (
    Key("t1_exact", ("norm_name",), "length(norm_name) >= 4"),
    Key("t1_sorted_stem", ("sorted_stem",), "length(sorted_stem) >= 4"),
    Key("t2_street_postal", ("street_num", "postal"), "street_num <> '' AND postal <> ''"),
    Key("t2_exact_addr", ("norm_addr",), "length(norm_addr) >= 8"),
    Key("t4_sub_num", ("c", "s0", "s1", "n0"), "nt >= 2 AND nn >= 1"),
    Key("t4_sub_3", ("c", "s0", "s1", "s2"), "nt >= 3"),
    Key("t3_sorted_pair", ("c", "s0", "s1"), "nt >= 2"),
    Key("t3_sec_shingle", ("c", "s0", "s2"), "nt >= 3"),
    Key("t3_sec_shingle", ("c", "s1", "s2"), "nt >= 3"),
    Key("t3_ordered_pair", ("c", "t0", "t1"), "nt >= 2"),
    Key("t3_single_tok", ("c", "t0"), "nt = 1 AND length(t0) >= 5"),
)
#: Keys over `upper_country` and the first word of a name, for blocking without quotas on names.
OPEN_KEYS = (
    Key("norm_name", ("cu", "norm_name"), "norm_name <> ''"),
    Key("stem_name", ("cu", "bare_stem"), "nt >= 1"),
    Key("ordered_pair", ("cu", "t0", "t1"), "nt >= 2"),
    Key("single_tok", ("cu", "t0"), "nt = 1 AND length(t0) >= 4"),
    Key("norm_addr", ("cu", "norm_addr"), "norm_addr <> ''"),
    Key("addr_num", ("cu", "n0", "w0"), "nn >= 1 AND norm_name <> ''"),
)
#: Tiers without addresses; a sorted stem counts where it differs from the name.
SHORT_QUERY_KEYS = (
    Key("t1_exact", ("norm_name",), "length(norm_name) >= 4"),
    Key("t1_sorted_stem", ("sorted_stem",), "length(sorted_stem) >= 4 AND sorted_stem <> norm_name"),
    Key("t2_street_postal", ("street_num", "postal"), "street_num <> '' AND postal <> ''"),
    Key("t3_sorted_pair", ("c", "s0", "s1"), "nt >= 2"),
    Key("t3_sec_shingle", ("c", "s0", "s2"), "nt >= 3"),
    Key("t3_sec_shingle", ("c", "s1", "s2"), "nt >= 3"),
)
SHORT_TARGET_KEYS = tuple(Key(k.channel, k.columns, k.guard.replace(" AND sorted_stem <> norm_name", "")) for k in SHORT_QUERY_KEYS)

WIDE = "intl_"


def _both(channel: str, *args: int, **more: object) -> tuple[Step, Step]:
    return Step(channel, *args, **more), Step(WIDE + channel, *args, **more)


# The order, quotas and bounds of each fold.
FOLDS: dict[str, Fold] = {
    "v1": Fold((Step("norm_name", 60), Step("stem_name", 60, 60), Step("ordered_pair", 60, 60), Step("single_tok", 60, 60), Step("norm_addr", 30, 60), Step("addr_num", 30, 60)), 60),
    "v2": Fold(
        (
            Step("norm_name", 60),
            Step("sorted_stem", 60, 60),
            Step("stem_name", 60, 60),
            Step("sorted_pair", 60, 60),
            Step("sec_shingle", 30, 60),
            Step("ordered_pair", 60, 60),
            Step("single_tok", 60, 60),
            Step("norm_addr", 30, 60),
            Step("addr_num", 30, 60),
        ),
        60,
    ),
    "v3": Fold(
        (
            Step("norm_name", 60),
            Step("stem_name", 60, 60),
            Step("sub_num", 30, 60, True),
            Step("sub_3", 30, 60, True),
            Step("ordered_pair", 25, 60, True),
            Step("ordered_pair", 60, 60, False),
            Step("single_tok", 60, 60),
            Step("norm_addr", 30, 60),
            Step("addr_num", 30, 60),
        ),
        60,
        "ordered_pair",
    ),
    "v4": Fold((Step("norm_name"), Step("stem_name", 30), Step("ordered_pair", 50), Step("single_tok", 30), Step("norm_addr", 25), Step("addr_num", 25)), 120),
    "v5": Fold(
        (
            *_both("norm_name", 60, 60),
            *_both("stem_name", 60, 60),
            *_both("ordered_pair", 60, 60),
            *_both("single_tok", 60, 60),
            *_both("norm_addr", 30, 60),
            *_both("addr_num", 30, 60),
        ),
        60,
    ),
    "v6": Fold(
        (
            *_both("norm_name"),
            *_both("sorted_stem", 30),
            *_both("stem_name", 30),
            *_both("sub_num", 30, frequent=True),
            *_both("sub_3", 30, frequent=True),
            *_both("sorted_pair", 30, frequent=True),
            *_both("sorted_pair", 50, frequent=False),
            *_both("sec_shingle", 25, 120),
            *_both("ordered_pair", 25, 120),
            *_both("single_tok", 20, 120),
            *_both("norm_addr", 20, 120),
            *_both("addr_num", 20, 120),
        ),
        120,
        "sorted_pair",
    ),
    "production": Fold(
        (
            Step("norm_name", below=60),
            Step("stem_name", below=60),
            Step("ordered_pair", 60, 60, head=True),
            Step("single_tok", 60, 60, head=True),
            Step("norm_addr", 30, 60, head=True),
            Step("addr_num", 30, 60, head=True),
        ),
        60,
    ),
    "shared": Fold(
        (
            Step("norm_name", below=60),
            Step("sorted_stem", below=60),
            Step("stem_name", below=60),
            Step("first_pair", below=60, frequent=False),
            Step("sub_num", 30, 60, True, True),
            Step("sub_3", 30, 60, True, True),
            Step("first_pair", 25, 60, True, True),
            Step("second_pair", 20, 60, False, True, "second_pair"),
            Step("third_pair", 20, 60, False, True, "third_pair"),
            Step("single_tok", 60, 60, head=True),
            Step("norm_addr", 30, 60, head=True),
            Step("addr_num", 30, 60, head=True),
        ),
        60,
        "first_pair",
        60,
    ),
    "tiers": Fold(
        (
            Step("t1_exact"),
            Step("t1_sorted_stem", 30),
            Step("t2_street_postal", 30),
            Step("t2_exact_addr", 25),
            Step("t4_sub_num", 30),
            Step("t4_sub_3", 30),
            Step("t3_sorted_pair", 40),
            Step("t3_sec_shingle", 25),
            Step("t3_ordered_pair", 25),
            Step("t3_single_tok", 20),
        ),
        120,
    ),
    "short_tiers": Fold((Step("t1_exact"), Step("t1_sorted_stem", below=120), Step("t3_sorted_pair", below=120)), 120),
    "short_tiers_all": Fold((Step("t1_exact"), Step("t1_sorted_stem", below=120), Step("t2_street_postal", 30, 120), Step("t3_sorted_pair", below=120), Step("t3_sec_shingle", 25, 120)), 120),
    "exact_pair": Fold((Step("norm_name", 60), Step("ordered_pair", 60, 60)), 60),
    "open": Fold((Step("norm_name"), Step("stem_name"), Step("ordered_pair", 100, head=True), Step("single_tok", 100, head=True), Step("norm_addr"), Step("addr_num", 50, head=True)), UNLIMITED),
}


#: The columns that keys are made of: first tokens, sorted tokens, numbers, and how many there are. Expressions are text here, as each call to the JVM costs.
KEY_COLUMNS = {
    "t0": "get(tokens, 0)",
    "t1": "get(tokens, 1)",
    "s0": "get(sorted_tokens, 0)",
    "s1": "get(sorted_tokens, 1)",
    "s2": "get(sorted_tokens, 2)",
    "n0": "get(nums, 0)",
    "nt": "size(tokens)",
    "nn": "size(nums)",
    "cu": "upper(trim(country))",
    "w0": "get(split(norm_name, ' '), 0)",
    "bare_stem": "array_join(tokens, ' ')",
    "street_num": "coalesce(get(nums, 0), '')",
    "postal": "CASE WHEN length(try_element_at(nums, -1)) IN (5, 6) THEN try_element_at(nums, -1) ELSE '' END",
}


def keyed(profiles: DataFrame, keys: tuple[Key, ...], prefix: str = "") -> DataFrame:
    """entity_id, channel, family, key: a row for each key that an entity has."""
    one = lambda k: f"CASE WHEN {k.guard} THEN named_struct('channel', '{prefix}{k.channel}', 'family', '{prefix}{k.looks_up}', 'key', concat_ws('{SEPARATOR}', {', '.join(k.columns)})) END"
    used = {n: e for n, e in KEY_COLUMNS.items() if any(re.search(rf"\b{n}\b", " ".join((*k.columns, k.guard))) for k in keys)}
    rows = profiles.selectExpr("*", *[f"{e} AS {n}" for n, e in used.items()]).selectExpr("entity_id", f"explode(array({', '.join(map(one, keys))})) AS k")
    return rows.selectExpr("entity_id", "k.channel", "k.family", "k.key").where("channel IS NOT NULL")


def postings(target_keys: DataFrame, arrivals: int = ARRIVALS) -> DataFrame:
    """family, key, ids (the first by id), n (all). Only the first ids of a key are gathered; counts are summed map-side."""
    distinct = target_keys.select("family", "key", "entity_id")
    first = distinct.withColumn("at", F.row_number().over(Window.partitionBy("family", "key").orderBy("entity_id"))).where(F.col("at") <= arrivals)
    lists = first.groupBy("family", "key").agg(F.array_sort(F.collect_list("entity_id")).alias("ids"))
    return lists.join(distinct.groupBy("family", "key").agg(F.count("*").alias("n")), ["family", "key"])


def hits(query_keys: DataFrame, lists: DataFrame, channels: list[str], tests: list[str], arrivals: int = ARRIVALS) -> DataFrame:
    """A row for each query entity: for each channel its ids in order, and the target count of each test channel."""
    found = query_keys.withColumnRenamed("entity_id", "s1_id").join(lists, ["family", "key"])
    ids = lambda c: F.expr(f"slice(array_sort(array_distinct(flatten(collect_list(CASE WHEN channel = '{c}' THEN ids END)))), 1, {arrivals}) AS {c}")
    counts = [F.expr(f"coalesce(max(CASE WHEN channel = '{t}' THEN n END), 0) AS n_{t}") for t in tests]
    return found.groupBy("s1_id").agg(*map(ids, channels), *counts)


def fold(f: Fold) -> Column:
    """The candidates in order of selection, from the columns that hits() makes."""

    def step(s: Step) -> str:
        test = f"n_{s.test or f.test_channel}"
        on = "true" if s.frequent is None else f"{test} {'>' if s.frequent else '<='} {f.bound}"
        return f"struct({f'slice({s.channel}, 1, {s.quota})' if s.head else s.channel} AS ids, {s.quota} AS quota, {s.below} AS below, {on} AS on)"

    take = "CASE WHEN x.on AND size(acc) < x.below THEN concat(acc, slice(array_except(x.ids, acc), 1, x.quota)) ELSE acc END"
    return F.expr(f"aggregate(array({', '.join(map(step, f.steps))}), CAST(array() AS array<string>), (acc, x) -> {take}, acc -> slice(acc, 1, {f.total}))")


def tests_of(f: Fold) -> list[str]:
    return sorted({s.test or f.test_channel for s in f.steps if s.frequent is not None})


def assemble_all(all_heads: DataFrame, query_keys: DataFrame, target_keys: DataFrame, folds: dict[str, Fold]) -> DataFrame:
    """s1_id and a column of candidates for each fold, for every query entity, those without any included. Lists are joined once for all."""
    assert all(f.total < UNLIMITED for f in folds.values()), "open_pairs() is for folds without a total"
    channels = list(dict.fromkeys(s.channel for f in folds.values() for s in f.steps))
    tests = sorted({t for f in folds.values() for t in tests_of(f)})
    found = hits(query_keys.where(F.col("channel").isin(channels)), postings(target_keys), channels, tests)
    rows = all_heads.select(F.col("entity_id").alias("s1_id")).join(found.select("s1_id", *[fold(f).alias(n) for n, f in folds.items()]), "s1_id", "left")
    return rows.withColumns({n: F.coalesce(n, F.array().cast("array<string>")) for n in folds})


def assemble(all_heads: DataFrame, query_keys: DataFrame, target_keys: DataFrame, f: Fold) -> DataFrame:
    """s1_id, cands: the candidates of every query entity, those without any included."""
    return assemble_all(all_heads, query_keys, target_keys, {"cands": f})


def pairs(assembled: DataFrame) -> DataFrame:
    """s1_id, cand_id, rank: long form, in order of selection."""
    return assembled.select("s1_id", F.posexplode("cands").alias("rank", "cand_id"))


def open_pairs(query_keys: DataFrame, target_keys: DataFrame, f: Fold) -> DataFrame:
    """s1_id, cand_id, step: what a fold without totals or tests selects, and the place of the first step that does. For steps of one key a row.

    Pairs come from joins, never from lists in a row; of steps that count a key's first ids, only those targets are joined. Each row holds the keys
    of all steps, so a pair is left out where an earlier step gives it, and pairs are never brought together, but where ids repeat with other keys.
    """
    assert all(s.below == UNLIMITED and s.frequent is None and (s.head or s.quota == UNLIMITED) for s in f.steps) and f.total == UNLIMITED
    if repeats(query_keys, "entity_id", "channel") or repeats(target_keys, "entity_id", "family"):
        return _open_pairs_grouped(query_keys, target_keys, f)
    family = {r.channel: r.family for r in query_keys.select("channel", "family").distinct().collect()}
    assert len(set(family.values())) == len(family), "each channel needs a family of its own"
    steps = [(k, s) for k, s in enumerate(f.steps) if s.channel in family]
    one = lambda df, name, key, on: df.groupBy(F.col("entity_id").alias(name)).agg(*[F.max(F.when(F.col(on) == (s.channel if on == "channel" else family[s.channel]), F.col(key))).alias(f"{name[0]}{k}") for k, s in steps])
    place = Window.partitionBy("family", "key").orderBy("entity_id")
    # The first ids of a key stay; the rank is limited before the shuffle.
    kept = reduce(
        DataFrame.unionByName,
        [t if s.quota == UNLIMITED else t.withColumn("at", F.row_number().over(place)).where(F.col("at") <= s.quota).drop("at") for s in {family[s.channel]: s for _, s in steps}.values() for t in [target_keys.where(F.col("family") == family[s.channel]).select("entity_id", "family", "key")]],
    ) if steps else target_keys.where(F.lit(False))
    # Read once for each step.
    q, t = written(one(query_keys, "s1_id", "key", "channel"), "open-keys"), written(one(kept, "cand_id", "key", "family"), "open-keys")
    found = []
    for i, (k, _) in enumerate(steps):
        before = [F.coalesce(F.col(f"s{j}") == F.col(f"c{j}"), F.lit(False)) for j, _ in steps[:i]]
        a, b = q.where(F.col(f"s{k}").isNotNull()).withColumn("on", F.col(f"s{k}")), t.where(F.col(f"c{k}").isNotNull()).withColumn("on", F.col(f"c{k}"))
        found.append(spread(a, b, ["on"]).where(~reduce(lambda x, y: x | y, before, F.lit(False))).select("s1_id", "cand_id", F.lit(k).alias("step")))
    return reduce(DataFrame.unionByName, found) if found else query_keys.select(F.col("entity_id").alias("s1_id"), F.col("entity_id").alias("cand_id"), F.lit(0).alias("step")).where(F.lit(False))


def _open_pairs_grouped(query_keys: DataFrame, target_keys: DataFrame, f: Fold) -> DataFrame:
    """open_pairs() of entities with several keys a step: pairs are brought together."""
    order = F.create_map(*[x for k, s in enumerate(f.steps) for x in (F.lit(s.channel), F.lit(k))])
    whole = [s.channel for s in f.steps if s.quota == UNLIMITED]
    quota = F.create_map(*[x for s in f.steps if s.quota < UNLIMITED for x in (F.lit(s.channel), F.lit(s.quota))])
    t = target_keys.select("family", "key", F.col("entity_id").alias("cand_id"))
    first = t.where(~F.col("family").isin(whole)).withColumn("at", F.row_number().over(Window.partitionBy("family", "key").orderBy("cand_id")))
    first = first.where(F.col("at") <= max(s.quota for s in f.steps if s.quota < UNLIMITED)).where(F.col("at") <= quota[F.col("family")]).drop("at")
    kept = t.where(F.col("family").isin(whole)).unionByName(first)
    q = query_keys.select(F.col("entity_id").alias("s1_id"), "channel", "family", "key")
    return q.join(kept, ["family", "key"]).groupBy("s1_id", "cand_id").agg(F.min(order[F.col("channel")]).alias("step"))


def evidence(query_keys: DataFrame, target_keys: DataFrame, candidates: DataFrame) -> DataFrame:
    """s1_id, cand_id, sources: the channels that speak for each selected pair."""
    q, t = query_keys.withColumnRenamed("entity_id", "s1_id"), target_keys.select("family", "key", F.col("entity_id").alias("cand_id"))
    chosen = candidates.select("s1_id", "cand_id")
    # Only the keys of chosen pairs meet: first those of the targets, then those of the queries.
    of_target = chosen.join(t, "cand_id")
    return of_target.join(q, ["s1_id", "family", "key"]).groupBy("s1_id", "cand_id").agg(F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("sources"))


# Token strategies.


def equal_values(heads: DataFrame, targets: DataFrame, columns: list[str], guard: str, most: int | None = None) -> DataFrame:
    """s1_id, cand_id: pairs that agree in all the columns. most: with only the first targets of a key, by id, which are the same for all who have it."""
    a, b = heads.where(guard).select(F.col("entity_id").alias("s1_id"), *columns), targets.where(guard).select(F.col("entity_id").alias("cand_id"), *columns)
    if most is not None:
        # The rank is limited before the shuffle and before the join, so a hot key costs a query row no more than most.
        b = b.withColumn("at", F.row_number().over(Window.partitionBy(*columns).orderBy("cand_id"))).where(F.col("at") <= most)
    return a.join(b, columns).select("s1_id", "cand_id")


def shared_tokens(heads: DataFrame, targets: DataFrame, column: str, least: int, cap: int | None = None, most_targets: int | None = None) -> DataFrame:
    """s1_id, cand_id, pos: pairs that share a token of so many characters, and the first place of one in the query's list.

    most_targets: tokens that more targets have are left out, which bounds what a token can cost; by default none is, as the strategies are defined.

    cap: of the soft cap that follows. Once a token's own list has so many targets, later tokens of that query can't count, so they are
    left out before the lists are joined; frequent tokens are then met once a query row at most.
    """
    cut = lambda df, name: df.select(F.col("entity_id").alias(name), F.posexplode(column).alias("pos", "tok")).where(F.length("tok") >= least)
    a = cut(heads, "s1_id").groupBy("s1_id", "tok").agg(F.min("pos").alias("pos"))
    b = cut(targets, "cand_id").select("cand_id", "tok").distinct()
    if most_targets is not None:
        b = b.join(b.groupBy("tok").agg(F.count("*").alias("n")).where(F.col("n") > most_targets).select("tok"), "tok", "left_anti")
    if cap is not None:
        sizes = b.groupBy("tok").agg(F.count("*").alias("n"))
        before = F.max("n").over(Window.partitionBy("s1_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
        a = a.join(sizes, "tok").withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < cap).select("s1_id", "tok", "pos")
    return a.join(b, "tok").groupBy("s1_id", "cand_id").agg(F.min("pos").alias("pos"))


def soft_cap(found: DataFrame, cap: int) -> DataFrame:
    """Whole lists of tokens in order, until so many are found."""
    before = F.sum("n").over(Window.partitionBy("s1_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    open_at = found.groupBy("s1_id", "pos").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < cap)
    return found.join(open_at.select("s1_id", "pos"), ["s1_id", "pos"], "left_semi").select("s1_id", "cand_id")


#: Targets of one key that a task meets.
LOT = 1000


def spread(q: DataFrame, t: DataFrame, keys: list[str]) -> DataFrame:
    """q joined to t on keys. The targets of a key that more than LOT have are dealt into lots, each of which meets the query rows in a task of its own."""
    lots = t.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > LOT).select(*keys, F.ceil(F.col("n") / LOT).cast("int").alias("lots"))
    many = F.coalesce("lots", F.lit(1))
    a = q.join(lots, keys, "left").withColumn("lot", F.explode(F.sequence(F.lit(0), many - 1))).drop("lots")
    b = t.join(lots, keys, "left").withColumn("lot", F.pmod(F.xxhash64("cand_id"), many).cast("int")).drop("lots")
    return a.join(b, [*keys, "lot"]).drop("lot")


def long_tokens(column: str, least: int) -> Column:
    return F.array_distinct(F.filter(column, lambda x: F.length(x) >= least))


def open_tokens(heads: DataFrame, targets: DataFrame, column: str, least: int, cap: int | None = None, weight: str = "1") -> DataFrame:
    """s1_id, tok, pos, earlier, seen: the tokens of query entities whose lists count under the soft cap, which are the first ones. Kept in a table.

    Only the last can have as many targets as the cap (the others would have closed it), so all that is joined to find them are lists shorter than the cap.
    earlier: the tokens before. seen: where the token's own list is as long as the cap, the targets of it that shorter lists have found.
    With a cap also long (whether the list is as long as that), n (its targets) and own (those that no open token before has).
    weight: an expression of how many targets a row stands for.
    """
    a = heads.select(F.col("entity_id").alias("s1_id"), F.posexplode(column).alias("pos", "tok")).where(F.length("tok") >= least).groupBy("s1_id", "tok").agg(F.min("pos").alias("pos"))
    b = targets.select(F.col("entity_id").alias("cand_id"), F.expr(weight).cast("long").alias("w"), F.explode(long_tokens(column, least)).alias("tok"))
    own = Window.partitionBy("s1_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    if cap is None:
        return written(a.select("s1_id", "tok", "pos", F.collect_list("tok").over(own).alias("earlier"), F.array().cast("array<string>").alias("seen")), "open-tokens")
    sizes = b.groupBy("tok").agg(F.sum("w").alias("n"))
    met = written(a.join(sizes, "tok").withColumn("before", F.coalesce(F.max("n").over(own), F.lit(0))).where(F.col("before") < cap).select("s1_id", "tok", "pos", "n"), "met-tokens")
    short = b.join(sizes.where(F.col("n") < cap).select("tok"), "tok")
    found = written(met.where(F.col("n") < cap).join(short, "tok").groupBy("s1_id", "cand_id", "w").agg(F.min("pos").alias("pos")), "short-lists")
    new = found.groupBy("s1_id", "pos").agg(F.sum("w").alias("new"))
    count = F.when(F.col("n") < cap, F.coalesce("new", F.lit(0))).otherwise(F.col("n"))
    open_ = met.join(new, ["s1_id", "pos"], "left").withColumn("before", F.coalesce(F.sum(count).over(own), F.lit(0))).where(F.col("before") < cap)
    open_ = open_.select("s1_id", "tok", "pos", "n", count.alias("count"), F.collect_list("tok").over(own).alias("earlier"))
    twice = found.select("s1_id", "cand_id").join(open_.where(F.col("n") >= cap).select("s1_id", "tok"), "s1_id").join(b, ["cand_id", "tok"])
    out = open_.join(twice.groupBy("s1_id", "tok").agg(F.collect_list("cand_id").alias("seen"), F.sum("w").alias("n_seen")), ["s1_id", "tok"], "left")
    none = F.array().cast("array<string>")
    long = F.col("n") >= cap
    figures = [long.alias("long"), "n", (F.col("count") - F.coalesce("n_seen", F.lit(0))).alias("own")]
    return written(out.select("s1_id", "tok", "pos", F.when(~long, F.col("earlier")).otherwise(none).alias("earlier"), F.coalesce("seen", none).alias("seen"), *figures), "open-tokens")


def token_pairs(open_: DataFrame, targets: DataFrame, toks: str) -> DataFrame:
    """open_ (of open_tokens(), with more columns of query entities) joined to targets (cand_id, the array toks, more): each pair once, by its first shared token.

    Pairs are never brought together to be told apart: each row holds what says whether another token gives it too.
    """
    again = F.when(F.size("earlier") > 0, F.arrays_overlap("earlier", toks)).otherwise(F.lit(False)) | F.when(F.size("seen") > 0, F.array_contains("seen", F.col("cand_id"))).otherwise(F.lit(False))
    return spread(open_, targets.withColumn("tok", F.explode(toks)), ["tok"]).where(~again)


def capped_tokens(heads: DataFrame, targets: DataFrame, column: str, least: int, cap: int) -> DataFrame:
    """s1_id, cand_id: soft_cap() of shared_tokens(), which is what runs where ids repeat."""
    if repeats(heads, "entity_id") or repeats(targets, "entity_id"):
        return soft_cap(shared_tokens(heads, targets, column, least, cap), cap)
    t = targets.select(F.col("entity_id").alias("cand_id"), long_tokens(column, least).alias("toks"))
    return token_pairs(open_tokens(heads, targets, column, least, cap), t, "toks").select("s1_id", "cand_id")


def repeats(df: DataFrame, *columns: str) -> bool:
    """Whether any two rows are equal in these columns."""
    return bool(df.groupBy(*columns).agg(F.count("*").alias("n")).where(F.col("n") > 1).head(1))


@dataclass(frozen=True)
class Strategy:
    """Pairs of a strategy, once each, with all columns of both entities; holds: whether a pair of another strategy, with those columns, is one of its own."""

    name: str
    pairs: DataFrame
    holds: Column


def told_apart(strategies: list[Strategy]) -> list[tuple[str, DataFrame]]:
    """Each strategy's pairs with `new`: whether no strategy before has the pair. What is new of all is their union, without bringing pairs together."""
    out, before = [], F.lit(False)
    for s in strategies:
        out.append((s.name, s.pairs.withColumn("new", ~before)))
        before = before | F.coalesce(s.holds, F.lit(False))
    return out


def pair_stats(strategies: list[Strategy], is_link: Column, totals: DataFrame) -> DataFrame:
    """strategy_stats() by counting each strategy's pairs where they are joined. totals: n_s1, total_links, n_t in one row."""
    truly = F.coalesce(is_link, F.lit(False))
    # A row for each strategy.
    each = [
        p.agg(F.count("*").alias("n"), F.count_if(truly).alias("covered"), F.count_if("new").alias("new"), F.count_if(F.col("new") & truly).alias("new_covered")).withColumn("name", F.lit(name))
        for name, p in told_apart(strategies)
    ]
    counts = reduce(DataFrame.unionByName, each)
    rows = counts.select(F.col("name").alias("strategy"), F.col("n").alias("total_candidates"), "covered").unionByName(
        counts.agg(F.lit("union").alias("strategy"), F.sum("new").alias("total_candidates"), F.sum("new_covered").alias("covered"))
    )
    return _figures(rows.join(totals, how="cross").where("total_candidates > 0"))


#: The columns that all the strategies below are functions of.
ALIKE = ("norm_name", "norm_addr", "norm_country", "country", "link_key")
#: By name: the column of tokens, their least length and the soft cap.
TOKENS: dict[str, tuple[str, int, int | None]] = {"name": ("name_toks", 3, 200), "addr": ("addr_toks", 4, 200), "nums": ("addr_nums", 3, None)}
#: Targets of one country and first token that count.
OF_FIRST = 300


@dataclass(frozen=True)
class KeyTables:
    """What the five strategies by keys select, as tables of entities and not of pairs, whose joins are the pairs.

    heads: a row for each group of query entities alike: s1_id (the least), a (how many), q_ columns, the open tokens q_name, q_addr and q_nums, and of name and addr
    long_ (the open token whose list is as long as the cap), n_ (its targets) and own_ (all targets that the strategy selects). targets: a row for each group of
    targets alike: cand_id, b (how many), b_first (how many of the first OF_FIRST of their country and first token), t_ columns. open_: open_tokens() by name.
    each_head, each_target: entities one by one, with the same columns; there in_first tells whether a target is among those first.
    """

    heads: DataFrame
    targets: DataFrame
    open_: dict[str, DataFrame]
    each_head: DataFrame
    each_target: DataFrame


def key_tables(heads: DataFrame, targets: DataFrame, tokens: Callable[[DataFrame], DataFrame]) -> KeyTables:
    """Of entities that each have an id of their own. tokens: adds name_toks, addr_toks, addr_nums and first, all by ALIKE."""
    a = tokens(heads.groupBy(*ALIKE).agg(F.min("entity_id").alias("entity_id"), F.count("*").alias("a")))
    # The rank is limited before the shuffle.
    at = F.row_number().over(Window.partitionBy("norm_country", "first").orderBy("entity_id"))
    first = tokens(targets).where("first IS NOT NULL").select("entity_id", "norm_country", "first").withColumn("at", at).where(F.col("at") <= OF_FIRST)
    told = targets.join(first.select("entity_id", F.lit(True).alias("in_first")), "entity_id", "left").withColumn("in_first", F.coalesce("in_first", F.lit(False)))
    t_columns = lambda df: df.select("*", *[F.col(c).alias(f"t_{c}") for c in (*ALIKE, "first")], *[long_tokens(c, least).alias(f"t_{n}") for n, (c, least, _) in TOKENS.items()])
    each = written(t_columns(tokens(told)).withColumnRenamed("entity_id", "cand_id").select("cand_id", "in_first", *[f"t_{c}" for c in (*ALIKE, "first", *TOKENS)]), "run-targets")
    alike = [f"t_{c}" for c in (*ALIKE, "first", *TOKENS)]
    b = written(each.groupBy(*[f"t_{c}" for c in ALIKE]).agg(F.min("cand_id").alias("cand_id"), F.count("*").alias("b"), F.count_if("in_first").alias("b_first"), *[F.first(c).alias(c) for c in ("t_first", *[f"t_{n}" for n in TOKENS])]).select("cand_id", "b", "b_first", *alike), "run-target-groups")
    a = written(a, "run-heads")
    plain = b.select(F.col("cand_id").alias("entity_id"), "b", *[F.col(f"t_{n}").alias(c) for n, (c, _, _) in TOKENS.items()])
    open_ = {n: open_tokens(a, plain, *x, weight="b") for n, x in TOKENS.items()}
    rows = a.select(F.col("entity_id").alias("s1_id"), "a", *[F.col(c).alias(f"q_{c}") for c in (*ALIKE, "first")])
    for n, o in open_.items():
        figures = [] if TOKENS[n][2] is None else [F.max(F.when(F.col("long"), F.col("tok"))).alias(f"long_{n}"), F.max(F.when(F.col("long"), F.col("n"))).alias(f"n_{n}"), F.sum("own").alias(f"own_{n}")]
        rows = rows.join(o.groupBy("s1_id").agg(F.collect_list("tok").alias(f"q_{n}"), *figures), "s1_id", "left").withColumn(f"q_{n}", F.coalesce(f"q_{n}", F.array().cast("array<string>")))
    rows = written(rows, "run-head-groups")
    each_head = heads.select(F.col("entity_id").alias("one"), *[F.col(c).alias(f"q_{c}") for c in ALIKE]).join(rows, [f"q_{c}" for c in ALIKE]).drop("s1_id").withColumnRenamed("one", "s1_id")
    return KeyTables(rows, b, open_, each_head, each)


def _held(n: str) -> Column:
    return F.when((F.size(f"q_{n}") > 0) & (F.size(f"t_{n}") > 0), F.arrays_overlap(f"q_{n}", f"t_{n}")).otherwise(F.lit(False))


def _alike(*columns: str) -> Column:
    return F.coalesce(reduce(lambda x, y: x & y, [F.col(f"q_{c}") == F.col(f"t_{c}") for c in columns]), F.lit(False))


def _has(tokens: str, token: str) -> Column:
    return F.when(F.col(token).isNotNull(), F.array_contains(tokens, F.col(token))).otherwise(F.lit(False))


SAME_NAME = lambda: _alike("norm_name") & (F.col("q_norm_name") != "")
IS_LINK = lambda: _alike("country", "link_key") & (F.col("q_link_key") != "")


def _sums(df: DataFrame, *named: tuple[str, Column, Column]) -> DataFrame:
    """strategy, n, covered: for each name the sums of two columns, a row each."""
    return df.agg(F.array(*[F.struct(F.lit(s).alias("strategy"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum(c), F.lit(0)).cast("long").alias("covered")) for s, n, c in named]).alias("rows")).select(F.inline("rows"))


def key_counts(k: KeyTables) -> DataFrame:
    """strategy, n, covered: of exact_name, name_tokens, address_tokens, address_numbers, country_first_token and their union, in parts to be added up.

    The targets of a list as long as the cap, of a name or of a first token are counted and never listed. A union's targets are those in a query entity's two long
    lists, n + n less those in both, which are counted by pairs of tokens; and those that are in neither, which are joined: from short lists, numbers, and, as a shared
    name or first token is a shared name token else, from names and first tokens shorter than a name token. True links are joined by group.
    """
    q, t, zero, no = k.heads, k.targets, F.lit(0), F.lit(False)
    in_long = _has("t_name", "long_name") | _has("t_addr", "long_addr")
    by_name = q.where("q_norm_name <> ''").groupBy(F.col("q_norm_name").alias("x")).agg(F.sum("a").alias("a")).join(t.groupBy(F.col("t_norm_name").alias("x")).agg(F.sum("b").alias("b")), "x")
    by_first = q.where("q_first IS NOT NULL").groupBy(F.col("q_norm_country").alias("x"), F.col("q_first").alias("y")).agg(F.sum("a").alias("a"))
    by_first = by_first.join(t.where("b_first > 0").groupBy(F.col("t_norm_country").alias("x"), F.col("t_first").alias("y")).agg(F.sum("b_first").alias("b")), ["x", "y"])
    own = lambda c: F.col("a") * F.coalesce(c, zero)
    parts = [
        _sums(by_name, ("exact_name", F.col("a") * F.col("b"), zero)),
        _sums(by_first, ("country_first_token", F.col("a") * F.col("b"), zero)),
        _sums(q, ("name_tokens", own("own_name"), zero), ("address_tokens", own("own_addr"), zero), ("union", own("n_name") + own("n_addr"), zero)),
    ]
    wanted = q.where("long_name IS NOT NULL AND long_addr IS NOT NULL").groupBy(F.col("long_name").alias("x"), F.col("long_addr").alias("y")).agg(F.sum("a").alias("a"))
    both = t.select("b", "t_addr", F.explode("t_name").alias("x")).join(wanted.select("x").distinct(), "x").select("b", "x", F.explode("t_addr").alias("y")).join(wanted.select("y").distinct(), "y")
    both = wanted.join(both.groupBy("x", "y").agg(F.sum("b").alias("b")), ["x", "y"])
    parts.append(_sums(both, ("union", -F.col("a") * F.col("b"), zero)))

    pairs, few = F.col("a") * F.col("b"), F.col("a") * F.col("b_first")
    sharing = lambda n, o: token_pairs(o.select("s1_id", "tok", "earlier", "seen").join(q, "s1_id"), t, f"t_{n}")
    if_new = lambda weight, *before: F.when(~reduce(lambda x, y: x | y, before, no), weight).otherwise(0)

    def equal(columns: tuple[str, ...], guard: str, most: str = "true") -> DataFrame:
        on = lambda df, side: df.withColumns({f"on_{c}": F.col(f"{side}_{c}") for c in columns})
        return spread(on(q, "q").where(guard), on(t, "t").where(most), [f"on_{c}" for c in columns])

    parts += [
        _sums(sharing("name", k.open_["name"].where("NOT long")), ("union", if_new(pairs, in_long), zero)),
        _sums(sharing("addr", k.open_["addr"].where("NOT long")), ("union", if_new(pairs, in_long, _held("name")), zero)),
        _sums(sharing("nums", k.open_["nums"]), ("address_numbers", pairs, zero), ("union", if_new(pairs, _held("name"), _held("addr")), zero)),
        _sums(equal(("norm_name",), "q_norm_name <> '' AND size(q_name) = 0"), ("union", if_new(pairs, _held("addr"), _held("nums")), zero)),
        _sums(equal(("norm_country", "first"), f"length(q_first) < {TOKENS['name'][1]}", "b_first > 0"), ("union", if_new(few, _held("name"), _held("addr"), _held("nums"), SAME_NAME()), zero)),
    ]
    flags = {"exact_name": SAME_NAME(), "name_tokens": _held("name"), "address_tokens": _held("addr"), "address_numbers": _held("nums")}
    any_ = reduce(lambda x, y: x | y, flags.values())
    of_first = F.when(_alike("norm_country", "first"), few).otherwise(0)
    links = equal(("country", "link_key"), "q_link_key <> ''")
    parts.append(_sums(links, *[(s, zero, F.when(f, pairs).otherwise(0)) for s, f in flags.items()], ("country_first_token", zero, of_first), ("union", zero, F.when(any_, pairs).otherwise(of_first))))
    return reduce(DataFrame.unionByName, parts)


def pair_counts(k: KeyTables, found: dict[str, DataFrame]) -> DataFrame:
    """strategy, n, covered: of further strategies, given as tables of pairs, and what they add to the union of key_counts()."""
    bit = {s: 1 << i for i, s in enumerate(found)}
    all_ = reduce(DataFrame.unionByName, [df.select("s1_id", "cand_id", F.lit(bit[s]).alias("by")) for s, df in found.items()])
    # Dealt out by query entity, the sum and the join need no other shuffle. Columns that can't tell are left behind.
    pairs = all_.repartition("s1_id").groupBy("s1_id", "cand_id").agg(F.bit_or("by").alias("by"))
    small = {"q_norm_name": F.size("q_name") == 0, "q_norm_country": F.length("q_first") < TOKENS["name"][1], "q_first": F.length("q_first") < TOKENS["name"][1]}
    columns = ["s1_id", "q_name", "q_addr", "q_nums", "q_country", "q_link_key", *[F.when(on, F.col(c)).alias(c) for c, on in small.items()]]
    rows = pairs.join(k.each_head.select(*columns), "s1_id").join(k.each_target, "cand_id")
    held = _held("name") | _held("addr") | _held("nums") | F.coalesce(SAME_NAME(), F.lit(False)) | (_alike("norm_country", "first") & F.col("in_first"))
    told = rows.select("by", IS_LINK().alias("true"), held.alias("held"))
    one = lambda on: F.when(on, 1).otherwise(0)
    return _sums(told, *[(s, one(F.col("by").bitwiseAND(b) != 0), one((F.col("by").bitwiseAND(b) != 0) & F.col("true"))) for s, b in bit.items()], ("union", one(~F.col("held")), one(~F.col("held") & F.col("true"))))


def run_stats(parts: DataFrame, totals: DataFrame) -> DataFrame:
    """strategy_stats() from parts of key_counts() and pair_counts(). totals: n_s1, total_links, n_t in one row."""
    counts = parts.groupBy("strategy").agg(F.sum("n").alias("total_candidates"), F.sum("covered").alias("covered"))
    return _figures(counts.join(totals, how="cross").where("total_candidates > 0"))


def union(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.select("s1_id", "cand_id") for f in found]).distinct()


def token_index(df: DataFrame, column: str) -> DataFrame:
    """tok, n_entities, first_id: the inverted index's lists by size, without gathering them."""
    return df.select("entity_id", F.explode(column).alias("tok")).distinct().groupBy("tok").agg(F.count("*").alias("n_entities"), F.min("entity_id").alias("first_id"))


def strategy_stats(heads: DataFrame, found: DataFrame, true_links: DataFrame, targets: DataFrame, strategies: tuple[str, ...]) -> DataFrame:
    """A row for each strategy that found any pair, and for their union: recall of true links, candidates a query entity, reduction of pairs.

    found: strategy, s1_id, cand_id. Pairs are brought together once, with the strategies that found them, and counted for all.
    """
    bit = reduce(lambda c, s: F.when(F.col("strategy") == s[1], 1 << s[0]).otherwise(c), enumerate(strategies), F.lit(0))
    pairs = found.groupBy("s1_id", "cand_id").agg(F.bit_or(bit).alias("by"))
    true = true_links.select("s1_id", F.col("tid").alias("cand_id"), F.lit(True).alias("true"))
    pairs = pairs.join(true, ["s1_id", "cand_id"], "left").withColumn("true", F.coalesce("true", F.lit(False)))
    one = lambda on, name: F.struct(F.lit(name).alias("strategy"), F.count_if(on).alias("total_candidates"), F.count_if(on & F.col("true")).alias("covered"))
    sums = pairs.agg(F.array(*[one(F.col("by").bitwiseAND(1 << k) != 0, s) for k, s in enumerate(strategies)], one(F.lit(True), "union")).alias("rows"))
    totals = heads.agg(F.count("*").alias("n_s1")).join(true_links.agg(F.count("*").alias("total_links")), how="cross").join(targets.agg(F.count("*").alias("n_t")), how="cross")
    # Sums and totals are one row each.
    return _figures(sums.join(totals, how="cross").select(F.inline("rows"), "n_s1", "total_links", "n_t").where("total_candidates > 0"))


def _figures(counts: DataFrame) -> DataFrame:
    """Of strategy, total_candidates, covered, n_s1, total_links, n_t."""
    return counts.select(
        "strategy",
        F.round(F.when(F.col("total_links") > 0, F.col("covered") / F.col("total_links")).otherwise(1.0), 6).alias("candidate_recall"),
        F.round(F.col("total_candidates") / F.col("n_s1"), 2).alias("mean_candidates"),
        "total_candidates",
        F.round(1 - F.col("total_candidates") / (F.col("n_s1") * F.col("n_t")), 6).alias("reduction_ratio"),
        "n_s1",
        F.col("covered").alias("covered_links"),
        "total_links",
    )


def run_strategies(strategies: dict[str, Callable[[], DataFrame]], path: str, spark: SparkSession, apart: bool = False) -> DataFrame:
    """strategy, s1_id, cand_id of all strategies. Each is written to its own table under path; those that a run before has written whole are read.

    apart: no strategy gives a pair twice, so pairs needn't be brought together before they are written.
    """
    once = (lambda df: df) if apart else DataFrame.distinct
    found = [cached(spark, f"{path}/{name}", lambda make=make: once(make().select("s1_id", "cand_id"))).withColumn("strategy", F.lit(name)) for name, make in strategies.items()]
    return reduce(DataFrame.unionByName, found)
