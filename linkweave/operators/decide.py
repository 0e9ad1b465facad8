"""From scored pairs to decisions: thresholds, singleton gates, score gaps and caps, and searches over their settings."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkweave.operators import evaluate as E

# The settings that searches go through.
GATES = (0.65, 0.70, 0.75, 0.80, 0.85, 0.88, 0.90)
THRESHOLDS = (0.55, 0.60, 0.64, 0.70, 0.75)
GAPS = (0.10, 0.15, 0.20, 0.25)
CAPS = (8, 10, 11)


# Settings of the strategies that are compared beside a bare threshold.
STRATEGY_GAPS = (0.10, 0.15, 0.20)
STRATEGY_CAPS = (4, 6, 8)
STRATEGY_BONUSES = (0.02, 0.05)


def ranked(scored: DataFrame) -> DataFrame:
    """scored (s1_id, cand_id, score) with top, the best score of its query entity, and rank; ties go by id."""
    best_first = Window.partitionBy("s1_id").orderBy(F.desc("score"), "cand_id")
    return scored.withColumns({"top": F.max("score").over(Window.partitionBy("s1_id")), "rank": F.row_number().over(best_first)})


def threshold(scored: DataFrame, least: float) -> DataFrame:
    return scored.where(F.col("score") >= least).select("s1_id", "cand_id", "score")


def decide(scored: DataFrame, least: float = 0.64, gate: float = 0.80, gap: float = 0.20, cap: int = 11) -> DataFrame:
    """None if the best score is under the gate; else those over the threshold and within the gap, the best of them up to the cap."""
    chosen = ranked(scored).where((F.col("top") >= gate) & (F.col("score") >= least) & (F.col("top") - F.col("score") <= gap))
    return chosen.where(F.col("rank") <= cap).select("s1_id", "cand_id", "score")


def score_gap(scored: DataFrame, least: float, gap: float) -> DataFrame:
    return decide(scored, least, least, gap, 2**31 - 1)


def match_cap(scored: DataFrame, least: float, cap: int) -> DataFrame:
    """The best few, and then those over the threshold."""
    return ranked(scored).where((F.col("rank") <= cap) & (F.col("score") >= least)).select("s1_id", "cand_id", "score")


def singleton_gate(scored: DataFrame, least: float, bonus: float) -> DataFrame:
    return ranked(scored).where((F.col("top") >= least + bonus) & (F.col("score") >= least)).select("s1_id", "cand_id", "score")


def settings(spark: SparkSession, gates=GATES, thresholds=THRESHOLDS, gaps=GAPS, caps=CAPS) -> DataFrame:
    """A row for each setting with a threshold no higher than its gate, numbered in order."""
    rows = [(g, t, d, k) for g, t, d, k in product(gates, thresholds, gaps, caps) if t <= g]
    values = ", ".join(f"({i}, {g}D, {t}D, {d}D, {k})" for i, (g, t, d, k) in enumerate(rows))
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(setting, gate, least, gap, cap)")


def search(scored: DataFrame, links: DataFrame, heads: DataFrame, grid: DataFrame, empty_precision: float = 0.0, digits: int = 4) -> DataFrame:
    """Macro scores of every setting, in one job. empty_precision: of no decision where there are links.

    A query entity's ranked pairs, as many as its candidates, are folded into one row once; each setting counts its true and predicted ones there, so the
    only rows that are shuffled again are sums by setting. Entities without any decision are added from their number.
    """
    pairs = ranked(scored).join(links.select("s1_id", F.col("tid").alias("cand_id"), F.lit(True).alias("true")), ["s1_id", "cand_id"], "left")
    folded = pairs.groupBy("s1_id").agg(F.max("top").alias("top"), F.collect_list(F.struct("score", "rank", F.coalesce("true", F.lit(False)).alias("true"))).alias("pairs"))
    # The grid is a few hundred rows by construction.
    met = folded.join(F.broadcast(grid), F.col("top") >= F.col("gate"))
    fits = lambda p: (p["score"] >= F.col("least")) & (F.col("top") - p["score"] <= F.col("gap")) & (p["rank"] <= F.col("cap"))
    chosen = met.select("setting", "s1_id", F.filter("pairs", fits).alias("chosen")).where(F.size("chosen") > 0)
    counts = chosen.select("setting", "s1_id", F.size("chosen").cast("long").alias("np"), F.size(F.filter("chosen", lambda p: p["true"])).cast("long").alias("tp"))
    truth = links.groupBy("s1_id").agg(F.count("*").alias("nt"))
    scored_rows = E.with_scores(counts.join(truth, "s1_id", "left").withColumn("nt", F.coalesce("nt", F.lit(0))), empty_precision)
    sums = scored_rows.groupBy("setting").agg(
        F.sum("precision").alias("p"), F.sum("recall").alias("r"), F.sum("f").alias("f"), F.count("*").alias("n"), F.sum(F.when(F.col("nt") == 0, 1).otherwise(0)).alias("false_merges"), F.sum("np").alias("np"), F.max("np").alias("most")
    )
    all_n = heads.select("s1_id").join(truth, "s1_id", "left").agg(F.count("*").alias("n_all"), F.sum(F.when(F.col("nt").isNull(), 1).otherwise(0)).alias("n_single"))
    out = grid.join(sums, "setting", "left").join(F.broadcast(all_n), how="cross").fillna(0, ["p", "r", "f", "n", "false_merges", "np", "most"])
    # Entities without decisions: right if single (all 1), else missed (all 0, but for precision by convention).
    right = F.col("n_single") - F.col("false_merges")
    missed = F.col("n_all") - F.col("n_single") - (F.col("n") - F.col("false_merges"))
    mean = lambda c, more=0.0: F.round((F.col(c) + right + more) / F.col("n_all"), digits)
    return out.select(
        "setting", "gate", "least", "gap", "cap",
        mean("f").alias("macro_f05"), mean("p", missed * empty_precision).alias("precision"), mean("r").alias("recall"),
        F.round(F.when(F.col("n_single") > 0, right / F.col("n_single")).otherwise(1.0), digits).alias("singleton_accuracy"),
        F.col("false_merges").cast("long").alias("false_merges"),
        F.round(F.col("np") / F.col("n_all"), 2).alias("avg_predicted"), F.col("most").cast("long").alias("max_predicted"),
    )


def best(found: DataFrame) -> DataFrame:
    """The setting with the highest score, the first of equals."""
    return found.orderBy(F.desc("macro_f05"), "setting").limit(1)


def sweep(scored: DataFrame, links: DataFrame, heads: DataFrame, thresholds: list[float]) -> DataFrame:
    """Thresholds alone, with nothing else held against a pair."""
    values = ", ".join(f"({i}, {t}D, {t}D, 10D, 2147483647)" for i, t in enumerate(thresholds))
    grid = scored.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(setting, gate, least, gap, cap)")
    return search(scored, links, heads, grid).drop("gate", "gap", "cap")


def strategies(spark: SparkSession, least: float) -> DataFrame:
    """setting, strategy, gate, least, gap, cap: the bare threshold and each strategy beside it, in order."""
    any_gap, any_cap = 10.0, 2**31 - 1
    named = {"pure threshold": (least, any_gap, any_cap)}
    named |= {f"score gap {d}": (least, d, any_cap) for d in STRATEGY_GAPS}
    named |= {f"match cap {k}": (least, any_gap, k) for k in STRATEGY_CAPS}
    named |= {f"singleton gate {b}": (least + b, any_gap, any_cap) for b in STRATEGY_BONUSES}
    values = ", ".join(f"({i}, '{name}', {gate}D, {least}D, {gap}D, {cap})" for i, (name, (gate, gap, cap)) in enumerate(named.items()))
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(setting, strategy, gate, least, gap, cap)")


def compare(scored: DataFrame, links: DataFrame, heads: DataFrame, least: float) -> DataFrame:
    """Scores of the bare threshold and of each strategy beside it, by name: settings of one search."""
    grid = strategies(scored.sparkSession, least)
    found = search(scored, links, heads, grid.drop("strategy"), 1.0, 6)
    return found.join(grid.select("setting", "strategy"), "setting").select("strategy", F.col("macro_f05").alias("f05"), "precision", "recall", "singleton_accuracy")


def best_strategy(scored: DataFrame, links: DataFrame, heads: DataFrame, least: float) -> DataFrame:
    """One row: the strategy with the highest score, the first of equals, with its setting."""
    grid = strategies(scored.sparkSession, least)
    found = best(search(scored, links, heads, grid.drop("strategy"), 1.0, 6)).select("setting", F.col("macro_f05").alias("f05"))
    return grid.join(F.broadcast(found), "setting")


def dispatch(scored: DataFrame, chosen: DataFrame) -> DataFrame:
    """s1_id, cand_id, score, strategy: the decisions by the one setting that chosen holds."""
    met = ranked(scored).join(F.broadcast(chosen.select("strategy", "gate", "least", "gap", "cap")), F.col("top") >= F.col("gate"))
    fits = (F.col("score") >= F.col("least")) & (F.col("top") - F.col("score") <= F.col("gap")) & (F.col("rank") <= F.col("cap"))
    return met.where(fits).select("s1_id", "cand_id", "score", "strategy")
