"""Macro F-beta and its kin, candidate recall, distributions and the forensics of missed links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BETA_SQUARED = 0.25


def with_scores(df: DataFrame, empty_precision: float = 1.0) -> DataFrame:
    """precision, recall and f from tp, np (predicted) and nt (true). empty_precision: of no prediction where there are links."""
    tp, np_, nt = F.col("tp"), F.col("np"), F.col("nt")
    both_empty = (np_ == 0) & (nt == 0)
    p = F.when(both_empty, 1.0).when(np_ == 0, empty_precision).otherwise(tp / np_)
    r = F.when(nt == 0, 1.0).otherwise(tp / nt)
    out = df.withColumns({"precision": p, "recall": r})
    denominator = BETA_SQUARED * F.col("precision") + F.col("recall")
    f = F.when((F.col("np") == 0) & (F.col("nt") > 0), 0.0).when(denominator > 0, (1 + BETA_SQUARED) * F.col("precision") * F.col("recall") / denominator).otherwise(0.0)
    return out.withColumn("f", f)


def entity_scores(heads: DataFrame, predicted: DataFrame, links: DataFrame, empty_precision: float = 1.0) -> DataFrame:
    """A row for each query entity (s1_id): np, nt, tp, precision, recall, f. Repeated predictions count once."""
    p = predicted.select("s1_id", F.col("cand_id").alias("tid")).distinct()
    t = links.select("s1_id", "tid").distinct()
    np_ = p.groupBy("s1_id").agg(F.count("*").alias("np"))
    nt = t.groupBy("s1_id").agg(F.count("*").alias("nt"))
    tp = p.join(t, ["s1_id", "tid"], "left_semi").groupBy("s1_id").agg(F.count("*").alias("tp"))
    out = heads.select("s1_id").join(np_, "s1_id", "left").join(nt, "s1_id", "left").join(tp, "s1_id", "left").fillna(0, ["np", "nt", "tp"])
    return with_scores(out, empty_precision)


def macro(scores: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return scores.agg(mean("precision").alias("precision"), mean("recall").alias("recall"), mean("f").alias("f05"), F.count("*").alias("n_entities"))


def singletons(scores: DataFrame) -> DataFrame:
    single = F.col("nt") == 0
    n, right = F.count_if(single), F.count_if(single & (F.col("np") == 0))
    return scores.agg(n.alias("n_singletons"), right.alias("n_correct"), (n - right).alias("n_false_merges"), F.when(n > 0, F.round(right / n, 6)).alias("accuracy"))


def match_distribution(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.round(F.avg("np"), 2).alias("avg_matches"),
        F.max("np").alias("max_matches"),
        F.round(F.percentile("np", 0.5), 1).alias("p50_matches"),
        F.round(F.percentile("np", 0.95), 1).alias("p95_matches"),
        F.count_if(F.col("np") > 11).alias("entities_over_11"),
    )


def candidate_recall(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """Links that the candidates cover; recall is 1 if there are none."""
    found = links.select("s1_id", "tid").join(candidates.select("s1_id", F.col("cand_id").alias("tid"), F.lit(1).alias("hit")).distinct(), ["s1_id", "tid"], "left")
    n, hit = F.count("*"), F.count("hit")
    return found.agg(
        n.alias("total_links"),
        hit.alias("covered_links"),
        (n - hit).alias("missing_links"),
        F.count_distinct("s1_id").alias("entities_with_links"),
        F.round(F.when(n > 0, hit / n).otherwise(1.0), 6).alias("recall"),
    )


def recall_by_version(found: DataFrame, links: DataFrame, versions: tuple[str, ...]) -> DataFrame:
    """A row for each version: links, those that its candidates cover, and the share. found: version, s1_id, cand_id."""
    hits = found.join(links.select("s1_id", F.col("tid").alias("cand_id")), ["s1_id", "cand_id"], "left_semi").groupBy("version").agg(F.count("*").alias("hit"))
    names = found.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(f"('{v}')" for v in versions)} AS t(version)")
    total = links.agg(F.count("*").alias("total_links"))
    # Names and total are a few rows.
    rows = names.join(hits, "version", "left").join(F.broadcast(total), how="cross").withColumn("hit", F.coalesce("hit", F.lit(0)))
    share = F.when(F.col("total_links") > 0, F.col("hit") / F.col("total_links")).otherwise(1.0)
    return rows.select("version", "total_links", F.col("hit").alias("covered_links"), (F.col("total_links") - F.col("hit")).alias("missing_links"), F.round(share, 6).alias("recall"))


def candidate_distribution(assembled: DataFrame, n_targets: DataFrame) -> DataFrame:
    """Candidates a query entity, those without any included. assembled: s1_id, cands; n_targets: one row, n."""
    sizes = assembled.select(F.size("cands").alias("n_c"))
    out = sizes.agg(
        F.sum("n_c").alias("candidates"), F.round(F.avg("n_c"), 2).alias("avg_c"), F.percentile("n_c", 0.5).alias("p50_c"), F.percentile("n_c", 0.95).alias("p95_c"), F.max("n_c").cast("long").alias("max_c"), F.count("*").alias("n_s1")
    )
    ratio = F.round(1 - F.col("candidates") / (F.col("n_s1") * F.col("n")), 8).alias("reduction_ratio")
    return out.join(F.broadcast(n_targets), how="cross").select("candidates", "avg_c", "p50_c", "p95_c", "max_c", ratio)


def marginal_gains(recovered: DataFrame) -> DataFrame:
    """recovered: step (order), strategy, links_recovered, total; with recall and what each adds to the one before."""
    before = F.coalesce(F.lag("links_recovered").over(Window.orderBy("step")), F.lit(0))
    out = recovered.withColumn("marginal_links", F.col("links_recovered") - before)
    share = lambda c: F.round(F.col(c) / F.col("total"), 4)
    return out.select("step", "strategy", "links_recovered", share("links_recovered").alias("recall"), "marginal_links", share("marginal_links").alias("marginal_recall"))


def _common(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b))


# Outcomes of a link by whether the older set holds it (1), the newer (2) or both (3), each with its category, and categories of links that neither holds.
OUTCOMES = (("STILL_MISSED", ""), ("REGRESSED_IN_V6", "Regression"), ("RECOVERED_BY_V6", "Recovered"), ("RETAINED_BOTH", "Both"))
MISSED = (
    "Country Mismatch",
    "Missing Name",
    "Zero Token Overlap / Severe Distortion",
    "Single Weak Token Overlap (<2 tokens)",
    "Quota Exceeded / Truncated Beyond Cap",
)


def miss_forensics(links: DataFrame, old: DataFrame, new: DataFrame, heads: DataFrame, targets: DataFrame) -> DataFrame:
    """Each true link by whether two candidate sets hold it, and why neither does. Sides: entity_id, norm_country, business_name, tokens."""
    side = lambda df, key, p: df.select(F.col("entity_id").alias(key), *[F.col(c).alias(p + c) for c in ("norm_country", "business_name", "tokens")])
    held = lambda df, name: df.select("s1_id", F.col("cand_id").alias("tid"), F.lit(True).alias(name)).distinct()
    rows = links.select("s1_id", "tid").join(held(old, "in_old"), ["s1_id", "tid"], "left").join(held(new, "in_new"), ["s1_id", "tid"], "left").fillna(False, ["in_old", "in_new"])
    rows = rows.join(side(heads, "s1_id", "a_"), "s1_id", "left").join(side(targets, "tid", "b_"), "tid", "left")
    common = _common("a_tokens", "b_tokens")
    missed = (
        F.when(F.col("a_norm_country") != F.col("b_norm_country"), MISSED[0])
        .when((F.col("a_business_name") == "") | (F.col("b_business_name") == ""), MISSED[1])
        .otherwise(F.when(common == 0, MISSED[2]).when(common == 1, MISSED[3]).otherwise(MISSED[4]))
    )
    both = F.col("in_old").cast("int") + 2 * F.col("in_new").cast("int")
    status, why = (F.element_at(F.array(*[F.lit(x[k]) for x in OUTCOMES]), both + 1) for k in (0, 1))
    why = F.when(both == 0, missed).otherwise(why)
    return rows.select("s1_id", "tid", "in_old", "in_new", status.alias("status"), why.alias("category"))


def tier_misses(links: DataFrame, found: DataFrame, heads: DataFrame, targets: DataFrame) -> DataFrame:
    """Each true link by whether the tiers hold it; causes in another order, on the raw target name's tokens."""
    raw = F.filter(F.split(F.lower("business_name"), " "), lambda w: w != "")
    a = heads.select(F.col("entity_id").alias("s1_id"), F.col("tokens").alias("a_tokens"), F.col("norm_country").alias("a_country"))
    b = targets.select(F.col("entity_id").alias("tid"), raw.alias("b_tokens"), F.col("business_name").alias("b_name"), F.col("norm_country").alias("b_country"))
    hit = found.select("s1_id", F.col("cand_id").alias("tid"), F.lit(True).alias("hit")).distinct()
    rows = links.select("s1_id", "tid").join(hit, ["s1_id", "tid"], "left").join(a, "s1_id", "left").join(b, "tid", "left")
    common = _common("a_tokens", "b_tokens")
    why = (
        F.when(F.col("hit"), "recovered").when(F.col("b_name") == "", "empty target name").when(common == 0, "no common token").when(common == 1, "one common token")
        .when(F.col("a_country") != F.col("b_country"), "country mismatch").otherwise("beyond quota")
    )
    return rows.select("s1_id", "tid", F.substring("tid", 1, 2).alias("source"), F.when(F.col("hit"), "RECOVERED").otherwise("MISSED").alias("status"), why.alias("category"))


def recall_by_channel(links: DataFrame, query_keys: DataFrame, target_keys: DataFrame) -> DataFrame:
    """channel, links_found: the true links whose entities share a key of the channel."""
    q = query_keys.select(F.col("entity_id").alias("s1_id"), "channel", "family", "key")
    t = target_keys.select(F.col("entity_id").alias("tid"), "family", "key")
    met = links.select("s1_id", "tid").join(q, "s1_id").join(t, ["tid", "family", "key"]).select("s1_id", "tid", "channel").distinct()
    return met.groupBy("channel").agg(F.count("*").alias("links_found"))


def score_profile(scored: DataFrame, links: DataFrame, least: float) -> DataFrame:
    """Distribution of scores by outcome: TP, FP, FN (a true pair under the threshold)."""
    rows = scored.join(links.select("s1_id", F.col("tid").alias("cand_id"), F.lit(True).alias("true")), ["s1_id", "cand_id"], "left")
    kind = F.when(F.col("score") >= least, F.when(F.col("true"), "TP").otherwise("FP")).when(F.col("true"), "FN")
    q = lambda x: F.round(F.percentile("score", x), 4)
    return (
        rows.withColumn("category", kind).where("category IS NOT NULL").groupBy("category").agg(
            F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"), F.round(F.stddev_pop("score"), 4).alias("std"), F.round(F.min("score"), 4).alias("min"),
            q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), F.round(F.max("score"), 4).alias("max"),
        )
    )


def report(scores: DataFrame) -> DataFrame:
    """One row: macro scores, singletons and totals."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    single = F.col("nt") == 0
    return scores.agg(
        mean("precision").alias("precision"), mean("recall").alias("recall"), mean("f").alias("f05"), F.count("*").alias("n_entities"), F.count_if(single).alias("n_singletons"),
        F.count_if(single & (F.col("np") == 0)).alias("n_correct"), F.sum("np").alias("n_predicted"), F.sum("nt").alias("n_links"), F.sum("tp").alias("n_true"),
    )
