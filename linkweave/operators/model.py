"""Scoring of pairs: rules as columns, gradient-boosted trees, and a round of hard negatives."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.operators import decide


def rule_match(name: float = 0.85, name_tokens: float = 0.80, address_tokens: float = 0.40, numbers: float = 0.50) -> Column:
    """Any of five rules over the 34 features."""
    f = F.col
    return (
        (f("name_exact") >= 1)
        | (f("name_norm_exact") >= 1)
        | ((f("name_wratio") >= name) & (f("country_match") >= 1))
        | ((f("name_token_set") >= name_tokens) & (f("addr_jaccard") >= address_tokens))
        | ((f("name_ratio") >= name) & (f("addr_numeric_overlap") >= numbers))
    )


def rule_score() -> Column:
    return 0.5 * F.col("name_wratio") + 0.2 * F.col("name_token_set") + 0.2 * F.col("addr_jaccard") + 0.1 * F.col("country_match")


#: Rounds at most, as many as elsewhere; rows held out end the fit long before.
ROUNDS, DEPTH, RATE = 600, 5, 0.1
#: Least share by which the error on held-out rows must fall for a fit to go on.
GAIN = 0.005


def fit(labelled: DataFrame, features: list[str], rounds: int = ROUNDS, depth: int = DEPTH, seed: int = 42, validation: Column | None = None) -> PipelineModel:
    """Boosted trees on labelled pairs (label 0 or 1); positives weigh as much in all as negatives. validation marks rows for early stopping."""
    n = labelled.agg(F.sum("label").alias("pos"), F.count("*").alias("n")).first()
    weight = (n.n - n.pos) / n.pos if n.pos else 1.0
    rows = labelled.withColumn("weight", F.when(F.col("label") == 1, F.lit(float(weight))).otherwise(1.0)).withColumn("label", F.col("label").cast("double"))
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=RATE, subsamplingRate=0.85, seed=seed)
    if validation is not None:
        rows = rows.withColumn("held", validation)
        trees = trees.setValidationIndicatorCol("held")
        trees.set(trees.validationTol, GAIN)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), trees]).fit(rows)


def score(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    return model.transform(pairs).select("s1_id", "cand_id", F.round(vector_to_array("probability")[1], 6).alias("score"))


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    found = model.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(features, found), key=lambda x: (-x[1], x[0]))


def hard_negatives(scored: DataFrame, links: DataFrame, least: float, most: int = 200) -> DataFrame:
    """The false pairs with the highest scores over the threshold: a report of a fixed number of rows."""
    false = scored.where(F.col("score") >= least).join(links.select("s1_id", F.col("tid").alias("cand_id")), ["s1_id", "cand_id"], "left_anti")
    return false.orderBy(F.desc("score"), "s1_id", "cand_id").limit(most)


def best_threshold(scored: DataFrame, links: DataFrame, heads: DataFrame) -> tuple[float, float]:
    """The threshold from 0.10 to 0.90 by 0.05 with the highest macro score, the least of equals, and that score."""
    found = decide.best(decide.sweep(scored, links, heads, [round(0.10 + 0.05 * i, 2) for i in range(17)])).first()
    return float(found.least), float(found.macro_f05)


def mined(labelled: DataFrame, features: list[str], links: DataFrame, most: int = 200, rounds: int = ROUNDS) -> tuple[PipelineModel, float, str]:
    """A model fitted with its first version's worst mistakes as more negatives, if that is better on the rows held out, else the first; its threshold and name.

    labelled: s1_id, cand_id, label, features and split, train or val. The mistakes are the most probable false pairs of the part that is learned from.
    """
    held = F.col("split") == "val"
    val = labelled.where(held)
    heads, true = val.select("s1_id").distinct(), links.join(val.select("s1_id").distinct(), "s1_id", "left_semi")
    first = fit(labelled, features, rounds, validation=held)
    least, f05 = best_threshold(score(first, val), true, heads)
    worst = hard_negatives(score(first, labelled.where(~held)), links, least, most).select("s1_id", "cand_id")
    second = fit(labelled.unionByName(labelled.join(F.broadcast(worst), ["s1_id", "cand_id"], "left_semi")), features, rounds, validation=held)
    again, better = best_threshold(score(second, val), true, heads)
    return (second, again, "v2") if better > f05 else (first, least, "v1")


def pattern(features: DataFrame, chosen: DataFrame, columns: list[str]) -> DataFrame:
    """Means of features over chosen pairs, and how many there are."""
    rows = features.join(chosen.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_semi")
    return rows.agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(c).cast("double")), 4).alias(c) for c in columns])


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
