"""Exact ranking metrics per group, ties included, and the gap between two kinds of folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges that scores are dealt into; scores outside 0 to 1 fall into the first or last.
RANGES = 1024
#: Fixed value: the opening words of the message.
NOTHING_SCORED = "No fold contained both classes"


def _scores(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each distinct score of a group, with its range: positives and rows at it, summed map-side."""
    found = rows.groupBy(*by, "score").agg(F.sum(F.col("y").cast("bigint")).alias("tp"), F.count(F.lit(1)).alias("n"))
    span = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")) * (RANGES - 1)).cast("int")
    return found.withColumn("span", span)


def _running(scores: DataFrame, by: list[str], upward: bool, **sums: Column) -> DataFrame:
    """``scores`` with each of ``sums`` over the scores before a row's own. They run within a range of scores and go on from the totals
    of the ranges before, so that no group is walked by one task."""
    order = (lambda c: F.col(c).asc()) if upward else (lambda c: F.col(c).desc())
    totals = scores.groupBy(*by, "span").agg(*[F.sum(c).alias(f"{name}_total") for name, c in sums.items()])
    before = Window.partitionBy(*by).orderBy(order("span")).rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    totals = totals.select(*by, "span", *[F.coalesce(F.sum(f"{name}_total").over(before), F.lit(0)).alias(f"{name}_start") for name in sums])
    within = Window.partitionBy(*by, "span").orderBy(order("score")).rowsBetween(Window.unboundedPreceding, -1)
    met = scores.withColumns({name: F.coalesce(F.sum(c).over(within), F.lit(0)) for name, c in sums.items()}).join(totals, [*by, "span"])
    return met.withColumns({name: F.col(name) + F.col(f"{name}_start") for name in sums}).drop(*[f"{name}_start" for name in sums])


def auroc(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, auroc) of ``rows`` (y, score); groups with one class are left out. Ties count half."""
    ranked = _running(_scores(rows, by), by, True, lower=F.col("n") - F.col("tp"))
    won = F.sum(F.col("tp") * (F.col("lower") + (F.col("n") - F.col("tp")) / 2.0))
    total = ranked.groupBy(*by).agg(won.alias("won"), F.sum("tp").alias("p"), F.sum(F.col("n") - F.col("tp")).alias("q"))
    return total.where("p > 0 and q > 0").select(*by, (F.col("won") / (F.col("p") * F.col("q"))).alias("auroc"))


def average_precision(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, ap): the step sum of precision over recall, at each distinct score from the top."""
    ranked = _running(_scores(rows, by), by, False, above_tp=F.col("tp"), above_n=F.col("n"))
    gain = F.col("tp") * (F.col("above_tp") + F.col("tp")) / (F.col("above_n") + F.col("n"))
    total = ranked.groupBy(*by).agg(F.sum(gain).alias("s"), F.sum("tp").alias("p"), F.sum("n").alias("n"))
    return total.where("p > 0 and p < n").select(*by, (F.col("s") / F.col("p")).alias("ap"))


def fold_scores(rows: DataFrame, by: list[str]) -> DataFrame:
    return auroc(rows, by).join(average_precision(rows, by), by)


def compare(rows: DataFrame) -> DataFrame:
    """Means over scored folds of ``rows`` (kind: random or spatial, fold, y, score) side by side, and their gap."""
    scored = fold_scores(rows, ["kind", "fold"])
    if not scored.limit(1).count():
        raise ValueError(f"{NOTHING_SCORED} among its training and its test rows, so there is no score to compare")
    means = scored.groupBy("kind").agg(F.avg("auroc").alias("auroc_mean"), F.stddev_pop("auroc").alias("auroc_std"), F.avg("ap").alias("pr_auc_mean"), F.count(F.lit(1)).alias("folds"))
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    wide = [pick(kind, c).alias(f"{kind}_{c}") for kind in ("random", "spatial") for c in ("auroc_mean", "auroc_std", "pr_auc_mean", "folds")]
    return means.agg(*wide).withColumn("auroc_gap", F.col("random_auroc_mean") - F.col("spatial_auroc_mean"))
