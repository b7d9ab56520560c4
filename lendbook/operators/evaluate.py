"""Evaluation of predicted default probabilities, for any number of models at once.

Predictions are counted per (model, PD) first. Running counts over that table then give every
ranking measure exactly, ties included, without ordering all rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendbook.functions.exprs import INFINITY, fraction
from lendbook.operators.prefix import running_totals, tile

THRESHOLD = 0.50


def with_class(predictions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Add the predicted class: default at or above the threshold."""
    return predictions.withColumn(
        "predicted_class",
        F.when(F.col("predicted_pd") >= threshold, "default").otherwise("non_default"))


def pd_counts(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Defaults and non-defaults per distinct PD; rows without a PD are left out."""
    return predictions.where(F.col("predicted_pd").isNotNull()).groupBy(*by, "predicted_pd").agg(
        F.count_if(F.col("default_flag") == 1).alias("bad"),
        F.count_if(F.col("default_flag") == 0).alias("good"))


def score_counts(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Defaults and non-defaults per distinct PD, with running and overall counts."""
    return running_totals(pd_counts(predictions, by), ["predicted_pd"], ["bad", "good"], list(by))


def _above(name: str) -> Column:
    """Rows with a strictly higher PD."""
    return F.col(f"total_{name}") - F.col(f"cum_{name}")


def _at_or_above(name: str) -> Column:
    return _above(name) + F.col(name)


def _precision(hits: Column, alarms: Column) -> Column:
    """One where nothing is predicted: the curve starts at recall 0, precision 1."""
    return F.coalesce(fraction(hits, hits + alarms), F.lit(1.0))


def _confusion(threshold: float) -> dict[str, Column]:
    flagged = F.col("predicted_pd") >= threshold
    bad, good = F.col("bad"), F.col("good")
    zero = F.lit(0)
    return {
        "tp": F.sum(F.when(flagged, bad).otherwise(zero)),
        "fp": F.sum(F.when(flagged, good).otherwise(zero)),
        "tn": F.sum(F.when(flagged, zero).otherwise(good)),
        "fn": F.sum(F.when(flagged, zero).otherwise(bad)),
    }


def confusion(counts: DataFrame, threshold: float = THRESHOLD,
              by: Sequence[str] = ("model",)) -> DataFrame:
    """(model, statistic, value) with TP, FP, TN and FN."""
    cells = _confusion(threshold)
    wide = counts.groupBy(*by).agg(*[value.alias(name.upper()) for name, value in cells.items()])
    return wide.unpivot(list(by), [name.upper() for name in cells], "statistic", "value")


def threshold_columns(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Class metrics from the four counts; null where a denominator is zero."""
    precision, recall = fraction(tp, tp + fp), fraction(tp, tp + fn)
    return {
        "accuracy": fraction(tp + tn, tp + fp + tn + fn),
        "precision": precision,
        "recall": recall,
        "specificity": fraction(tn, tn + fp),
        "f1": F.try_divide(2 * precision * recall, precision + recall),
    }


def _squared_miss() -> Column:
    """Squared distance of PD and outcome, summed over the rows of a distinct PD."""
    pd = F.col("predicted_pd")
    miss = F.lit(1.0) - pd
    return F.col("bad") * miss * miss + F.col("good") * pd * pd


def at_threshold(counts: DataFrame, threshold: float = THRESHOLD,
                 by: Sequence[str] = ("model",)) -> DataFrame:
    """Brier score and class metrics, which need no order of the PDs."""
    sums = counts.groupBy(*by).agg(
        F.sum(F.col("bad") + F.col("good")).alias("rows"), F.sum(_squared_miss()).alias("squared"),
        *[value.alias(name) for name, value in _confusion(threshold).items()])
    cells = threshold_columns(*[F.col(name) for name in ("tp", "fp", "tn", "fn")])
    return sums.select(
        *by, F.try_divide(F.col("squared"), F.col("rows")).alias("brier_score"),
        *[value.alias(name) for name, value in cells.items()],
        F.lit(threshold).alias("threshold"))


def evaluate(counts: DataFrame, threshold: float = THRESHOLD,
             by: Sequence[str] = ("model",)) -> DataFrame:
    """All metrics per model from one pass over the counted predictions."""
    bad, good = F.col("bad"), F.col("good")
    total_bad, total_good = F.col("total_bad"), F.col("total_good")
    # Pairs in which the default has the higher PD, ties as half, doubled to stay whole.
    pairs = F.sum((good.cast("decimal(18,0)")
                   * (_above("bad") * 2 + bad).cast("decimal(19,0)")).cast("decimal(38,0)"))
    step = fraction(bad, total_bad) * (
        _precision(_at_or_above("bad"), _at_or_above("good"))
        + _precision(_above("bad"), _above("good"))) / 2
    gap = F.abs(fraction(F.col("cum_bad"), total_bad)
                - fraction(F.col("cum_good"), total_good))
    sums = counts.groupBy(*by).agg(
        pairs.alias("pairs"), F.max(total_bad).alias("p"), F.max(total_good).alias("n"),
        F.sum(step).alias("pr_auc"), F.max(gap).alias("ks"),
        F.sum(_squared_miss()).alias("squared"),
        *[value.alias(name) for name, value in _confusion(threshold).items()])
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    auc = F.try_divide(F.col("pairs").cast("double"), p * n * 2)
    cells = threshold_columns(*[F.col(name) for name in ("tp", "fp", "tn", "fn")])
    return sums.select(
        *by, auc.alias("roc_auc"), "pr_auc", (auc * 2 - 1).alias("gini"), "ks",
        F.try_divide(F.col("squared"), p + n).alias("brier_score"),
        *[value.alias(name) for name, value in cells.items()],
        F.lit(threshold).alias("threshold"))


def _ends(counts: DataFrame, by: Sequence[str], rows: list[tuple]) -> DataFrame:
    """Curve end points for every model."""
    models = counts.select(*by).distinct()
    points = F.array(*[F.struct(*[F.lit(v).alias(f"_{i}") for i, v in enumerate(row)])
                       for row in rows])
    return models.select(*by, F.explode(points).alias("end")).select(*by, "end.*")


def roc_curve(counts: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """(model, threshold, specificity, sensitivity), a row flagged at PD >= threshold."""
    points = counts.select(
        *by, F.col("predicted_pd").alias("threshold"),
        fraction(F.col("cum_good") - F.col("good"), F.col("total_good")).alias("specificity"),
        fraction(_at_or_above("bad"), F.col("total_bad")).alias("sensitivity"))
    ends = _ends(counts, by, [(-INFINITY, 0.0, 1.0), (INFINITY, 1.0, 0.0)])
    return points.unionAll(ends)


def pr_curve(counts: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """(model, threshold, recall, precision), starting at recall 0 and precision 1."""
    hits, alarms = _at_or_above("bad"), _at_or_above("good")
    points = counts.select(
        *by, F.col("predicted_pd").alias("threshold"),
        fraction(hits, F.col("total_bad")).alias("recall"),
        _precision(hits, alarms).alias("precision"))
    return points.unionAll(_ends(counts, by, [(INFINITY, 0.0, 1.0)]))


def calibration(predictions: DataFrame, bins: int = 10, key: str = "application_id",
                by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean PD against observed rate in equally filled bins of PD; ties follow the key.

    Rows without a PD are left out.
    """
    rows = predictions.where(F.col("predicted_pd").isNotNull()).select(*by, key, "predicted_pd", "default_flag", F.lit(1).alias("row"))
    ranked = running_totals(rows, ["predicted_pd", key], ["row"], list(by))
    return (
        ranked.groupBy(*by, tile(F.col("cum_row"), F.col("total_row"), bins).alias("bin"))
        .agg(F.avg("predicted_pd").alias("mean_predicted_probability"),
             fraction(F.count_if(F.col("default_flag") == 1), F.count("*"))
             .alias("actual_default_rate"),
             F.count("*").alias("observations"))
    )


METRICS = ["roc_auc", "pr_auc", "gini", "ks", "brier_score", "accuracy", "precision", "recall",
           "specificity", "f1"]
