"""Scored portfolios: checks, summaries and band tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendbook.functions import scorecard as C
from lendbook.functions.exprs import INFINITY, fraction, rank_in

TOLERANCE = 1e-8


def _checks(counted: DataFrame, names: list[str]) -> DataFrame:
    return counted.unpivot([], names, "check", "violations").withColumn(
        "pass", (F.col("violations") == 0).cast("int"))


def math_checks(predictions: DataFrame) -> DataFrame:
    """Scorecard algebra on the PDs at hand: points follow the odds from the base score,
    doubling the odds adds its fixed points, and a higher PD never gains points."""
    pds = predictions.select("predicted_pd").distinct().where(
        F.col("predicted_pd").between(C.PD_FLOOR, 1 - C.PD_FLOOR))
    pd = F.col("predicted_pd")
    odds = (1 - pd) / pd
    doubled = 1 / (1 + odds * 2)
    expected = C.BASE_SCORE + C.POINTS_TO_DOUBLE_ODDS * F.log2(odds / C.BASE_ODDS)
    gain = C.raw_score(doubled) - C.raw_score(pd)
    return _checks(pds.agg(
        F.count_if(F.abs(C.raw_score(pd) - expected) > TOLERANCE).alias("points_follow_odds"),
        F.count_if(F.abs(gain - C.POINTS_TO_DOUBLE_ODDS) > TOLERANCE)
        .alias("double_odds_add_points"),
        F.count_if(C.raw_score(pd * 0.5) <= C.raw_score(pd)).alias("points_fall_with_pd"),
    ), ["points_follow_odds", "double_odds_add_points", "points_fall_with_pd"])


def output_checks(scored: DataFrame) -> DataFrame:
    """Range, finiteness, completeness, band domain and monotonicity of a scored table."""
    low, high = C.SCORE_RANGE
    pd, points = F.col("predicted_pd"), F.col("credit_score")
    simple = scored.agg(
        F.count_if(~F.coalesce(pd.between(0, 1), F.lit(False))).alias("pd_range"),
        F.count_if(~F.coalesce(points.between(low, high), F.lit(False))).alias("score_range"),
        F.count_if(F.abs(points.cast("double")) == INFINITY).alias("score_finite"),
        F.count_if(points.isNull()).alias("score_present"),
        F.count_if(~F.coalesce(F.col("risk_band").isin(C.RISK_LEVELS), F.lit(False)))
        .alias("band_domain"))
    rising = _score_rises(scored)
    names = ["pd_range", "score_range", "score_finite", "score_present", "band_domain"]
    return _checks(simple, names).unionAll(_checks(rising, ["score_monotone"]))


def _score_rises(scored: DataFrame) -> DataFrame:
    """Number of places where a higher score begins although the PD has risen.

    Scores are whole numbers in a fixed range, so grouping by score leaves at most a few
    hundred rows; the PD intervals of the scores must then follow each other downwards.
    """
    intervals = scored.groupBy("credit_score").agg(
        F.min("predicted_pd").alias("from_pd"), F.max("predicted_pd").alias("to_pd"))
    better = Window.orderBy(F.desc("credit_score")).rowsBetween(Window.unboundedPreceding, -1)
    highest_pd = F.max("to_pd").over(better)
    return intervals.select((F.col("from_pd") < highest_pd).alias("broken")).agg(
        F.count_if("broken").alias("score_monotone"))


def score_summary(scored: DataFrame) -> DataFrame:
    """Seven (metric, value) rows. Scores are whole numbers in a fixed range, so the exact
    percentiles keep a few hundred counts."""
    points = F.col("credit_score")
    metrics = {
        "observations": F.count("*").cast("double"),
        "mean_score": fraction(F.sum(points), F.count(points)),
        "median_score": F.percentile(points, F.lit(0.5)),
        "min_score": F.min(points).cast("double"),
        "max_score": F.max(points).cast("double"),
        "score_25th_percentile": F.percentile(points, F.lit(0.25)),
        "score_75th_percentile": F.percentile(points, F.lit(0.75)),
    }
    return scored.agg(*[value.alias(name) for name, value in metrics.items()]).unpivot(
        [], list(metrics), "metric", "value")


def band_summary(scored: DataFrame) -> DataFrame:
    """Applicants, PD, defaults and score per risk band, empty bands kept."""
    filled = scored.groupBy("risk_band").agg(
        F.count("*").alias("applicants"), F.avg("predicted_pd").alias("mean_predicted_pd"),
        F.count_if(F.col("default_flag") == 1).alias("actual_defaults"),
        fraction(F.count_if(F.col("default_flag") == 1), F.count("*"))
        .alias("actual_default_rate"),
        fraction(F.sum("credit_score"), F.count("*")).alias("mean_credit_score"))
    levels = scored.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(level) for level in C.RISK_LEVELS])).alias("risk_band"))
    return levels.join(filled, "risk_band", "left").select(
        "risk_band", F.coalesce("applicants", F.lit(0)).alias("applicants"),
        "mean_predicted_pd", F.coalesce("actual_defaults", F.lit(0)).alias("actual_defaults"),
        "actual_default_rate", "mean_credit_score",
    ).orderBy(rank_in(F.col("risk_band"), C.RISK_LEVELS))


def band_monotone(scored: DataFrame) -> DataFrame:
    """Whether the default rate rises from each filled band to the next riskier one."""
    filled = band_summary(scored).where("applicants > 0").withColumn(
        "position", rank_in(F.col("risk_band"), C.RISK_LEVELS))
    before = F.lag("actual_default_rate").over(Window.orderBy("position"))
    return filled.select((F.col("actual_default_rate") < before).alias("falls")).agg(
        F.count("*").alias("bands"),
        (F.count_if("falls") == 0).cast("int").alias("rises_with_risk"))


def score_histogram(scored: DataFrame, width: int = 10) -> DataFrame:
    start = F.floor(F.col("credit_score") / width) * width
    return scored.groupBy(start.cast("int").alias("score_from")).agg(
        F.count("*").alias("applicants"))
