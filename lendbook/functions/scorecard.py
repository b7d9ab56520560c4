"""Scorecard points, risk bands and monitoring labels as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lendbook.functions.bands import Bands
from lendbook.functions.exprs import clip

# 600 points at odds of 20:1, 50 points double the odds.
BASE_SCORE = 600
BASE_ODDS = 20
POINTS_TO_DOUBLE_ODDS = 50
FACTOR = POINTS_TO_DOUBLE_ODDS / math.log(2)
OFFSET = BASE_SCORE - FACTOR * math.log(BASE_ODDS)
PD_FLOOR = 1e-6
SCORE_RANGE = (300, 850)

# Risk bands by score (upper limits inclusive) and their monitoring.
SCORE_BANDS = Bands(
    (549, 599, 649, 699, 749),
    ("Very High Risk", "High Risk", "Elevated Risk", "Moderate Risk", "Low Risk",
     "Very Low Risk"),
    right=True, null_label=None)
RISK_LEVELS = list(reversed(SCORE_BANDS.labels))
MONITORING = {
    "Routine monitoring": ["Very Low Risk", "Low Risk"],
    "Standard review": ["Moderate Risk"],
    "Enhanced review": ["Elevated Risk", "High Risk", "Very High Risk"],
}


def raw_score(pd: Column) -> Column:
    """Points before limits and rounding."""
    kept = clip(pd, PD_FLOOR, 1 - PD_FLOOR)
    return F.lit(OFFSET) + F.lit(FACTOR) * F.ln((1 - kept) / kept)


def score(pd: Column) -> Column:
    """Whole points: limited to the range first, then rounded half to even."""
    low, high = SCORE_RANGE
    return F.bround(clip(raw_score(pd), float(low), float(high)), 0).cast("int")


def risk_band(points: Column) -> Column:
    return SCORE_BANDS.of(points)


def monitoring_flag(band: Column) -> Column:
    flag = F.lit(None).cast("string")
    for label, members in MONITORING.items():
        flag = F.when(band.isin(members), label).otherwise(flag)
    return flag


def with_score(df, pd_col: str = "predicted_pd"):
    """Add score, band and monitoring label next to a PD column."""
    return (
        df.withColumn("credit_score", score(F.col(pd_col)))
        .withColumn("risk_band", risk_band(F.col("credit_score")))
        .withColumn("risk_monitoring_flag", monitoring_flag(F.col("risk_band")))
    )
