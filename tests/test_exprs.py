from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lendbook.functions import exprs as X
from lendbook.functions.bands import DASHBOARD, PORTFOLIO
from lendbook.functions.pvalues import chi_square_tail, normal_two_sided


def one(spark, column, **values):
    schema = ", ".join(f"{name} {kind}" for name, (kind, _) in values.items())
    frame = spark.createDataFrame([tuple(v for _, v in values.values())], schema)
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("a, b, expected", [
    (1, 3, 33.33), (2, 3, 66.67), (1, 800, 0.13), (5, 0, None), (0, 7, 0.0), (7, 7, 100.0)])
def test_percent_rounds_half_up(spark, a, b, expected):
    # 1/800 is 0.125 percent exactly: half-up, not half-even
    assert one(spark, X.percent(F.col("a"), F.col("b")), a=("long", a), b=("long", b)) == expected


def test_ratio_rounded_takes_negative_decimals(spark):
    value = X.ratio_rounded(F.col("a"), F.col("b"))
    kind = "decimal(28,2)"
    assert one(spark, value, a=(kind, Decimal("-0.25")), b=(kind, Decimal("10"))) == -0.03


@pytest.mark.parametrize("a, b, expected", [
    (1.0, 4.0, 0.25), (1.0, 0.0, None), (None, 2.0, None), (1.0, None, None),
    (float("inf"), 2.0, None), (float("nan"), 2.0, None)])
def test_safe_ratio(spark, a, b, expected):
    got = one(spark, X.safe_ratio(F.col("a"), F.col("b")), a=("double", a), b=("double", b))
    assert got == expected


def test_zero_ratio_is_zero_without_denominator(spark):
    assert one(spark, X.zero_ratio(F.col("a"), F.col("b")), a=("double", 1.0),
               b=("double", None)) == 0.0


def test_clip_keeps_null(spark):
    clipped = X.clip(F.col("a"), 0.0, 1.0)
    assert one(spark, clipped, a=("double", None)) is None
    assert one(spark, clipped, a=("double", 7.0)) == 1.0


@pytest.mark.parametrize("score, label", [
    (None, "Unknown"), (549, "<550"), (550, "550-649"), (649, "550-649"), (650, "650-699"),
    (700, "700-749"), (749, "700-749"), (750, "750+")])
def test_bureau_band_edges(spark, score, label):
    band = PORTFOLIO["bureau_score_band"].of(F.col("a"))
    assert one(spark, band, a=("int", score)) == label


@pytest.mark.parametrize("dti, label", [
    ("0.199", "<20%"), ("0.200", "20%-34.99%"), ("0.350", "35%-49.99%"), ("0.500", "50%+")])
def test_dti_band_edges(spark, dti, label):
    band = PORTFOLIO["dti_band"].of(F.col("a"))
    assert one(spark, band, a=("decimal(6,3)", Decimal(dti))) == label


@pytest.mark.parametrize("amount, revenue, label", [
    ("45.45", "303.00", "15%-24.99%"),  # exactly 15 percent, awkward in binary
    ("45.44", "303.00", "<15%"), ("1.00", "0.00", "Unknown"), ("1.00", None, "Unknown"),
    ("40.00", "100.00", "40%+")])
def test_ratio_band_is_exact_on_its_cut(spark, amount, revenue, label):
    kind = "decimal(18,2)"
    band = PORTFOLIO["loan_to_revenue_band"].of(F.col("a"), unit=F.col("b"))
    assert one(spark, band, a=(kind, Decimal(amount)),
               b=(kind, Decimal(revenue) if revenue else None)) == label


def test_dashboard_bands_are_right_closed(spark):
    band = DASHBOARD["bureau_band"].of(F.col("a"))
    assert one(spark, band, a=("double", 549.0)) == "<550"
    assert one(spark, band, a=("double", 549.5)) == "550-599"
    assert one(spark, band, a=("double", None)) is None


@pytest.mark.parametrize("z, expected", [
    (0.0, 1.0), (1.959963984540054, 0.05), (-1.959963984540054, 0.05), (None, None),
    (12.0, 3.552964224155360e-33)])
def test_normal_tail(spark, z, expected):
    got = one(spark, normal_two_sided(F.col("a")), a=("double", z))
    assert got == (None if expected is None else pytest.approx(expected, rel=1e-9))


@pytest.mark.parametrize("statistic, freedom, expected", [
    (3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05),
    (9.487729036781154, 4, 0.05), (11.070497693516351, 5, 0.05), (0.0, 3, 1.0)])
def test_chi_square_tail(spark, statistic, freedom, expected):
    got = one(spark, chi_square_tail(F.col("a"), F.col("b")), a=("double", statistic),
              b=("long", freedom))
    assert got == pytest.approx(expected, rel=1e-9)
