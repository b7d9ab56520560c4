"""Ordered bands over numeric measures."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"


@dataclass(frozen=True)
class Bands:
    """Cut points and labels. ``right=False`` cuts [a, b), ``right=True`` cuts (a, b]."""

    cuts: tuple
    labels: tuple
    right: bool = False
    null_label: str | None = UNKNOWN

    @property
    def all_labels(self) -> list[str]:
        extra = [self.null_label] if self.null_label and self.null_label not in self.labels else []
        return [*self.labels, *extra]

    def of(self, value: Column, unit: Column | None = None) -> Column:
        """Label of ``value``; with ``unit`` the label of ``value / unit``.

        A ratio is compared as ``value < cut * unit``, which is exact in decimals and needs no
        division, so a value sitting on a cut never lands on the wrong side.
        """
        missing = value.isNull()
        if unit is not None:
            missing = missing | unit.isNull() | (unit == 0)
        banded = F.when(missing, F.lit(self.null_label))
        for cut, label in zip(self.cuts, self.labels):
            limit = F.lit(cut) if unit is None else F.lit(cut) * unit
            banded = banded.when(value <= limit if self.right else value < limit, F.lit(label))
        return banded.otherwise(F.lit(self.labels[-1]))

    def ordinal(self, label: Column) -> Column:
        """Position of a label in band order, for sorting."""
        position = F.lit(len(self.all_labels) + 1)
        for index, name in reversed(list(enumerate(self.all_labels, start=1))):
            position = F.when(label == name, index).otherwise(position)
        return position


def _decimals(*texts: str) -> tuple[Decimal, ...]:
    return tuple(Decimal(text) for text in texts)


# Band cut points and labels of the portfolio reports.
PORTFOLIO = {
    "bureau_score_band": Bands(
        (550, 650, 700, 750), ("<550", "550-649", "650-699", "700-749", "750+")),
    "dti_band": Bands(
        _decimals("0.20", "0.35", "0.50"), ("<20%", "20%-34.99%", "35%-49.99%", "50%+")),
    "business_age_band": Bands(
        (3, 5, 10), ("<3 years", "3-4.99 years", "5-9.99 years", "10+ years")),
    "loan_to_revenue_band": Bands(
        _decimals("0.15", "0.25", "0.40"), ("<15%", "15%-24.99%", "25%-39.99%", "40%+")),
    "collateral_coverage_band": Bands(
        _decimals("0.50", "1.00", "1.50"), ("<50%", "50%-99.99%", "100%-149.99%", "150%+")),
    "requested_loan_amount_band": Bands(
        (25000, 50000, 100000), ("<25k", "25k-49.99k", "50k-99.99k", "100k+")),
}
# The dashboard cuts its own, right-closed, bands.
DASHBOARD = {
    "bureau_band": Bands(
        (549, 599, 649, 699), ("<550", "550-599", "600-649", "650-699", "700+"), right=True,
        null_label=None),
    "dti_band": Bands(
        _decimals("0.20", "0.35", "0.50"), ("<=20%", "20-35%", "35-50%", ">50%"), right=True,
        null_label=None),
    "age_band": Bands((2, 5, 10), ("<=2", "3-5", "6-10", "10+"), right=True, null_label=None),
}


def portfolio_bands() -> dict[str, Column]:
    """The seven reporting bands of an application row."""
    col = F.col
    requested = col("requested_loan_amount")
    bands = {
        "bureau_score_band": PORTFOLIO["bureau_score_band"].of(col("bureau_score")),
        "dti_band": PORTFOLIO["dti_band"].of(col("debt_to_income_ratio")),
        "business_age_band": PORTFOLIO["business_age_band"].of(col("business_age_years")),
        "loan_to_revenue_band":
            PORTFOLIO["loan_to_revenue_band"].of(requested, unit=col("annual_revenue")),
        "collateral_coverage_band":
            PORTFOLIO["collateral_coverage_band"].of(col("collateral_value"), unit=requested),
        "previous_default_band": F.when(col("previous_defaults") == 0, "0").otherwise("1+"),
        "requested_loan_amount_band":
            PORTFOLIO["requested_loan_amount_band"].of(requested),
    }
    return bands
