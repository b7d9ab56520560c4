"""Cleaning and feature engineering of the application record."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendbook import schemas as S
from lendbook.functions.bands import PORTFOLIO, portfolio_bands
from lendbook.functions.exprs import days_between, safe_ratio
from lendbook.operators.quantiles import exact_medians
from lendbook.plans.questions import DURATIONS


def missing_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({
        f"{name}_missing": F.col(name).isNull().cast("int") for name in S.IMPUTED_COLUMNS})


def fit_medians(df: DataFrame) -> dict[str, float]:
    """Exact medians of the imputed columns, four numbers.

    Fit on all rows to follow the original reports, or on the training part to keep the
    holdout out of the imputation.
    """
    return exact_medians(df, S.IMPUTED_COLUMNS)


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Add ``x_imputed`` next to every imputed column; the source stays as it is."""
    return df.withColumns({
        f"{name}_imputed": F.coalesce(F.col(name).cast("double"), F.lit(float(medians[name])))
        for name in S.IMPUTED_COLUMNS})


# Ratio features as (numerator, denominator), used for training and for scoring alike.
RATIOS = {
    "loan_to_annual_revenue_ratio": ("requested_loan_amount", "annual_revenue"),
    "collateral_coverage_ratio": ("collateral_value", "requested_loan_amount"),
    "collateral_coverage_ratio_imputed":
        ("collateral_value_imputed", "requested_loan_amount"),
    "monthly_debt_to_revenue_ratio": ("existing_monthly_debt", "monthly_revenue"),
    "revenue_per_employee": ("monthly_revenue", "number_of_employees_imputed"),
    "requested_amount_per_tenure_month": ("requested_loan_amount", "loan_tenure_months"),
}


def ratio(name: str) -> Column:
    top, bottom = RATIOS[name]
    return safe_ratio(F.col(top), F.col(bottom)).alias(name)


def ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({name: ratio(name) for name in RATIOS})


def flags(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "has_previous_default": (F.col("previous_defaults") >= 1).cast("int"),
        "has_existing_loan": (F.col("existing_loans") >= 1).cast("int"),
        "has_collateral": (F.col("collateral_value") > 0).cast("int"),
    })


def bands(df: DataFrame) -> DataFrame:
    columns = portfolio_bands()
    return df.withColumns({name: columns[name] for name in PORTFOLIO})


def durations(df: DataFrame) -> DataFrame:
    return df.withColumns({
        name: days_between(F.col(later), F.col(earlier))
        for name, (later, earlier) in DURATIONS.items()})


def clean_table(flat: DataFrame, medians: dict[str, float] | None = None) -> DataFrame:
    """The source record with every engineered column."""
    medians = medians or fit_medians(flat)
    imputed = impute(missing_flags(flat), medians)
    return durations(bands(flags(ratios(imputed))))


def model_table(clean: DataFrame) -> DataFrame:
    """Disbursed loans with ids, label and the 27 predictors, all numbers as doubles."""
    renamed = clean.drop("collateral_coverage_ratio").withColumnRenamed(
        "collateral_coverage_ratio_imputed", "collateral_coverage_ratio")
    lent = renamed.where(F.col("application_status") == "Disbursed")
    table = lent.select(
        *S.ID_COLUMNS, S.LABEL, *S.NOMINAL_PREDICTORS,
        *[F.col(name).cast("double").alias(name) for name in S.NUMERIC_PREDICTORS])
    leakage_guard(table.columns)
    return table


class LeakageError(ValueError):
    """Raised when an outcome or workflow column is among the predictors."""


def leakage_guard(columns: Iterable[str], prohibited: Iterable[str] = ()) -> list[str]:
    """The predictors among ``columns``; fails when a prohibited one is present."""
    predictors = [name for name in columns if name not in (*S.ID_COLUMNS, S.LABEL)]
    banned = set(prohibited) or {*S.LEAKAGE_COLUMNS, *S.ID_COLUMNS, S.LABEL}
    found = [name for name in predictors if name in banned]
    if found:
        raise LeakageError(f"prohibited predictors present: {', '.join(found)}")
    return predictors


def predictor_report(table: DataFrame) -> DataFrame:
    """(predictor, prohibited, filled) for each predictor of a modelling table."""
    predictors = [name for name in table.columns if name not in (*S.ID_COLUMNS, S.LABEL)]
    counted = table.agg(*[F.count(name).alias(name) for name in predictors])
    return counted.unpivot([], predictors, "predictor", "filled").withColumn(
        "prohibited", F.col("predictor").isin(S.LEAKAGE_COLUMNS).cast("int"))
