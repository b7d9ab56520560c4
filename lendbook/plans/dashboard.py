"""The tables behind the portfolio dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendbook import schemas as S
from lendbook.functions.bands import DASHBOARD
from lendbook.functions.exprs import count_where, fraction
from lendbook.operators import evaluate as E
from lendbook.operators.quantiles import unpivot
from lendbook.plans import views as V


def kpis(flat: DataFrame) -> DataFrame:
    everyone, lent = F.count("*"), count_where(V.disbursed())
    return flat.agg(
        everyone.alias("total_applications"),
        F.count_distinct("customer_id").alias("unique_customers"),
        fraction(count_where(V.granted()), everyone).alias("approval_rate"),
        fraction(lent, everyone).alias("disbursement_rate"),
        lent.alias("disbursed_loans"),
        fraction(count_where(V.disbursed() & V.defaulted()), lent).alias("default_rate"),
        F.sum("approved_amount").alias("total_approved_amount"),
        F.sum("outstanding_balance").alias("total_outstanding_balance"))


def counts_by(flat: DataFrame, column: str, by_frequency: bool = False) -> DataFrame:
    counts = flat.groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy("n", column) if by_frequency else counts.orderBy(column)


BAND_SOURCE = {"bureau_band": "bureau_score_imputed", "dti_band": "debt_to_income_ratio",
               "age_band": "business_age_years"}


def rate_by_band(clean: DataFrame, band: str) -> DataFrame:
    """Default fraction of disbursed loans per dashboard band, a missing measure kept."""
    label = DASHBOARD[band].of(F.col(BAND_SOURCE[band]))
    return (
        clean.where(V.disbursed()).groupBy(label.alias(band))
        .agg(fraction(F.sum("default_flag"), F.count("default_flag")).alias("default_rate"))
        .orderBy(DASHBOARD[band].ordinal(F.col(band)))
    )


def rate_by_history(clean: DataFrame) -> DataFrame:
    history = F.when(F.col("previous_defaults") > 0, "Prior default").otherwise(
        "No prior default")
    return clean.where(V.disbursed()).groupBy(history.alias("previous_history")).agg(
        fraction(F.sum("default_flag"), F.count("default_flag")).alias("default_rate"))


def rate_by_purpose(clean: DataFrame) -> DataFrame:
    return clean.where(V.disbursed()).groupBy("loan_purpose").agg(
        fraction(F.sum("default_flag"), F.count("default_flag")).alias("default_rate")
    ).orderBy("default_rate")


def metric_table(metrics: DataFrame) -> DataFrame:
    """Model metrics with four decimals, rounded half to even."""
    return metrics.select("model", *[F.bround(name, 4).alias(name) for name in E.METRICS])


def choices(table: DataFrame) -> DataFrame:
    """Sorted distinct values a user can pick from, as (field, choice, position)."""
    fields = [*S.NOMINAL_PREDICTORS, "loan_tenure_months"]
    whole = table.withColumn("loan_tenure_months", F.col("loan_tenure_months").cast("int"))
    distinct = unpivot(whole, fields, variable="field", value="choice",
                       as_type="string").distinct()
    # Numbered over the distinct choices; tenures sort as numbers.
    order = Window.partitionBy("field").orderBy(F.expr("try_cast(choice AS int)"), "choice")
    return distinct.withColumn("position", F.row_number().over(order))
