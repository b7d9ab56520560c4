"""Descriptive tables of the validation stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendbook.functions.bands import PORTFOLIO, portfolio_bands
from lendbook.functions.exprs import count_where, fraction, ratio_rounded, sum_where
from lendbook.operators.quantiles import unpivot
from lendbook.operators.segments import segment_rates_many
from lendbook.plans import views as V


def headline(flat: DataFrame) -> DataFrame:
    """Eight (metric, value) rows: four rates, two means, two totals."""
    everyone, lent = F.count("*"), count_where(V.disbursed())
    metrics = {
        "approval_rate": fraction(count_where(V.granted()), everyone),
        "rejection_rate": fraction(count_where(V.rejected()), everyone),
        "disbursement_rate": fraction(lent, everyone),
        "default_rate_disbursed":
            fraction(count_where(V.disbursed() & V.defaulted()), lent),
        "average_requested":
            ratio_rounded(F.sum("requested_loan_amount"), F.count("requested_loan_amount")),
        "average_approved": ratio_rounded(
            sum_where(F.col("approved_amount"), V.granted()), count_where(V.granted())),
        "total_approved": F.sum("approved_amount").cast("double"),
        "total_outstanding": F.sum("outstanding_balance").cast("double"),
    }
    return flat.agg(*[value.alias(name) for name, value in metrics.items()]).unpivot(
        [], list(metrics), "metric", "value")


def frequency(flat: DataFrame) -> DataFrame:
    """(field, category, count, percent) of four nominal fields, missing values kept."""
    fields = ["application_status", "loan_status", "business_type", "loan_purpose"]
    counts = (
        unpivot(flat, fields, variable="field", value="category", as_type="string")
        .groupBy("field", "category").agg(F.count("*").alias("count"))
    )
    rows = F.sum("count").over(Window.partitionBy("field"))  # a few rows per field
    return counts.withColumn("percent", ratio_rounded(F.col("count"), rows, 3, 100))


def segment_tables(flat: DataFrame) -> DataFrame:
    """Default fractions of disbursed loans by five segmentations, missing groups dropped."""
    bands = portfolio_bands()
    names = ["bureau_score_band", "dti_band", "previous_default_band", "business_age_band",
             "loan_to_revenue_band"]
    known = {
        name: F.when(bands[name] != PORTFOLIO[name].null_label, bands[name])
        if name in PORTFOLIO else bands[name] for name in names}
    lent = flat.where(V.disbursed()).select(
        "default_flag", *[column.alias(name) for name, column in known.items()])
    return segment_rates_many(lent, names, unit="fraction", drop_null=True,
                              count_name="eligible")
