"""The reusable views of the portfolio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendbook.functions.bands import portfolio_bands
from lendbook.functions.exprs import count_where, month_of, percent
from lendbook.sources.star import Portfolio


def disbursed() -> Column:
    return F.col("application_status") == "Disbursed"


def granted() -> Column:
    return F.col("application_status").isin("Approved", "Disbursed")


def rejected() -> Column:
    return F.col("application_status") == "Rejected"


def defaulted() -> Column:
    return F.col("default_flag") == 1


def application_funnel(portfolio: Portfolio) -> DataFrame:
    """Applications per current status and their share."""
    counts = portfolio.decisions.groupBy("application_status").agg(
        F.count("*").alias("application_count"))
    everything = F.sum("application_count").over(Window.partitionBy())
    return counts.withColumn(
        "percentage_of_applications", percent(F.col("application_count"), everything))


def monthly_credit_kpis(portfolio: Portfolio) -> DataFrame:
    """Volumes, rates and amounts per application month."""
    rows = portfolio.joined("applications", "decisions", "performance")
    everyone = F.count("*")
    lent, bad = count_where(disbursed()), count_where(disbursed() & defaulted())
    return rows.groupBy(month_of(F.col("application_date")).alias("month")).agg(
        everyone.alias("applications"),
        count_where(granted()).alias("approvals"),
        count_where(rejected()).alias("rejections"),
        lent.alias("disbursements"),
        percent(count_where(granted()), everyone).alias("approval_rate_pct"),
        percent(count_where(rejected()), everyone).alias("rejection_rate_pct"),
        percent(lent, everyone).alias("disbursement_rate_pct"),
        F.sum("requested_loan_amount").alias("requested_amount"),
        F.sum("approved_amount").alias("approved_amount"),
        bad.alias("defaults"),
        percent(bad, lent).alias("default_rate_disbursed_pct"),
    )


PORTFOLIO_COLUMNS = [
    "application_id", "customer_id", "application_date", "business_type", "business_age_years",
    "number_of_employees", "monthly_revenue", "annual_revenue", "requested_loan_amount",
    "loan_tenure_months", "loan_purpose", "existing_loans", "existing_monthly_debt",
    "debt_to_income_ratio", "bureau_score", "previous_defaults", "collateral_value",
    "application_status", "credit_review_date", "approval_date", "approved_amount",
    "disbursement_date", "outstanding_balance", "days_past_due", "missed_payments",
    "total_payments", "loan_status", "default_flag",
]


def portfolio_performance(portfolio: Portfolio) -> DataFrame:
    """One wide row per application, from all four application tables."""
    return portfolio.joined("applications", "assessments", "decisions",
                            "performance").select(*PORTFOLIO_COLUMNS)


def default_analysis(portfolio: Portfolio) -> DataFrame:
    """Application rows with their reporting bands."""
    kept = ["application_id", "customer_id", "application_date", "business_type",
            "loan_purpose", "application_status", "approved_amount", "outstanding_balance",
            "default_flag", "previous_defaults", "existing_loans"]
    return portfolio_performance(portfolio).select(
        *kept, *[band.alias(name) for name, band in portfolio_bands().items()])


def business_segment_performance(portfolio: Portfolio) -> DataFrame:
    """Disbursed book per business type."""
    lent = portfolio.joined("applications", "decisions", "performance").where(disbursed())
    return lent.groupBy("business_type").agg(
        F.count("*").alias("disbursed_loan_count"),
        F.sum("approved_amount").alias("approved_amount"),
        F.sum("outstanding_balance").alias("outstanding_balance"),
        count_where(defaulted()).alias("defaults"),
        percent(count_where(defaulted()), F.count("*")).alias("default_rate_pct"),
    )


def customer_exposure(portfolio: Portfolio) -> DataFrame:
    """Applications, amounts and defaults per customer, whatever the status."""
    rows = portfolio.joined("applications", "decisions", "performance")
    return rows.groupBy("customer_id").agg(
        F.count("*").alias("applications"),
        count_where(disbursed()).alias("disbursed_loans"),
        F.sum("requested_loan_amount").alias("total_requested_amount"),
        F.sum("approved_amount").alias("total_approved_amount"),
        F.sum("outstanding_balance").alias("outstanding_balance"),
        count_where(defaulted()).alias("defaults"),
    )


# Table names the portfolio's SQL is written against.
TABLE_NAMES = {
    "customers": "customers",
    "applications": "loan_applications",
    "assessments": "credit_assessments",
    "decisions": "loan_decisions",
    "performance": "loan_performance",
}


def register_views(portfolio: Portfolio) -> None:
    """Expose the entities and the six views to ``spark.sql`` as temporary views."""
    for entity, table in TABLE_NAMES.items():
        getattr(portfolio, entity).createOrReplaceTempView(table)
    for view in (application_funnel, monthly_credit_kpis, portfolio_performance,
                 default_analysis, business_segment_performance, customer_exposure):
        view(portfolio).createOrReplaceTempView(f"vw_{view.__name__}")
