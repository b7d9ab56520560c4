"""Portfolio questions: overview, funnel, processing times, risk segments, delinquency,
concentration, cohorts, repeat customers, reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendbook import schemas as S
from lendbook.functions.bands import PORTFOLIO
from lendbook.functions.exprs import (
    count_where, days_between, month_of, percent, rank_in, ratio_rounded, sum_where)
from lendbook.operators.segments import segment_rates, segment_rates_many
from lendbook.plans import views as V
from lendbook.sources.star import Portfolio


def over_all(value: Column) -> Column:
    """Total over the whole frame; only for aggregates that have come down to a few rows."""
    return F.sum(value).over(Window.partitionBy())


def portfolio_overview(portfolio: Portfolio) -> DataFrame:
    rows = portfolio.joined("applications", "decisions", "performance")
    everyone = F.count("*")
    lent, bad = count_where(V.disbursed()), count_where(V.disbursed() & V.defaulted())
    return rows.agg(
        everyone.alias("total_applications"),
        F.count_distinct("customer_id").alias("unique_customers"),
        count_where(V.granted()).alias("approved_or_disbursed"),
        count_where(V.rejected()).alias("rejected_applications"),
        lent.alias("disbursed_loans"),
        percent(count_where(V.granted()), everyone).alias("approval_rate_pct"),
        percent(count_where(V.rejected()), everyone).alias("rejection_rate_pct"),
        percent(lent, everyone).alias("disbursement_rate_pct"),
        ratio_rounded(F.sum("requested_loan_amount"), F.count("requested_loan_amount"))
        .alias("avg_requested_loan_amount"),
        ratio_rounded(sum_where(F.col("approved_amount"), V.granted()),
                      count_where(V.granted())).alias("avg_approved_loan_amount"),
        F.sum("requested_loan_amount").alias("total_requested_amount"),
        F.sum("approved_amount").alias("total_approved_amount"),
        F.sum("outstanding_balance").alias("total_outstanding_balance"),
        bad.alias("defaults_among_disbursed"),
        percent(bad, lent).alias("default_rate_disbursed_pct"),
    )


def funnel_current(portfolio: Portfolio) -> DataFrame:
    return V.application_funnel(portfolio).orderBy(
        rank_in(F.col("application_status"), S.FUNNEL_ORDER))


def funnel_reached(portfolio: Portfolio) -> DataFrame:
    """How many applications reached each stage, by its recorded date."""
    stages = {"credit_review": "credit_review_date", "approval": "approval_date",
              "disbursement": "disbursement_date"}
    return portfolio.decisions.agg(
        F.count("*").alias("total_applications"),
        *[F.count(day).alias(f"reached_{stage}") for stage, day in stages.items()],
        *[percent(F.count(day), F.count("*")).alias(f"pct_reached_{stage}")
          for stage, day in stages.items()])


DURATIONS = {
    "application_to_review_days": ("credit_review_date", "application_date"),
    "review_to_approval_days": ("approval_date", "credit_review_date"),
    "approval_to_disbursement_days": ("disbursement_date", "approval_date"),
    "application_to_approval_days": ("approval_date", "application_date"),
    "application_to_disbursement_days": ("disbursement_date", "application_date"),
}


def _durations(portfolio: Portfolio) -> DataFrame:
    rows = portfolio.joined("applications", "decisions")
    return rows.select("application_date", *[
        days_between(F.col(later), F.col(earlier)).alias(name)
        for name, (later, earlier) in DURATIONS.items()])


def processing_times(portfolio: Portfolio) -> DataFrame:
    """Mean and median of five durations, with the extremes of the three single steps.

    Durations are whole days, so the exact median's value counts stay within the calendar.
    """
    measures = []
    for index, name in enumerate(DURATIONS):
        measures += [
            ratio_rounded(F.sum(name), F.count(name)).alias(f"avg_{name}"),
            F.round(F.percentile(name, F.lit(0.5)), 2).alias(f"median_{name}"),
        ]
        if index < 3:
            measures += [F.min(name).alias(f"min_{name}"), F.max(name).alias(f"max_{name}")]
    return _durations(portfolio).agg(*measures)


def processing_monthly(portfolio: Portfolio) -> DataFrame:
    names = [name for name in DURATIONS if name != "application_to_approval_days"]
    return (
        _durations(portfolio).groupBy(month_of(F.col("application_date")).alias("month"))
        .agg(*[ratio_rounded(F.sum(n), F.count(n)).alias(f"avg_{n}") for n in names])
        .orderBy("month")
    )


def monthly_kpis(portfolio: Portfolio) -> DataFrame:
    return V.monthly_credit_kpis(portfolio).orderBy("month")


def monthly_trend(portfolio: Portfolio) -> DataFrame:
    """Change against the month before and the running requested amount."""
    by_month = Window.orderBy("month")
    so_far = by_month.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return V.monthly_credit_kpis(portfolio).select(
        "month", "applications",
        (F.col("applications") - F.lag("applications").over(by_month))
        .alias("application_change_vs_prior_month"),
        "approval_rate_pct", "default_rate_disbursed_pct", "requested_amount",
        F.sum("requested_amount").over(so_far).alias("cumulative_requested_amount"),
    ).orderBy("month")


# Segmentations, and whether the report shows the outstanding balance.
SEGMENTS = {
    "bureau_score_band": True, "dti_band": True, "business_type": True, "loan_purpose": True,
    "business_age_band": False, "requested_loan_amount_band": False,
    "previous_default_band": False, "loan_to_revenue_band": False,
    "collateral_coverage_band": False, "existing_loans": False,
}


def default_rate_by(portfolio: Portfolio, segment: str) -> DataFrame:
    """Disbursed loans, defaults and default rate per segment, in report order."""
    lent = V.default_analysis(portfolio).where(V.disbursed())
    rates = segment_rates(lent, segment, balance=SEGMENTS[segment])
    if segment in PORTFOLIO:
        return rates.orderBy(PORTFOLIO[segment].ordinal(F.col(segment)))
    if segment in ("business_type", "loan_purpose"):
        return rates.orderBy(F.desc("default_rate_pct"), F.desc("disbursed_loans"))
    return rates.orderBy(segment)


def default_rates_all(portfolio: Portfolio) -> DataFrame:
    """All ten segmentations from one scan and one shuffle."""
    lent = V.default_analysis(portfolio).where(V.disbursed())
    return segment_rates_many(lent, list(SEGMENTS), balance=True)


def status_mix(portfolio: Portfolio) -> DataFrame:
    lent = portfolio.joined("performance", "decisions").where(V.disbursed())
    mix = lent.groupBy("loan_status").agg(
        F.count("*").alias("account_count"),
        F.sum("outstanding_balance").alias("outstanding_balance"))
    return mix.select(
        "*",
        percent(F.col("account_count"), over_all(F.col("account_count")))
        .alias("account_share_pct"),
        percent(F.col("outstanding_balance"), over_all(F.col("outstanding_balance")))
        .alias("balance_share_pct"),
    ).orderBy(rank_in(F.col("loan_status"), S.LOAN_STATUS_ORDER))


def portfolio_at_risk(portfolio: Portfolio) -> DataFrame:
    """Balance and account shares past 30, 60 and 90 days; a default counts in all three."""
    active = portfolio.joined("performance", "decisions").where(
        V.disbursed() & (F.col("loan_status") != "Closed"))
    balance = F.col("outstanding_balance")
    late = {days: (F.col("days_past_due") >= days) | V.defaulted() for days in (30, 60, 90)}
    return active.agg(
        *[percent(F.coalesce(sum_where(balance, condition), F.lit(0)), F.sum(balance))
          .alias(f"par_{days}_balance_pct") for days, condition in late.items()],
        *[percent(count_where(condition), F.count("*"))
          .alias(f"delinquent_{days}_account_pct") for days, condition in late.items()])


def concentration_by(portfolio: Portfolio, column: str) -> DataFrame:
    """Disbursed book per value of a column, and its share of the whole book."""
    rows = portfolio.joined("applications", "decisions", "performance")
    book = rows.groupBy(column).agg(
        count_where(V.disbursed()).alias("disbursed_loans"),
        sum_where(F.col("approved_amount"), V.disbursed()).alias("approved_amount"),
        sum_where(F.col("outstanding_balance"), V.disbursed()).alias("outstanding_balance"))
    share = percent(F.col("outstanding_balance"), over_all(F.col("outstanding_balance")))
    return book.withColumn("outstanding_portfolio_share_pct", share).orderBy(
        F.desc_nulls_last("outstanding_balance"))


def concentration_by_bureau(portfolio: Portfolio) -> DataFrame:
    lent = V.default_analysis(portfolio).where(V.disbursed())
    book = lent.groupBy("bureau_score_band").agg(
        F.count("*").alias("disbursed_loans"),
        F.sum("approved_amount").alias("approved_amount"),
        F.sum("outstanding_balance").alias("outstanding_balance"))
    return book.select(
        "*",
        percent(F.col("outstanding_balance"), over_all(F.col("outstanding_balance")))
        .alias("outstanding_portfolio_share_pct"),
        F.dense_rank().over(Window.orderBy(F.desc("outstanding_balance")))
        .alias("exposure_rank"),
    ).orderBy("exposure_rank", PORTFOLIO["bureau_score_band"].ordinal(
        F.col("bureau_score_band")))


def top_customers(portfolio: Portfolio, count: int = 20) -> DataFrame:
    """The largest exposures with their dense rank.

    The rank of a customer depends only on larger balances, and all of those are among the
    first ``count`` rows, so the rows are cut first and ranked afterwards.
    """
    largest = (
        V.customer_exposure(portfolio).where(F.col("outstanding_balance") > 0)
        .orderBy(F.desc("outstanding_balance"), "customer_id").limit(count)
    )
    rank = F.dense_rank().over(Window.orderBy(F.desc("outstanding_balance")))
    return largest.withColumn("exposure_rank", rank).orderBy("exposure_rank", "customer_id")


def cohort_snapshot(portfolio: Portfolio) -> DataFrame:
    """Today's outcome of the loans disbursed in each month."""
    lent = portfolio.joined("decisions", "performance").where(
        V.disbursed() & F.col("disbursement_date").isNotNull())
    return lent.groupBy(month_of(F.col("disbursement_date")).alias("disbursement_cohort")).agg(
        F.count("*").alias("disbursed_loans"),
        F.sum("approved_amount").alias("approved_amount"),
        F.sum("outstanding_balance").alias("outstanding_balance"),
        count_where(V.defaulted()).alias("defaults"),
        percent(count_where(V.defaulted()), F.count("*")).alias("snapshot_default_rate_pct"),
    ).orderBy("disbursement_cohort")


def repeat_customers(portfolio: Portfolio) -> DataFrame:
    return V.customer_exposure(portfolio).where(F.col("applications") > 1).orderBy(
        F.desc("applications"), F.desc("total_requested_amount"), "customer_id")


def repeat_summary(portfolio: Portfolio) -> DataFrame:
    repeats = portfolio.joined("applications", "decisions", "performance").groupBy(
        "customer_id").agg(F.count("*").alias("applications")).where("applications > 1")
    return repeats.agg(
        F.count("*").alias("customers_with_repeat_applications"),
        ratio_rounded(F.sum("applications"), F.count("*"))
        .alias("avg_applications_among_repeat_customers"),
        F.max("applications").alias("max_applications_for_one_customer"))


def reconciliation(portfolio: Portfolio) -> DataFrame:
    """The headline measures that later stages must reproduce."""
    rows = portfolio.joined("applications", "decisions", "performance")
    everyone, lent = F.count("*"), count_where(V.disbursed())
    bad = count_where(V.disbursed() & V.defaulted())
    return rows.agg(
        everyone.alias("applications"),
        count_where(V.granted()).alias("approved_plus_disbursed"),
        percent(count_where(V.granted()), everyone).alias("approval_rate_pct"),
        count_where(V.rejected()).alias("rejected"),
        percent(count_where(V.rejected()), everyone).alias("rejection_rate_pct"),
        lent.alias("disbursed"),
        percent(lent, everyone).alias("disbursement_rate_pct"),
        bad.alias("defaults"),
        percent(bad, lent).alias("default_rate_disbursed_pct"))


def assert_reconciled(portfolio: Portfolio, expected: dict[str, float]) -> None:
    """Fail when a headline measure differs from its recorded value."""
    actual = reconciliation(portfolio).first().asDict()
    wrong = {name: (actual[name], value) for name, value in expected.items()
             if actual[name] != value}
    if wrong:
        raise ValueError(f"measures differ from their recorded values: {wrong}")


def _row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """Row counts of several frames, as one row with a column each."""
    counts = [frame.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
              for name, frame in frames.items()]
    stacked = reduce(DataFrame.unionAll, counts)
    return stacked.agg(*[F.max(F.when(F.col("name") == name, F.col("rows"))).alias(name)
                         for name in frames])


def view_row_counts(portfolio: Portfolio) -> DataFrame:
    return _row_counts({
        "funnel_rows": V.application_funnel(portfolio),
        "monthly_kpi_rows": V.monthly_credit_kpis(portfolio),
        "portfolio_performance_rows": V.portfolio_performance(portfolio),
        "default_analysis_rows": V.default_analysis(portfolio),
        "business_segment_rows": V.business_segment_performance(portfolio),
        "customer_exposure_rows": V.customer_exposure(portfolio),
    })


def seed_row_counts(portfolio: Portfolio) -> DataFrame:
    return _row_counts({
        "customers": portfolio.customers,
        "applications": portfolio.applications,
        "credit_assessments": portfolio.assessments,
        "decisions": portfolio.decisions,
        "performance_rows": portfolio.performance,
    })


def seed_rates(portfolio: Portfolio) -> DataFrame:
    rows = portfolio.joined("applications", "decisions", "performance")
    everyone, lent = F.count("*"), count_where(V.disbursed())
    bad = count_where(V.defaulted())
    return rows.agg(
        everyone.alias("applications"),
        lent.alias("disbursed"),
        count_where(V.rejected()).alias("rejected"),
        bad.alias("defaults_among_disbursed"),
        percent(count_where(V.granted()), everyone).alias("approval_rate_pct"),
        percent(count_where(V.rejected()), everyone).alias("rejection_rate_pct"),
        percent(lent, everyone).alias("disbursement_rate_pct"),
        percent(bad, lent).alias("default_rate_disbursed_pct"))
