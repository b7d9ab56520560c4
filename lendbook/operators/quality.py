"""Data-quality rules: all row rules in one pass, key rules with one shuffle each."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendbook import schemas as S
from lendbook.functions.bands import PORTFOLIO, Bands
from lendbook.functions.exprs import INFINITY, fraction, ratio_rounded
from lendbook.operators.quantiles import unpivot

Rules = dict[str, Column]


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda left, right: left & right, conditions)


def _implies(premise: Column, conclusion: Column) -> Column:
    return ~premise | conclusion


def _ordered(later: str, earlier: str) -> Column:
    """The later date is absent, or both are present and in order."""
    return F.col(later).isNull() | (
        F.col(earlier).isNotNull() & (F.col(earlier) <= F.col(later)))


def portfolio_rules(dti_range: tuple = (0, 1)) -> Rules:
    """Conditions every application record must satisfy. A condition that comes out null
    counts as violated."""
    col = F.col
    status, loan = col("application_status"), col("loan_status")
    past_due, flag = col("days_past_due"), col("default_flag")
    balance = col("outstanding_balance")
    lent = status == "Disbursed"
    low, high = (Decimal(str(bound)) for bound in dti_range)
    nothing_owed = _all([balance == 0, past_due == 0, flag == 0])
    untouched = nothing_owed & (col("missed_payments") == 0) & (col("total_payments") == 0)
    dpd_by_status = (
        F.when(loan == "Current", past_due == 0)
        .when(loan == "DPD 1-29", past_due.between(1, 29))
        .when(loan == "DPD 30-59", past_due.between(30, 59))
        .when(loan == "DPD 60-89", past_due.between(60, 89))
        .when(loan.isin("DPD 90+", "Default"), past_due >= 90)
        .otherwise(True)
    )
    optional_floor = {"number_of_employees": 1, "bank_account_age_years": 0,
                      "collateral_value": 0}
    floor = ["credit_history_years", "existing_loans", "existing_monthly_debt",
             "previous_defaults", "days_past_due", "missed_payments", "total_payments"]
    return {
        "dq_not_null": _all([col(name).isNotNull() for name in S.CRITICAL_COLUMNS]),
        "dq_flag_domain": flag.isin(0, 1),
        "dq_app_status_domain": status.isin(*S.APPLICATION_STATUSES),
        "dq_loan_status_domain": loan.isin(*S.LOAN_STATUSES),
        "dq_nonneg_money": _all([
            col(name).isNull() | (col(name) >= 0) for name in S.MONEY_COLUMNS]),
        "dq_bureau_range":
            col("bureau_score").isNull() | col("bureau_score").between(*S.BUREAU_RANGE),
        "dq_dti_range": col("debt_to_income_ratio").between(F.lit(low), F.lit(high)),
        "dq_nonneg_age": col("business_age_years") >= 0,
        "dq_tenure_domain": col("loan_tenure_months").isin(*S.TENURES),
        "dq_approval_cap": col("approved_amount") <= col("requested_loan_amount"),
        "dq_review_order": _ordered("credit_review_date", "application_date"),
        "dq_approval_order": _ordered("approval_date", "credit_review_date"),
        "dq_disbursement_order": _ordered("disbursement_date", "approval_date"),
        "dq_rejected_not_disbursed":
            _implies(status == "Rejected", col("disbursement_date").isNull()),
        "dq_pending_no_dates": _implies(
            status.isin("Submitted", "Under Review"),
            col("approval_date").isNull() & col("disbursement_date").isNull()),
        "dq_rejected_no_default": _implies(status == "Rejected", flag == 0),
        "dq_nondisbursed_clean": _implies(~lent, untouched & (loan == "Not Disbursed")),
        "dq_default_not_disbursed": _implies(flag == 1, lent),
        "dq_default_status": (flag == 1) == (loan == "Default"),
        "dq_dpd_status": dpd_by_status,
        "dq_balance_status": F.when(
            loan.isin("Not Disbursed", "Closed"), balance == 0).otherwise(balance >= 0),
        "dq_closed": _implies(loan == "Closed", (past_due == 0) & (flag == 0)),
        "dq_other_bounds": _all(
            [col(name).isNull() | (col(name) >= least) for name, least in optional_floor.items()]
            + [col(name) >= 0 for name in floor]),
    }


def run_rules(df: DataFrame, rules: Rules) -> DataFrame:
    """(check, violations, pass) for row rules, all counted in the same scan."""
    counted = df.agg(*[
        F.count_if(~F.coalesce(holds, F.lit(False))).alias(name)
        for name, holds in rules.items()])
    return _report(counted, list(rules))


def _report(counted: DataFrame, names: Sequence[str]) -> DataFrame:
    return counted.unpivot([], list(names), "check", "violations").withColumn(
        "pass", (F.col("violations") == 0).cast("int"))


def duplicate_rows(df: DataFrame, keys: Sequence[str], check: str) -> DataFrame:
    """How many rows repeat an earlier row's key. Partial counts keep a hot key cheap."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("rows"))
    return _report(groups.agg(F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias(check)),
                   [check])


def full_duplicates(df: DataFrame, check: str = "dq_full_duplicates") -> DataFrame:
    """How many rows repeat an earlier row in every column.

    Rows are counted by a fingerprint of 64 bits, the only thing that is shuffled of all rows. Whole
    rows are compared where a fingerprint stands more than once: there alone can rows be equal,
    and there alone can different rows share one.
    """
    columns = df.columns
    marked = df.withColumn("_print", F.xxhash64(*columns))
    often = marked.groupBy("_print").agg(F.count("*").alias("_n")).where("_n > 1")
    alike = marked.join(often.select("_print"), "_print", "left_semi").select(*columns)
    return duplicate_rows(alike, columns, check)


def duplicate_keys(df: DataFrame, key: str = "application_id") -> DataFrame:
    """The keys that occur more than once."""
    return (df.groupBy(key).agg(F.count("*").alias("duplicate_count"))
            .where(F.col("duplicate_count") > 1))


def row_count(df: DataFrame, expected: int) -> DataFrame:
    """Distance between the row count and the expected one."""
    return _report(df.agg(F.abs(F.count("*") - F.lit(expected)).alias("dq_row_count")),
                   ["dq_row_count"])


def column_count(df: DataFrame, expected: int) -> DataFrame:
    """Columns too many or too few; whether they hold values does not matter."""
    return _report(df.agg(_columns_off(df, expected).alias("dq_col_count")), ["dq_col_count"])


def _columns_off(df: DataFrame, expected: int) -> Column:
    return F.lit(abs(len(df.columns) - expected)).cast("bigint")


def empty_columns(df: DataFrame) -> DataFrame:
    """(column, rows) of columns without any value, from one scan. No column of an empty table is
    told."""
    counted = df.agg(F.count("*").alias("rows"), *[
        (F.count(name) == 0).alias(name) for name in df.columns])
    return counted.unpivot(["rows"], df.columns, "column", "empty").where(
        F.col("empty") & (F.col("rows") > 0)).select("column", "rows")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the number of nulls per column."""
    return df.agg(*[F.count_if(F.col(name).isNull()).alias(f"null_{name}")
                    for name in columns])


def missingness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, missing, percent) with three decimals, from one scan."""
    columns = list(columns or df.columns)
    counted = df.agg(F.count("*").alias("_rows"), *[
        F.count_if(F.col(name).isNull()).alias(name) for name in columns])
    return counted.unpivot(["_rows"], columns, "column", "missing").select(
        "column", "missing",
        ratio_rounded(F.col("missing"), F.col("_rows"), 3, 100).alias("percent"))


def missing_only_in(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Columns outside ``allowed`` that contain nulls."""
    others = [name for name in df.columns if name not in allowed]
    return missingness(df, others).agg(
        F.count_if(F.col("missing") > 0).alias("dq_missing_only_in")).transform(
        _report, ["dq_missing_only_in"])


def orphans(entities: dict[str, DataFrame], parent: DataFrame,
            key: str = "application_id") -> DataFrame:
    """Keys absent from each entity, over the keys found in any table.

    A chain of full outer joins answers this with one shuffle per table; tagging keys and
    grouping them takes one shuffle in all.
    """
    tagged = [parent.select(key, F.lit("_parent").alias("entity"))]
    tagged += [frame.select(key, F.lit(name).alias("entity"))
               for name, frame in entities.items()]
    present = reduce(DataFrame.unionAll, tagged).groupBy(key).agg(*[
        F.max((F.col("entity") == name).cast("int")).alias(name) for name in entities])
    return present.agg(*[F.count_if(F.col(name) == 0).alias(f"{name}_without_application")
                         for name in entities])


def orphans_by_outer_join(entities: dict[str, DataFrame], parent: DataFrame,
                          key: str = "application_id") -> DataFrame:
    """The same counts from the chain of full outer joins. Tables bucketed by the key are
    joined in place; ``orphans`` is the one to use when they are not."""
    joined = parent.select(key)
    for name, frame in entities.items():
        joined = joined.join(frame.select(key, F.lit(1).alias(name)), key, "full_outer")
    return joined.agg(*[F.count_if(F.col(name).isNull()).alias(f"{name}_without_application")
                        for name in entities])


def foreign_keys(references: dict[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """(reference, violations): child rows whose key has no parent row."""
    counts = [
        child.join(parent.select(key), key, "left_anti")
        .agg(F.count("*").alias("violations"))
        .select(F.lit(name).alias("reference"), "violations")
        for name, (child, parent, key) in references.items()]
    return reduce(DataFrame.unionAll, counts)


def unexpected_labels(df: DataFrame, bands: dict[str, Bands] = PORTFOLIO) -> DataFrame:
    """(band, labels, unexpected) per band column: labels seen, and those not defined."""
    long = unpivot(df, list(bands), variable="band", value="label", as_type="string")
    seen = long.groupBy("band", "label").agg(F.count("*").alias("rows"))
    known = F.lit(False)
    for name, definition in bands.items():
        known = known | ((F.col("band") == name) & F.col("label").isin(definition.all_labels))
    return seen.groupBy("band").agg(
        F.count("*").alias("labels"),
        F.count_if(~F.coalesce(known, F.lit(False))).alias("unexpected"))


def infinite_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, infinite) per numeric column."""
    counted = df.agg(*[
        F.count_if(F.abs(F.col(name).cast("double")) == INFINITY).alias(name)
        for name in columns])
    return counted.unpivot([], list(columns), "column", "infinite")


def model_population(flat: DataFrame, modelling: DataFrame) -> DataFrame:
    """Size and default rate of the modelling set, and whether it equals the lent loans."""
    lent = flat.where(F.col("application_status") == "Disbursed").agg(
        F.count("*").alias("rows"), F.lit("source").alias("origin"),
        F.count_if(F.col("default_flag") == 1).alias("bad"))
    used = modelling.agg(
        F.count("*").alias("rows"), F.lit("model").alias("origin"),
        F.count_if(F.col("default_flag") == 1).alias("bad"))

    def of(origin: str, name: str) -> Column:
        return F.max(F.when(F.col("origin") == origin, F.col(name)))

    rows, bad = of("model", "rows"), of("model", "bad")
    return lent.unionByName(used).agg(
        rows.alias("modelling_rows"), bad.alias("defaults"),
        (rows - bad).alias("non_defaults"), fraction(bad, rows).alias("default_rate"),
        ((rows == of("source", "rows")) & (bad == of("source", "bad"))).cast("int")
        .alias("reconciles"))


class QualityError(ValueError):
    """Raised when a critical rule is violated."""


def gate(report: DataFrame, critical: Sequence[str] | None = None) -> DataFrame:
    """Fail the job when a critical check has violations; otherwise hand the report on.

    The report has one row per check. It is computed once, here, and handed on as its rows.
    """
    rows = report.collect()
    failed = {row["check"]: row["violations"] for row in rows
              if row["violations"] and (critical is None or row["check"] in critical)}
    if failed:
        raise QualityError(f"critical checks failed: {failed}")
    return report.sparkSession.createDataFrame(rows, report.schema)


def _suite(flat: DataFrame, rules: Rules, expected_rows: int | None) -> DataFrame:
    """Rules, missing values, columns and rows from one scan; the key from one shuffle."""
    others = [name for name in flat.columns if name not in S.NULLABLE_COLUMNS]
    missing = reduce(lambda left, right: left + right, [
        (F.count(name) < F.count("*")).cast("bigint") for name in others])
    counted = {
        **{name: F.count_if(~F.coalesce(holds, F.lit(False))) for name, holds in rules.items()},
        "dq_missing_only_in": missing,
        "dq_col_count": _columns_off(flat, len(S.FLAT_COLUMNS)),
    }
    if expected_rows is not None:
        counted["dq_row_count"] = F.abs(F.count("*") - F.lit(expected_rows))
    wide = flat.agg(*[value.alias(name) for name, value in counted.items()])
    return _report(wide, list(counted)).unionAll(
        duplicate_rows(flat, ["application_id"], "dq_unique_key"))


def with_rejects(report: DataFrame, rejects: DataFrame) -> DataFrame:
    """A report with one more check: no record was rejected when the source was read."""
    counted = rejects.agg(F.count("*").alias("src_no_rejects"))
    return report.unionAll(_report(counted, ["src_no_rejects"]))


def validation_suite(flat: DataFrame, dti_range: tuple = (0, 1),
                     expected_rows: int | None = None) -> DataFrame:
    """Every check on the application record, as (check, violations, pass)."""
    return _suite(flat, portfolio_rules(dti_range), expected_rows)


def gate_suite(flat: DataFrame, expected_rows: int) -> DataFrame:
    """The checks that stop the cleaning stage. A missing debt ratio is let through here."""
    rules = portfolio_rules()
    ratio = F.col("debt_to_income_ratio")
    rules["dq_dti_range_or_missing"] = ratio.isNull() | rules["dq_dti_range"]
    wanted = {name: holds for name, holds in rules.items() if name in GATE_CHECKS}
    return _suite(flat, wanted, expected_rows).where(F.col("check").isin(GATE_CHECKS))


# Checks that stop the cleaning stage.
GATE_CHECKS = [
    "dq_row_count", "dq_col_count", "dq_unique_key", "dq_not_null", "dq_flag_domain",
    "dq_app_status_domain", "dq_loan_status_domain", "dq_nonneg_money", "dq_bureau_range",
    "dq_dti_range_or_missing", "dq_review_order", "dq_approval_order", "dq_disbursement_order",
]
