"""Field names, types and value domains of the credit portfolio."""

from __future__ import annotations

from pyspark.sql import types as T

# Money keeps two decimals and stays within 18 digits, so Spark stores it as a long.
# It is wider than any single amount needs: annual revenue is itself a sum over lines.
MONEY = T.DecimalType(18, 2)
YEARS = T.DecimalType(6, 1)
RATIO3 = T.DecimalType(6, 3)


def _flat(key_type: T.DataType) -> T.StructType:
    # Names and types of the record, in its order.
    text, whole, day = T.StringType(), T.IntegerType(), T.DateType()
    fields = {
        "application_id": key_type,
        "customer_id": key_type,
        "application_date": day,
        "business_type": text,
        "business_age_years": YEARS,
        "number_of_employees": whole,
        "monthly_revenue": MONEY,
        "annual_revenue": MONEY,
        "requested_loan_amount": MONEY,
        "loan_tenure_months": whole,
        "loan_purpose": text,
        "existing_loans": whole,
        "existing_monthly_debt": MONEY,
        "debt_to_income_ratio": RATIO3,
        "bureau_score": whole,
        "credit_history_years": YEARS,
        "previous_defaults": whole,
        "collateral_value": MONEY,
        "bank_account_age_years": YEARS,
        "application_status": text,
        "credit_review_date": day,
        "approval_date": day,
        "disbursement_date": day,
        "approved_amount": MONEY,
        "outstanding_balance": MONEY,
        "days_past_due": whole,
        "missed_payments": whole,
        "total_payments": whole,
        "loan_status": text,
        "default_flag": whole,
    }
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Portfolios exported by other systems use text keys, the driver tables use long keys.
FLAT_TEXT_KEYS = _flat(T.StringType())
FLAT_LONG_KEYS = _flat(T.LongType())
FLAT_COLUMNS = FLAT_LONG_KEYS.names

# The columns of each entity.
ENTITY_COLUMNS = {
    "applications": [
        "application_id", "customer_id", "application_date", "business_type",
        "business_age_years", "number_of_employees", "monthly_revenue", "annual_revenue",
        "credit_history_years", "bank_account_age_years", "requested_loan_amount",
        "loan_tenure_months", "loan_purpose",
    ],
    "assessments": [
        "application_id", "existing_loans", "existing_monthly_debt", "debt_to_income_ratio",
        "bureau_score", "previous_defaults", "collateral_value",
    ],
    "decisions": [
        "application_id", "application_status", "credit_review_date", "approval_date",
        "approved_amount", "disbursement_date",
    ],
    "performance": [
        "application_id", "outstanding_balance", "days_past_due", "missed_payments",
        "total_payments", "loan_status", "default_flag",
    ],
}

# Status domains, tenures, money and nullable fields, score range.
APPLICATION_STATUSES = ["Rejected", "Submitted", "Under Review", "Approved", "Disbursed"]
LOAN_STATUSES = [
    "Not Disbursed", "Current", "DPD 1-29", "DPD 30-59", "DPD 60-89", "DPD 90+", "Default",
    "Closed",
]
FUNNEL_ORDER = ["Submitted", "Under Review", "Approved", "Disbursed", "Rejected"]
LOAN_STATUS_ORDER = [
    "Current", "DPD 1-29", "DPD 30-59", "DPD 60-89", "DPD 90+", "Default", "Closed",
]
TENURES = [6, 12, 18, 24, 36, 48, 60]
MONEY_COLUMNS = [
    "monthly_revenue", "annual_revenue", "requested_loan_amount", "approved_amount",
    "existing_monthly_debt", "collateral_value", "outstanding_balance",
]
CRITICAL_COLUMNS = [
    "application_id", "customer_id", "application_date", "application_status", "default_flag",
]
NULLABLE_COLUMNS = [
    "number_of_employees", "bureau_score", "collateral_value", "bank_account_age_years",
    "credit_review_date", "approval_date", "disbursement_date",
]
IMPUTED_COLUMNS = [
    "number_of_employees", "bureau_score", "collateral_value", "bank_account_age_years",
]
BUREAU_RANGE = (300, 850)

# Identifiers, label and predictors.
ID_COLUMNS = ["application_id", "customer_id"]
LABEL = "default_flag"
NOMINAL_PREDICTORS = ["business_type", "loan_purpose"]
NUMERIC_PREDICTORS = [
    "business_age_years", "number_of_employees_imputed", "monthly_revenue", "annual_revenue",
    "requested_loan_amount", "loan_tenure_months", "existing_loans", "existing_monthly_debt",
    "debt_to_income_ratio", "bureau_score_imputed", "credit_history_years", "previous_defaults",
    "collateral_value_imputed", "bank_account_age_years_imputed", "loan_to_annual_revenue_ratio",
    "collateral_coverage_ratio", "monthly_debt_to_revenue_ratio", "revenue_per_employee",
    "requested_amount_per_tenure_month", "has_previous_default", "has_existing_loan",
    "number_of_employees_missing", "bureau_score_missing", "collateral_value_missing",
    "bank_account_age_years_missing",
]
PREDICTORS = NOMINAL_PREDICTORS + NUMERIC_PREDICTORS
# Fixed values. Known only after the credit decision: never allowed among predictors.
LEAKAGE_COLUMNS = [
    "outstanding_balance", "days_past_due", "missed_payments", "total_payments", "loan_status",
    "application_status", "credit_review_date", "approval_date", "disbursement_date",
    "approved_amount", "application_to_review_days", "review_to_approval_days",
    "approval_to_disbursement_days", "application_to_approval_days",
    "application_to_disbursement_days",
]
# The nineteen measures profiled in the numeric summary: predictors without the 0/1 flags.
PROFILED_COLUMNS = [name for name in NUMERIC_PREDICTORS
                    if not name.startswith("has_") and not name.endswith("_missing")]
