"""SQL for sources and sinks, the grouped split, the recipes and stream scoring."""

from oracles.base import query
from oracles.models import SCORED, model_sql
from oracles.portfolio import EXPOSURE, FLAT_PLAIN
from oracles.quality import (
    CLEAN_CTES, CLEAN_PLAIN, FLAT_NAMES, MODEL_CTES, NUMERIC, quality_sql)

SPLIT = """sizes AS (
  SELECT customer_id, count(*) AS n,
         ((customer_id % 2147483648) * 2654435761) % 4294967296 AS k
  FROM model GROUP BY customer_id),
sides AS (
  SELECT customer_id, (k % 5 + 1)::INT AS fold,
         CASE WHEN sum(n) OVER (ORDER BY k, customer_id) * 100 <= sum(n) OVER () * 80
              THEN 'train' ELSE 'test' END AS side FROM sizes),
split AS (SELECT model.*, side, fold FROM model JOIN sides USING (customer_id))"""
SPLIT_CTES = (*MODEL_CTES, SPLIT)

REPORT = """count(*) AS "rows", count(DISTINCT customer_id) AS customers,
  sum(default_flag)::BIGINT AS defaults, sum(1 - default_flag)::BIGINT AS non_defaults,
  sum(default_flag)::DOUBLE / count(*)::DOUBLE AS default_rate"""

LONG_TRAIN = """long AS (
  SELECT feature, "value" FROM (
    UNPIVOT (SELECT """ + ", ".join(NUMERIC) + """ FROM split WHERE side = 'train')
    ON COLUMNS(*) INTO NAME feature VALUE "value")
  UNION ALL
  SELECT 'business_type_' || regexp_replace(level, '\\W+', '_', 'g'),
         (business_type = level)::INT::DOUBLE
  FROM split, (SELECT DISTINCT business_type AS level FROM split WHERE side = 'train')
  WHERE side = 'train' AND level > (SELECT min(business_type) FROM split WHERE side = 'train')
  UNION ALL
  SELECT 'loan_purpose_' || regexp_replace(level, '\\W+', '_', 'g'),
         (loan_purpose = level)::INT::DOUBLE
  FROM split, (SELECT DISTINCT loan_purpose AS level FROM split WHERE side = 'train')
  WHERE side = 'train' AND level > (SELECT min(loan_purpose) FROM split WHERE side = 'train'))"""

DAMAGED_CAST = """casts AS (SELECT * REPLACE (
    CASE WHEN application_id % 17 = 0 THEN NULL ELSE bureau_score END AS bureau_score,
    CASE WHEN application_id % 19 = 0 THEN NULL ELSE approved_amount END AS approved_amount,
    CASE WHEN application_id % 23 = 0 THEN NULL ELSE application_date END
      AS application_date) FROM (""" + FLAT_PLAIN + "))"


def _cast_report() -> str:
    broken = {"bureau_score": 17, "approved_amount": 19, "application_date": 23}
    parts = []
    for name in FLAT_NAMES:
        hit = f"application_id % {broken[name]} = 0" if name in broken else "false"
        parts.append(
            f"SELECT '{name}' AS \"column\", "
            f"count(*) FILTER (WHERE {name} IS NULL AND NOT ({hit})) AS missing, "
            f"count(*) FILTER (WHERE {hit}) AS failed FROM flat")
    return query("\nUNION ALL\n".join(parts))


ACCEPTED = """annual_revenue > 0 AND monthly_revenue > 0 AND requested_loan_amount > 0
  AND loan_tenure_months > 0 AND debt_to_income_ratio BETWEEN 0 AND 1
  AND bureau_score BETWEEN 300 AND 850 AND business_age_years IS NOT NULL
  AND existing_loans IS NOT NULL AND existing_monthly_debt IS NOT NULL
  AND credit_history_years IS NOT NULL AND previous_defaults IS NOT NULL"""
NEEDED = ["business_age_years", "existing_loans", "existing_monthly_debt",
          "credit_history_years", "previous_defaults"]
PROBLEMS = [
    ("annual_revenue > 0", "annual_revenue must be positive"),
    ("monthly_revenue > 0", "monthly_revenue must be positive"),
    ("requested_loan_amount > 0", "requested_loan_amount must be positive"),
    ("loan_tenure_months > 0", "loan_tenure_months must be positive"),
    *[(f"{name} IS NOT NULL", f"{name} must be given") for name in NEEDED],
    ("debt_to_income_ratio BETWEEN 0 AND 1", "debt_to_income_ratio must be within 0 and 1"),
    ("bureau_score BETWEEN 300 AND 850", "bureau_score must be within 300 and 850")]
STREAM_PREDS = f"""preds AS (
  SELECT 'Model A' AS model, application_id, customer_id, default_flag,
         (1 + (application_id * 7919) % 997)::DOUBLE / 1000 AS predicted_pd
  FROM flat WHERE {ACCEPTED})"""


def _balance() -> str:
    parts = ["SELECT 'all' AS variable, 'all' AS level, round(avg(default_flag), 3) AS "
             "default_rate FROM split WHERE side = 'train'"]
    parts += [f"SELECT '{c}', {c}, round(avg(default_flag), 3) FROM split WHERE side = 'train' "
              f"GROUP BY {c}" for c in ("business_type", "loan_purpose")]
    return query("\nUNION ALL\n".join(parts), *SPLIT_CTES)


def _once(by: str, side: str) -> str:
    """Each row of a side is scored once, with a probability."""
    return query(f"SELECT {by}, count(*) AS \"rows\", count(DISTINCT application_id) AS "
                 f"applications, 1 AS \"within\" FROM split WHERE side = '{side}' GROUP BY {by}",
                 *SPLIT_CTES)


# Terms of the models: the columns that are not constant on the training side.
TERMS = "SELECT feature FROM long GROUP BY feature HAVING min(\"value\") < max(\"value\")"
GRID_SQL = """SELECT mtry, min_n, metric, count(DISTINCT fold) AS n, 1 AS "within"
  FROM (SELECT unnest([3, 6, 9, 12])::INT AS mtry),
       (SELECT unnest([5, 15, 25])::INT AS min_n),
       (SELECT unnest(['roc_auc', 'pr_auc', 'accuracy', 'precision', 'recall', 'specificity',
                       'f_meas']) AS metric),
       (SELECT fold FROM split WHERE side = 'train')
  GROUP BY mtry, min_n, metric"""
GRID_ROWS_SQL = """SELECT mtry, min_n, count(*) AS "rows",
         count(DISTINCT application_id) AS applications, 1 AS "within"
  FROM (SELECT unnest([3, 6, 9, 12])::INT AS mtry),
       (SELECT unnest([5, 15, 25])::INT AS min_n),
       (SELECT application_id FROM split WHERE side = 'train')
  GROUP BY mtry, min_n"""
MODELS = "(SELECT unnest(['Logistic Regression', 'Random Forest']) AS model)"


def stage_sql() -> dict[str, str]:
    problems = ", ".join(f"CASE WHEN NOT coalesce({test}, false) THEN '{text}' END"
                         for test, text in PROBLEMS)
    return {
        "src_csv": query(FLAT_PLAIN),
        "src_csv_inferred": query(CLEAN_PLAIN, *CLEAN_CTES),
        "sink_csv": query(EXPOSURE),
        "src_csv_quarantine": query(
            FLAT_PLAIN + " WHERE application_id % 17 <> 0 AND application_id % 19 <> 0 "
            "AND application_id % 23 <> 0"),
        "src_csv_rejects": query("""SELECT application_id, concat_ws('; ',
            CASE WHEN application_id % 23 = 0 THEN 'application_date is no date' END,
            CASE WHEN application_id % 17 = 0 THEN 'bureau_score is no int' END,
            CASE WHEN application_id % 19 = 0 THEN 'approved_amount is no decimal(18,2)' END)
            AS reasons FROM flat WHERE application_id % 17 = 0 OR application_id % 19 = 0
            OR application_id % 23 = 0"""),
        "sink_model_manifest": query(f"""SELECT 'split' AS part, count(*) AS "rows" FROM split
            UNION ALL SELECT 'train', count(*) FROM split WHERE side = 'train'
            UNION ALL SELECT 'medians', 4 UNION ALL
            SELECT 'model', count(*) FROM ({TERMS})""", *SPLIT_CTES, LONG_TRAIN),
        "sc_apply_stream_commits": query(f"""SELECT count(*) AS arrived,
            (count(*) FILTER (WHERE {ACCEPTED})) AS scored,
            (count(*) FILTER (WHERE NOT coalesce({ACCEPTED}, false))) AS rejected FROM flat"""),
        "src_require_columns": query("\nUNION ALL\n".join(
            f"SELECT '{c}' AS \"column\", count({c}) AS filled, 1 AS present FROM flat"
            for c in FLAT_NAMES)),
        "src_cast": query("SELECT * FROM casts", DAMAGED_CAST),
        "src_cast_report": _cast_report(),
        "src_require_artifacts": "\nUNION ALL\n".join(
            f"SELECT '{t}' AS artifact, count(*) AS \"rows\" FROM {t}"
            for t in ("customer", "lineitem", "orders", "part")),
        "sink_findings": f"SELECT line FROM ({model_sql()['eda_findings']})",
        "ml_group_split": query("SELECT application_id, customer_id, side FROM split",
                                *SPLIT_CTES),
        "rel_full_outer_join": quality_sql()["dq_orphans_damaged"],
        "rel_semi_join": query("SELECT application_id, customer_id FROM split "
                               "WHERE side = 'train'", *SPLIT_CTES),
        "rel_anti_join": query("SELECT application_id, customer_id FROM split "
                               "WHERE side = 'test'", *SPLIT_CTES),
        "rel_intersect": query("""
            SELECT customer_id FROM flat WHERE application_status = 'Rejected' INTERSECT
            SELECT customer_id FROM flat WHERE application_status = 'Disbursed'"""),
        "rel_except": query("""
            SELECT customer_id FROM flat EXCEPT
            SELECT customer_id FROM flat WHERE application_status = 'Disbursed'"""),
        "ml_logistic_balance": _balance(),
        "ml_lr_terms": query(f"SELECT feature AS term FROM ({TERMS}) UNION ALL "
                             "SELECT '(Intercept)'", *SPLIT_CTES, LONG_TRAIN),
        "ml_rf_importance_check": query(
            f"SELECT feature AS variable, 1 AS \"within\", 1 AS whole FROM ({TERMS})",
            *SPLIT_CTES, LONG_TRAIN),
        "ml_cv_check": _once("fold", "train"),
        "ml_rf_cv_check": _once("fold", "train"),
        "ml_random_forest_check": _once("side", "test"),
        "ml_rf_tuning_grid": query(GRID_SQL, *SPLIT_CTES),
        "ml_rf_tuning_check": query(GRID_ROWS_SQL, *SPLIT_CTES),
        "ml_holdout_check": query(f"""SELECT model, count(*) AS "rows",
            sum(default_flag)::BIGINT AS defaults, 0::BIGINT AS left_out
            FROM split, {MODELS} WHERE side = 'test' GROUP BY model""", *SPLIT_CTES),
        "ml_holdout_bins": query(f"""SELECT model, bin, count(*) AS observations FROM
            (SELECT ntile(10) OVER (ORDER BY application_id)::INT AS bin FROM split
             WHERE side = 'test'), {MODELS} GROUP BY model, bin""", *SPLIT_CTES),
        "sc_apply_model_check": query(
            "SELECT application_id, 1 AS follows FROM split WHERE side = 'test'", *SPLIT_CTES),
        "sink_model_check": query(
            "SELECT count(*) AS \"rows\", 0::BIGINT AS differing FROM split", *SPLIT_CTES),
        "sc_apply_stream_model_check": query(
            f"SELECT application_id, 1 AS scored FROM flat WHERE {ACCEPTED}"),
        "ml_split_check": query("""SELECT
            (SELECT count(*) FROM (SELECT customer_id FROM split WHERE side = 'train'
             INTERSECT SELECT customer_id FROM split WHERE side = 'test')) AS overlap,
            (SELECT (count(DISTINCT default_flag) = 2)::INT FROM split WHERE side = 'train')
              AS train_has_both_classes,
            (SELECT (count(DISTINCT default_flag) = 2)::INT FROM split WHERE side = 'test')
              AS test_has_both_classes""", *SPLIT_CTES),
        "ml_partition_report": query(f"SELECT side, {REPORT} FROM split GROUP BY side",
                                     *SPLIT_CTES),
        "ml_group_folds": query("SELECT application_id, customer_id, fold FROM split "
                                "WHERE side = 'train'", *SPLIT_CTES),
        "ml_fold_report": query(f"SELECT fold, {REPORT} FROM split WHERE side = 'train' "
                                "GROUP BY fold", *SPLIT_CTES),
        "ml_fold_check": query("""
            SELECT 'overlap' AS "check", (SELECT count(*) FROM (
              SELECT customer_id FROM split WHERE side = 'train' GROUP BY 1
              HAVING count(DISTINCT fold) > 1)) AS violations
            UNION ALL SELECT 'missing_class', (SELECT count(*) FROM (
              SELECT fold FROM split WHERE side = 'train' GROUP BY 1
              HAVING count(DISTINCT default_flag) < 2))""", *SPLIT_CTES),
        "ml_recipe_lr": query("""SELECT feature,
            round((min("value") - avg("value")) / stddev_samp("value"), 6) AS low,
            round((max("value") - avg("value")) / stddev_samp("value"), 6) AS high
            FROM long GROUP BY feature HAVING min("value") < max("value")""",
            *SPLIT_CTES, LONG_TRAIN),
        "ml_recipe_rf": query("""SELECT feature, round(min("value"), 6) AS low,
            round(max("value"), 6) AS high, round(avg("value"), 4) AS mean,
            round(stddev_samp("value"), 4) AS deviation
            FROM long GROUP BY feature HAVING min("value") < max("value")""",
            *SPLIT_CTES, LONG_TRAIN),
        "sc_apply_stream": query(
            "SELECT application_id, customer_id, predicted_pd, credit_score, risk_band, "
            "risk_monitoring_flag FROM scored", STREAM_PREDS, SCORED),
        "sc_apply_stream_rejects": query(
            f"SELECT application_id, customer_id, concat_ws('; ', {problems}) AS problems "
            f"FROM flat WHERE NOT coalesce({ACCEPTED}, false)"),
    }
