"""SQL for statistics, evaluation, scorecard and dashboard tables."""

from oracles.base import DISBURSED, GRANTED, count_if, query, total

from oracles.quality import CLEAN_CTES, MODEL_CTES, NUMERIC

PROFILED = [c for c in NUMERIC if not c.startswith("has_") and not c.endswith("_missing")]
CORRELATED = ["bureau_score_imputed", "debt_to_income_ratio", "business_age_years",
              "loan_to_annual_revenue_ratio", "collateral_coverage_ratio",
              "monthly_debt_to_revenue_ratio"]


def cut(column: str, cuts: list, labels: list[str], right: bool = False) -> str:
    sign = "<=" if right else "<"
    whens = " ".join(f"WHEN {column} {sign} {c} THEN '{x}'" for c, x in zip(cuts, labels))
    return f"CASE WHEN {column} IS NULL THEN NULL {whens} ELSE '{labels[-1]}' END"


EDA = "eda AS (SELECT model.*, " + ", ".join([
    cut("bureau_score_imputed", [550, 650, 700, 750],
        ["<550", "550-649", "650-699", "700-749", "750+"]) + " AS bureau_band",
    cut("debt_to_income_ratio", ["0.2::DOUBLE", "0.35::DOUBLE", "0.5::DOUBLE"],
        ["<20%", "20%-34.99%", "35%-49.99%", "50%+"]) + " AS dti_band",
    cut("business_age_years", [3, 5, 10],
        ["<3 years", "3-4.99 years", "5-9.99 years", "10+ years"]) + " AS age_band",
    cut("loan_to_annual_revenue_ratio", ["0.15::DOUBLE", "0.25::DOUBLE", "0.4::DOUBLE"],
        ["<15%", "15%-24.99%", "25%-39.99%", "40%+"]) + " AS lr_band",
    cut("requested_loan_amount", [25000, 50000, 100000],
        ["<25k", "25k-49.99k", "50k-99.99k", "100k+"]) + " AS amt_band",
]) + " FROM model)"
EDA_CTES = (*MODEL_CTES, EDA)
SEGMENTS = ["bureau_band", "dti_band", "age_band", "has_previous_default::INT",
            "business_type", "loan_purpose", "lr_band", "amt_band"]
RATES = "\nUNION ALL\n".join(
    f"SELECT '{c.replace('::INT', '')}' AS variable, ({c})::VARCHAR AS segment, "
    f"count(*) AS loans, sum(default_flag)::BIGINT AS defaults, "
    f"sum(default_flag)::DOUBLE / count(*)::DOUBLE AS default_rate FROM eda GROUP BY {c}"
    for c in SEGMENTS)


def normal_tail(z: str) -> str:
    """Two-sided normal tail by Simpson's rule over ten units past |z|."""
    return (f"(SELECT round(2 * (10.0 / 2000) / 3 / sqrt(2 * pi()) * sum("
            f"(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
            f"* exp(-pow(abs({z}) + i * 10.0 / 2000, 2) / 2)), 6) "
            f"FROM range(0, 2001) steps(i))")


def _chi(column: str) -> str:
    return f"""SELECT '{column}' AS variable, sum(
        pow(abs(good - e0) - k0, 2) / e0 + pow(abs(bad - e1) - k1, 2) / e1) AS statistic,
        (count(*) - 1)::BIGINT AS freedom, max(n)::BIGINT AS n
      FROM (SELECT *, CASE WHEN cats = 2 THEN least(0.5, abs(good - e0)) ELSE 0 END AS k0,
                   CASE WHEN cats = 2 THEN least(0.5, abs(bad - e1)) ELSE 0 END AS k1
            FROM (SELECT *, (good + bad)::DOUBLE * g / n AS e0,
                         (good + bad)::DOUBLE * b / n AS e1
                  FROM (SELECT {column} AS c, {count_if("default_flag = 0")} AS good,
                               {count_if("default_flag = 1")} AS bad,
                               sum({count_if("default_flag = 0")}) OVER () AS g,
                               sum({count_if("default_flag = 1")}) OVER () AS b,
                               sum(count(*)) OVER () AS n, count(*) OVER () AS cats
                        FROM model GROUP BY {column})))"""


CHI = ("chi AS (" + "\nUNION ALL\n".join(
    _chi(c) for c in ("business_type", "loan_purpose", "has_previous_default")) + ")")
CHI_P = ("CASE freedom WHEN 1 THEN " + normal_tail("sqrt(statistic)")
         + " WHEN 4 THEN round(exp(-statistic / 2) * (1 + statistic / 2), 6) END")


def _ranks(column: str) -> str:
    return f"""SELECT '{column}' AS variable, (w - n0 * (n0 + 1) / 2.0)::DOUBLE AS statistic,
        (SELECT sum(pow(c, 3) - c) FROM (SELECT count(*)::DOUBLE AS c FROM model
           WHERE {column} IS NOT NULL GROUP BY {column})) AS ties,
        n0::DOUBLE AS n0, n1::DOUBLE AS n1, (n0 + n1)::BIGINT AS n
      FROM (SELECT sum(CASE WHEN default_flag = 0 THEN mid END) AS w,
                   {count_if("default_flag = 0")} AS n0, {count_if("default_flag = 1")} AS n1
            FROM (SELECT default_flag, (rank() OVER (ORDER BY {column})
                         + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0) AS mid
                  FROM model WHERE {column} IS NOT NULL))"""


RANKS = ("ranks AS (" + "\nUNION ALL\n".join(_ranks(c) for c in CORRELATED[:4]) + """),
rank_z AS (SELECT variable, statistic, n,
  ((statistic - n0 * n1 / 2) - sign(statistic - n0 * n1 / 2) * 0.5)
  / sqrt(n0 * n1 / 12 * (n0 + n1 + 1 - ties / ((n0 + n1) * (n0 + n1 - 1)))) AS z FROM ranks)""")


def _histogram(column: str) -> str:
    return f"""SELECT '{column}' AS field, b::INT AS bin,
        (lo + ((hi - lo) * 100 * (b - 1))::HUGEINT // 40 * 0.01::DECIMAL(3,2))::DECIMAL(18,2)
          ::DOUBLE AS lower,
        (SELECT count(*) FROM flat
         WHERE least(40, ((({column} - lo) * 100)::HUGEINT * 40)
                         // ((hi - lo) * 100)::HUGEINT + 1) = b) AS "count"
      FROM (SELECT min({column}) AS lo, max({column}) AS hi FROM flat), range(1, 41) bins(b)"""


PREDS = f"""preds AS (
  SELECT 'Model A' AS model, application_id, customer_id, default_flag,
         (1 + (application_id * 7919) % 997)::DOUBLE / 1000 AS predicted_pd
  FROM flat WHERE {DISBURSED}
  UNION ALL
  SELECT 'Model B', application_id, customer_id, default_flag,
         (1 + (application_id * 104729) % 991)::DOUBLE / 1000
  FROM flat WHERE {DISBURSED}),
counted AS (
  SELECT model, predicted_pd, sum(default_flag)::BIGINT AS bad,
         sum(1 - default_flag)::BIGINT AS good FROM preds GROUP BY ALL),
curve AS (
  SELECT *, sum(bad) OVER w AS cum_bad, sum(good) OVER w AS cum_good,
         sum(bad) OVER g AS p, sum(good) OVER g AS n FROM counted
  WINDOW w AS (PARTITION BY model ORDER BY predicted_pd), g AS (PARTITION BY model)),
cells AS (
  SELECT model,
    count(*) FILTER (WHERE predicted_pd >= 0.5 AND default_flag = 1) AS tp,
    count(*) FILTER (WHERE predicted_pd >= 0.5 AND default_flag = 0) AS fp,
    count(*) FILTER (WHERE predicted_pd < 0.5 AND default_flag = 0) AS tn,
    count(*) FILTER (WHERE predicted_pd < 0.5 AND default_flag = 1) AS fn
  FROM preds GROUP BY model),
classes AS (
  SELECT model, (tp + tn)::DOUBLE / (tp + fp + tn + fn) AS accuracy,
         tp::DOUBLE / nullif(tp + fp, 0) AS "precision", tp::DOUBLE / nullif(tp + fn, 0) AS recall,
         tn::DOUBLE / nullif(tn + fp, 0) AS specificity,
         2.0 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM cells),
ranking AS (
  SELECT model,
    sum(good * (2 * (p - cum_bad) + bad))::DOUBLE / max(2 * p * n)::DOUBLE AS roc_auc,
    max(abs(cum_bad::DOUBLE / p - cum_good::DOUBLE / n)) AS ks,
    sum(bad::DOUBLE / p
        * ((p - cum_bad + bad)::DOUBLE / (p - cum_bad + bad + n - cum_good + good)
           + coalesce((p - cum_bad)::DOUBLE / nullif(p - cum_bad + n - cum_good, 0), 1)) / 2)
      AS pr_auc
  FROM curve GROUP BY model),
brier AS (SELECT model, avg(pow(default_flag - predicted_pd, 2)) AS brier_score
  FROM preds GROUP BY model),
metrics AS (
  SELECT model, roc_auc, pr_auc, 2 * roc_auc - 1 AS gini, ks, brier_score, accuracy,
         "precision", recall, specificity, f1
  FROM ranking JOIN brier USING (model) JOIN classes USING (model))"""

SCORED = """scored AS (
  SELECT application_id, customer_id, default_flag, predicted_pd, credit_score,
    CASE WHEN credit_score <= 549 THEN 'Very High Risk' WHEN credit_score <= 599 THEN 'High Risk'
         WHEN credit_score <= 649 THEN 'Elevated Risk'
         WHEN credit_score <= 699 THEN 'Moderate Risk'
         WHEN credit_score <= 749 THEN 'Low Risk' ELSE 'Very Low Risk' END AS risk_band,
    CASE WHEN credit_score > 699 THEN 'Routine monitoring'
         WHEN credit_score > 649 THEN 'Standard review' ELSE 'Enhanced review' END
      AS risk_monitoring_flag
  FROM (SELECT *, round_even(least(greatest(
            600 - 50 / ln(2) * ln(20) + 50 / ln(2) * ln((1 - predicted_pd) / predicted_pd),
            300), 850), 0)::INT AS credit_score
        FROM preds WHERE model = 'Model A'))"""
RISK_LEVELS = ["Very Low Risk", "Low Risk", "Moderate Risk", "Elevated Risk", "High Risk",
               "Very High Risk"]
BAND_SUMMARY = """band_summary AS (
  SELECT level AS risk_band, pos, count(application_id) AS applicants,
         round(avg(predicted_pd), 9) AS mean_predicted_pd,
         coalesce(sum(default_flag), 0)::BIGINT AS actual_defaults,
         sum(default_flag)::DOUBLE / nullif(count(application_id), 0) AS actual_default_rate,
         round(sum(credit_score)::DOUBLE / nullif(count(application_id), 0), 9)
           AS mean_credit_score
  FROM (VALUES """ + ", ".join(
    f"('{level}', {i})" for i, level in enumerate(RISK_LEVELS)) + """) levels(level, pos)
  LEFT JOIN scored ON risk_band = level GROUP BY level, pos)"""
SCORED_CTES = (PREDS, SCORED, BAND_SUMMARY)


def _metric(*names: str) -> str:
    listed = ", ".join(f'round("{n}", 10) AS "{n}"' for n in names)
    return query(f"SELECT model, {listed} FROM metrics", PREDS)


METRICS = ["roc_auc", "pr_auc", "gini", "ks", "brier_score", "accuracy", "precision", "recall",
           "specificity", "f1"]


def _check(name: str, violations: str, source: str) -> str:
    return (f"SELECT '{name}' AS \"check\", ({violations})::BIGINT AS violations, "
            f"(({violations}) = 0)::INT AS pass FROM {source}")


def _rate(label: str, name: str, order: str = "") -> str:
    return query(f"""SELECT {label} AS {name},
      sum(default_flag)::DOUBLE / count(*)::DOUBLE AS default_rate
      FROM clean WHERE {DISBURSED} GROUP BY 1""", *CLEAN_CTES)


def model_sql() -> dict[str, str]:
    chi = query(f"""SELECT variable, round(statistic, 6) AS statistic, freedom, n,
        {CHI_P} AS p_value FROM chi""", *MODEL_CTES, CHI)
    wilcoxon = query(f"""SELECT variable, statistic, round(z, 6) AS z, n,
        {normal_tail("z")} AS p_value FROM rank_z""", *MODEL_CTES, RANKS)
    tests = query(f"""SELECT 'Chi-square' AS test, variable, round(statistic, 6) AS statistic,
        {CHI_P} AS p_value, n FROM chi
        UNION ALL SELECT 'Wilcoxon', variable, round(statistic, 6), {normal_tail("z")}, n
        FROM rank_z""", *MODEL_CTES, CHI, RANKS)
    return {
        "eda_numeric_summary": query("\nUNION ALL\n".join(
            f"""SELECT '{c}' AS variable, count({c}) AS "count", round(avg({c}), 4) AS mean,
            round(quantile_cont({c}, 0.5), 9) AS median, round(stddev_samp({c}), 4) AS sd,
            round(min({c}), 9) AS "min", round(quantile_cont({c}, 0.25), 9) AS p25,
            round(quantile_cont({c}, 0.75), 9) AS p75, round(max({c}), 9) AS "max" FROM model"""
            for c in PROFILED), *MODEL_CTES),
        "eda_default_rate_tables": query(RATES, *EDA_CTES),
        "eda_correlation": query("\nUNION ALL\n".join(
            f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) AS correlation "
            f"FROM model" for a in CORRELATED for b in CORRELATED), *MODEL_CTES),
        "eda_monthly": query(f"""SELECT strftime(application_date, '%Y-%m') AS month,
            count(*) AS applications,
            {count_if(GRANTED)}::DOUBLE / count(*)::DOUBLE AS approval,
            {count_if(DISBURSED)}::DOUBLE / count(*)::DOUBLE AS disbursed
            FROM flat GROUP BY 1"""),
        "eda_category_counts": query("\nUNION ALL\n".join(
            f"SELECT '{c}' AS field, {c} AS category, count(*) AS \"count\" FROM flat GROUP BY {c}"
            for c in ("application_status", "business_type", "loan_purpose"))),
        "eda_histogram": query(_histogram("requested_loan_amount") + "\nUNION ALL\n"
                               + _histogram("approved_amount")),
        "eda_chi_square": chi,
        "eda_wilcoxon": wilcoxon,
        "eda_statistical_tests": tests,
        "eda_findings": query("""SELECT 0 AS position, printf(
              'Disbursed population: %d loans with %.2f%% defaults.', sum(loans)::BIGINT,
              round(100 * (sum(defaults)::DOUBLE / sum(loans)::DOUBLE), 2)) AS line
            FROM rates WHERE variable = 'has_previous_default'
            UNION ALL SELECT 1, printf('Prior-default rate: %.2f%% versus %.2f%%.',
              round(max(CASE WHEN segment = '1' THEN default_rate * 100 END), 2),
              round(max(CASE WHEN segment = '0' THEN default_rate * 100 END), 2))
            FROM rates WHERE variable = 'has_previous_default'
            UNION ALL SELECT 2, printf('Bureau-band rates range from %.2f%% to %.2f%%.',
              round(min(default_rate * 100), 2), round(max(default_rate * 100), 2))
            FROM rates WHERE variable = 'bureau_band'""", *EDA_CTES, f"rates AS ({RATES})"),
        "ev_predict": query("""SELECT *, CASE WHEN predicted_pd >= 0.5 THEN 'default'
            ELSE 'non_default' END AS predicted_class FROM preds""", PREDS),
        "ev_confusion": query("\nUNION ALL\n".join(
            f"SELECT model, '{c.upper()}' AS statistic, {c} AS \"value\" FROM cells"
            for c in ("tp", "fp", "tn", "fn")), PREDS),
        "ev_threshold_metrics":
            _metric("accuracy", "precision", "recall", "specificity", "f1"),
        "ev_roc_auc": _metric("roc_auc"),
        "ev_gini": _metric("gini"),
        "ev_pr_auc": _metric("pr_auc"),
        "ev_ks": _metric("ks"),
        "ev_brier": _metric("brier_score"),
        "ev_compare": query("SELECT model, " + ", ".join(
            f'round("{n}", 10) AS "{n}"' for n in METRICS)
            + ", 0.5::DOUBLE AS threshold FROM metrics", PREDS),
        "ev_roc_curve": query("""SELECT model, predicted_pd AS threshold,
              (cum_good - good)::DOUBLE / n::DOUBLE AS specificity,
              (p - cum_bad + bad)::DOUBLE / p::DOUBLE AS sensitivity FROM curve
            UNION ALL SELECT DISTINCT model, '-inf'::DOUBLE, 0::DOUBLE, 1::DOUBLE FROM preds
            UNION ALL SELECT DISTINCT model, 'inf'::DOUBLE, 1::DOUBLE, 0::DOUBLE
            FROM preds""", PREDS),
        "ev_pr_curve": query("""SELECT model, predicted_pd AS threshold,
              (p - cum_bad + bad)::DOUBLE / p::DOUBLE AS recall,
              (p - cum_bad + bad)::DOUBLE
                / (p - cum_bad + bad + n - cum_good + good)::DOUBLE AS "precision" FROM curve
            UNION ALL SELECT DISTINCT model, 'inf'::DOUBLE, 0::DOUBLE, 1::DOUBLE
            FROM preds""", PREDS),
        "ev_calibration": query("""SELECT model, bin::INT AS bin,
            round(avg(predicted_pd), 9) AS mean_predicted_probability,
            sum(default_flag)::DOUBLE / count(*)::DOUBLE AS actual_default_rate,
            count(*) AS observations
            FROM (SELECT *, ntile(10) OVER (PARTITION BY model
                    ORDER BY predicted_pd, application_id) AS bin FROM preds)
            GROUP BY model, bin""", PREDS),
        "sc_score": query(
            "SELECT application_id, predicted_pd, credit_score FROM scored", *SCORED_CTES),
        "sc_band": query(
            "SELECT application_id, credit_score, risk_band FROM scored", *SCORED_CTES),
        "sc_monitoring": query(
            "SELECT application_id, risk_band, risk_monitoring_flag FROM scored", *SCORED_CTES),
        "sc_apply": query("SELECT * FROM scored", *SCORED_CTES),
        "sc_math_checks": query("\nUNION ALL\n".join([
            _check("points_follow_odds", count_if(
                "abs(raw - (600 + 50 * log2(odds / 20))) > 1e-8"), "raw_scores"),
            _check("double_odds_add_points", count_if(
                "abs(600 - 50 / ln(2) * ln(20) + 50 / ln(2) * ln(2 * odds) - raw - 50) > 1e-8"),
                "raw_scores"),
            _check("points_fall_with_pd", count_if("next_raw >= raw"), "raw_scores")]),
            PREDS, """raw_scores AS (
              SELECT *, lead(raw) OVER (ORDER BY predicted_pd) AS next_raw
              FROM (SELECT predicted_pd, (1 - predicted_pd) / predicted_pd AS odds,
                      600 - 50 / ln(2) * ln(20)
                      + 50 / ln(2) * ln((1 - predicted_pd) / predicted_pd) AS raw
                    FROM (SELECT DISTINCT predicted_pd FROM preds)))"""),
        "sc_output_checks": query("\nUNION ALL\n".join([
            _check("pd_range", count_if("NOT predicted_pd BETWEEN 0 AND 1"), "scored"),
            _check("score_range", count_if("NOT credit_score BETWEEN 300 AND 850"), "scored"),
            _check("score_finite", count_if("isinf(credit_score::DOUBLE)"), "scored"),
            _check("score_present", count_if("credit_score IS NULL"), "scored"),
            _check("band_domain", count_if("risk_band NOT IN ("
                   + ", ".join(f"'{x}'" for x in RISK_LEVELS) + ")"), "scored"),
            _check("score_monotone", count_if("credit_score > before"),
                   "(SELECT credit_score, lag(credit_score) OVER (ORDER BY predicted_pd, "
                   "credit_score DESC) AS before FROM scored)")]), *SCORED_CTES),
        "sc_summary": query("""
            SELECT 'observations' AS metric, count(*)::DOUBLE AS "value" FROM scored
            UNION ALL SELECT 'mean_score', round(avg(credit_score), 9) FROM scored
            UNION ALL SELECT 'median_score', quantile_cont(credit_score, 0.5) FROM scored
            UNION ALL SELECT 'min_score', min(credit_score) FROM scored
            UNION ALL SELECT 'max_score', max(credit_score) FROM scored
            UNION ALL SELECT 'score_25th_percentile', quantile_cont(credit_score, 0.25)
              FROM scored
            UNION ALL SELECT 'score_75th_percentile', quantile_cont(credit_score, 0.75)
              FROM scored""", *SCORED_CTES),
        "sc_band_summary": query("SELECT * EXCLUDE (pos) FROM band_summary", *SCORED_CTES),
        "sc_band_monotone": query("""SELECT count(*) AS bands,
            (count(*) FILTER (WHERE actual_default_rate < before) = 0)::INT AS rises_with_risk
            FROM (SELECT *, lag(actual_default_rate) OVER (ORDER BY pos) AS before
                  FROM band_summary WHERE applicants > 0)""", *SCORED_CTES),
        "sc_histogram": query("""SELECT (credit_score // 10 * 10)::INT AS score_from,
            count(*) AS applicants FROM scored GROUP BY 1""", *SCORED_CTES),
        "db_kpis": query(f"""SELECT count(*) AS total_applications,
            count(DISTINCT customer_id) AS unique_customers,
            {count_if(GRANTED)}::DOUBLE / count(*) AS approval_rate,
            {count_if(DISBURSED)}::DOUBLE / count(*) AS disbursement_rate,
            {count_if(DISBURSED)} AS disbursed_loans,
            sum(default_flag)::DOUBLE / {count_if(DISBURSED)} AS default_rate,
            {total("approved_amount")} AS total_approved_amount,
            {total("outstanding_balance")} AS total_outstanding_balance FROM flat"""),
        **{name: query(f"SELECT {c}, count(*) AS n FROM flat GROUP BY {c}")
           for name, c in {"db_status_counts": "application_status",
                           "db_daily_counts": "application_date",
                           "db_type_counts": "business_type",
                           "db_purpose_counts": "loan_purpose"}.items()},
        "db_rate_bureau": _rate(cut("bureau_score_imputed", [549, 599, 649, 699],
                                    ["<550", "550-599", "600-649", "650-699", "700+"], True),
                                "bureau_band"),
        "db_rate_dti": _rate(cut("debt_to_income_ratio", ["0.2", "0.35", "0.5"],
                                 ["<=20%", "20-35%", "35-50%", ">50%"], True), "dti_band"),
        "db_rate_age": _rate(cut("business_age_years", [2, 5, 10],
                                 ["<=2", "3-5", "6-10", "10+"], True), "age_band"),
        "db_rate_history": _rate("CASE WHEN previous_defaults > 0 THEN 'Prior default' "
                                 "ELSE 'No prior default' END", "previous_history"),
        "db_rate_purpose": _rate("loan_purpose", "loan_purpose"),
        "db_metric_table": query("SELECT model, " + ", ".join(
            f'round_even("{n}", 4) AS "{n}"' for n in METRICS) + " FROM metrics", PREDS),
        "db_choices": query("""
            SELECT 'business_type' AS field, v AS choice,
              (row_number() OVER (ORDER BY v))::INT AS position
            FROM (SELECT DISTINCT business_type AS v FROM model)
            UNION ALL SELECT 'loan_purpose', v, (row_number() OVER (ORDER BY v))::INT
            FROM (SELECT DISTINCT loan_purpose AS v FROM model)
            UNION ALL SELECT 'loan_tenure_months', v::VARCHAR,
              (row_number() OVER (ORDER BY v))::INT
            FROM (SELECT DISTINCT loan_tenure_months::INT AS v FROM model)""", *MODEL_CTES),
    }
