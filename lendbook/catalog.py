"""Every registered query: name -> function of (session, driver-table directory)."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendbook import schemas as S
from lendbook.functions import scorecard as SC
from lendbook.operators import artifacts as ART
from lendbook.operators import evaluate as EV
from lendbook.operators import features as X
from lendbook.operators import forest_grid as G
from lendbook.operators import model as M
from lendbook.operators import profile as P
from lendbook.operators import quality as DQ
from lendbook.operators import split as SP
from lendbook.operators import stats as ST
from lendbook.plans import dashboard as DB
from lendbook.plans import pipeline as PIPE
from lendbook.plans import questions as Q
from lendbook.plans import scoring as PS
from lendbook.plans import views as V
from lendbook.session import work_folder
from lendbook.sources import files, star
from lendbook.sources.star import Portfolio, load_portfolio, plain
from lendbook.streaming import scoring as STREAM

Query = Callable[[SparkSession, str], DataFrame]


def _on_portfolio(build: Callable[[Portfolio], DataFrame]) -> Query:
    """Query over the portfolio, its entities taken from the one application record."""
    return lambda spark, sf_dir: plain(build(load_portfolio(spark, sf_dir)))


def _on_star(build: Callable[[Portfolio], DataFrame]) -> Query:
    """Query over the portfolio with its entity joins carried out."""
    return lambda spark, sf_dir: plain(build(load_portfolio(spark, sf_dir).as_star()))


def _portfolio_queries() -> dict[str, Query]:
    segments = {
        "q_seg_bureau": "bureau_score_band", "q_seg_dti": "dti_band",
        "q_seg_business_type": "business_type", "q_seg_loan_purpose": "loan_purpose",
        "q_seg_business_age": "business_age_band",
        "q_seg_amount": "requested_loan_amount_band",
        "q_seg_previous_default": "previous_default_band",
        "q_seg_loan_to_revenue": "loan_to_revenue_band",
        "q_seg_collateral": "collateral_coverage_band",
        "q_seg_existing_loans": "existing_loans",
    }
    return {
        "src_table": _on_portfolio(lambda p: p.applications),
        "norm_customers": _on_portfolio(lambda p: star.customers(p.flat)),
        "norm_applications": _on_portfolio(lambda p: star.applications(p.flat)),
        "norm_assessments": _on_portfolio(lambda p: star.assessments(p.flat)),
        "norm_decisions": _on_portfolio(lambda p: star.decisions(p.flat)),
        "norm_performance": _on_portfolio(lambda p: star.performance(p.flat)),
        "vw_application_funnel": _on_portfolio(V.application_funnel),
        "vw_monthly_credit_kpis": _on_star(V.monthly_credit_kpis),
        "vw_portfolio_performance": _on_star(V.portfolio_performance),
        "vw_default_analysis": _on_star(V.default_analysis),
        "vw_business_segment_performance": _on_star(V.business_segment_performance),
        "vw_customer_exposure": _on_star(V.customer_exposure),
        "q_portfolio_overview": _on_portfolio(Q.portfolio_overview),
        "q_funnel_current": _on_portfolio(Q.funnel_current),
        "q_funnel_reached": _on_portfolio(Q.funnel_reached),
        "q_processing_times": _on_portfolio(Q.processing_times),
        "q_processing_monthly": _on_portfolio(Q.processing_monthly),
        "q_monthly_kpis": _on_portfolio(Q.monthly_kpis),
        "q_monthly_trend": _on_portfolio(Q.monthly_trend),
        **{name: _on_portfolio(lambda p, c=column: Q.default_rate_by(p, c))
           for name, column in segments.items()},
        "q_seg_all": _on_portfolio(Q.default_rates_all),
        "q_status_mix": _on_portfolio(Q.status_mix),
        "q_par": _on_portfolio(Q.portfolio_at_risk),
        "q_conc_business": _on_portfolio(lambda p: Q.concentration_by(p, "business_type")),
        "q_conc_purpose": _on_portfolio(lambda p: Q.concentration_by(p, "loan_purpose")),
        "q_conc_bureau": _on_portfolio(Q.concentration_by_bureau),
        "q_top_customers": _on_portfolio(Q.top_customers),
        "q_cohort_snapshot": _on_portfolio(Q.cohort_snapshot),
        "q_repeat_customers": _on_portfolio(Q.repeat_customers),
        "q_repeat_summary": _on_portfolio(Q.repeat_summary),
        "q_reconciliation": _on_portfolio(Q.reconciliation),
        "q_view_rowcounts": _on_star(Q.view_row_counts),
        "q_seed_rowcounts": _on_star(Q.seed_row_counts),
        "q_seed_rates": _on_star(Q.seed_rates),
    }


def damaged(flat: DataFrame) -> DataFrame:
    """The application record spoiled in a fixed way, so that rules have something to find."""
    key = F.col("application_id")
    doubled = flat.unionAll(flat.where(key % 67 == 1))
    spoil = {
        "bureau_score": (17, F.col("bureau_score") + 600),
        "default_flag": (19, F.lit(2)),
        "application_status": (23, F.lit(None)),
        "loan_status": (29, F.lit("Lost")),
        "approved_amount": (31, F.col("requested_loan_amount") + 1),
        "approval_date": (37, F.lit(None)),
        "days_past_due": (41, F.lit(-1)),
        "customer_id": (43, F.lit(None)),
        "outstanding_balance": (47, F.lit(-5)),
        "loan_tenure_months": (53, F.lit(13)),
        "credit_review_date": (59, F.date_sub("application_date", 1)),
        "disbursement_date": (61, F.col("application_date")),
    }
    return doubled.withColumns({
        name: F.when(key % every == 0, value).otherwise(F.col(name))
        for name, (every, value) in spoil.items()})


def _quality_queries() -> dict[str, Query]:
    def rule(name: str) -> Query:
        return _on_portfolio(
            lambda p: DQ.run_rules(p.flat, {name: DQ.portfolio_rules()[name]}))

    def orphans(p: Portfolio) -> DataFrame:
        return DQ.orphans({"assessments": p.assessments, "decisions": p.decisions,
                           "performance": p.performance}, p.applications)

    def outer_joined(p: Portfolio) -> DataFrame:
        return DQ.orphans_by_outer_join(
            {"assessments": p.assessments, "decisions": p.decisions,
             "performance": p.performance}, p.applications)

    def references(p: Portfolio) -> DataFrame:
        return DQ.foreign_keys({
            "applications.customer_id": (p.applications, p.customers, "customer_id"),
            "assessments.application_id": (p.assessments, p.applications, "application_id"),
            "decisions.application_id": (p.decisions, p.applications, "application_id"),
            "performance.application_id": (p.performance, p.applications, "application_id"),
        })

    def without(p: Portfolio, **every: int) -> Portfolio:
        """Entities with some keys removed."""
        kept = {name: getattr(p, name).where(
            F.col("customer_id" if name == "customers" else "application_id") % n != 0)
            for name, n in every.items()}
        full = {name: getattr(p, name) for name in
                ("customers", "applications", "assessments", "decisions", "performance")}
        return Portfolio(**{**full, **kept})

    def expected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
        return DQ.row_count(load_portfolio(spark, sf_dir).flat, orders)

    rule_names = [
        "dq_not_null", "dq_flag_domain", "dq_app_status_domain", "dq_loan_status_domain",
        "dq_nonneg_money", "dq_bureau_range", "dq_dti_range", "dq_nonneg_age",
        "dq_tenure_domain", "dq_approval_cap", "dq_review_order", "dq_approval_order",
        "dq_disbursement_order", "dq_rejected_not_disbursed", "dq_pending_no_dates",
        "dq_rejected_no_default", "dq_nondisbursed_clean", "dq_default_not_disbursed",
        "dq_default_status", "dq_dpd_status", "dq_balance_status", "dq_closed",
        "dq_other_bounds"]
    return {
        **{name: rule(name) for name in rule_names},
        "dq_dti_range_strict": _on_portfolio(lambda p: DQ.run_rules(
            p.flat, {"dq_dti_range": DQ.portfolio_rules((0.03, 0.92))["dq_dti_range"]})),
        "dq_row_count": expected_rows,
        "dq_col_count": _on_portfolio(
            lambda p: DQ.column_count(p.flat, len(S.FLAT_COLUMNS))),
        "dq_empty_columns": _on_portfolio(lambda p: DQ.empty_columns(
            p.flat.withColumn("bureau_score", F.lit(None).cast("int")))),
        "dq_unique_key": _on_portfolio(
            lambda p: DQ.duplicate_rows(p.flat, ["application_id"], "dq_unique_key")),
        "dq_duplicate_keys": _on_portfolio(lambda p: DQ.duplicate_keys(damaged(p.flat))),
        "dq_full_duplicates": _on_portfolio(lambda p: DQ.full_duplicates(damaged(p.flat))),
        "dq_missing_only_in": _on_portfolio(
            lambda p: DQ.missing_only_in(p.flat, S.NULLABLE_COLUMNS)),
        "dq_suite": _on_portfolio(lambda p: DQ.validation_suite(p.flat, (0.03, 0.92))),
        "dq_suite_damaged": _on_portfolio(lambda p: DQ.validation_suite(damaged(p.flat))),
        "dq_gate": gated,
        "dq_orphans": _on_star(orphans),
        "rel_full_outer_join": _on_star(lambda p: outer_joined(
            without(p, applications=5, assessments=7, decisions=11, performance=13))),
        "dq_orphans_damaged": _on_star(lambda p: orphans(
            without(p, applications=5, assessments=7, decisions=11, performance=13))),
        "dq_foreign_key": _on_star(references),
        "dq_foreign_key_damaged": _on_star(
            lambda p: references(without(p, customers=3, applications=5))),
        "dq_null_counts": _on_star(lambda p: DQ.null_counts(
            p.joined("applications", "assessments", "decisions"), S.NULLABLE_COLUMNS)),
        "dq_missingness": _on_portfolio(lambda p: DQ.missingness(p.flat)),
        "dq_bands_valid": _on_portfolio(lambda p: DQ.unexpected_labels(X.bands(p.flat))),
        "dq_no_infinite": _on_clean(
            lambda table: DQ.infinite_values(table, list(X.RATIOS))),
        "dq_model_population": lambda spark, sf_dir: plain(DQ.model_population(
            load_portfolio(spark, sf_dir).flat, X.model_table(clean_table(spark, sf_dir)))),
        "prof_headline": _on_portfolio(lambda p: P.headline(p.flat)),
        "prof_frequency": _on_portfolio(lambda p: P.frequency(p.flat)),
        "prof_segment_rates": _on_portfolio(lambda p: P.segment_tables(p.flat)),
    }


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's report; every order must have become one application."""
    return DQ.gate(DQ.gate_suite(load_portfolio(spark, sf_dir).flat,
                                 order_count(spark, sf_dir)), DQ.GATE_CHECKS)


def order_count(spark: SparkSession, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def _feature_queries() -> dict[str, Query]:
    imputed = [f"{name}_imputed" for name in S.IMPUTED_COLUMNS]
    missing = [f"{name}_missing" for name in S.IMPUTED_COLUMNS]

    def part(columns: list[str]) -> Query:
        return _on_clean(lambda table: table.select("application_id", *columns))

    def imputed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
        flat = load_portfolio(spark, sf_dir).flat
        return X.impute(flat, medians(spark, sf_dir)).select("application_id", *imputed)

    return {
        "feat_missing_flags": _on_portfolio(
            lambda p: X.missing_flags(p.flat).select("application_id", *missing)),
        "feat_median_impute": imputed_columns,
        "feat_safe_ratio": _on_portfolio(lambda p: p.flat.select(
            "application_id", X.ratio("loan_to_annual_revenue_ratio"))),
        "feat_ratios": part(list(X.RATIOS)),
        "feat_flags": _on_portfolio(lambda p: X.flags(p.flat).select(
            "application_id", "has_previous_default", "has_existing_loan", "has_collateral")),
        "feat_bands": _on_portfolio(
            lambda p: X.bands(p.flat).select("application_id", *X.PORTFOLIO)),
        "feat_durations": _on_portfolio(
            lambda p: X.durations(p.flat).select("application_id", *X.DURATIONS)),
        "feat_clean_table": lambda spark, sf_dir: plain(X.clean_table(
            load_portfolio(spark, sf_dir).flat, medians(spark, sf_dir))),
        "feat_model_table": _on_model(lambda table: table),
        "feat_leakage_guard": _on_model(X.predictor_report),
    }


def rounded(df: DataFrame, **places: int) -> DataFrame:
    """Columns rounded for comparison with another engine's floating point."""
    return df.withColumns({
        name: F.round(F.col(name), digits) for name, digits in places.items()})


def medians(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """The medians of the imputed columns, fitted once and stored."""
    return _stored(spark, sf_dir, "medians", lambda: spark.createDataFrame(
        [X.fit_medians(load_portfolio(spark, sf_dir).flat)])).first().asDict()


def clean_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned record, written once; statistics, models and dashboard read it."""
    return _stored(spark, sf_dir, "clean", lambda: PIPE.cleaned(
        load_portfolio(spark, sf_dir).flat, order_count(spark, sf_dir),
        lambda: medians(spark, sf_dir)))


def _on_clean(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: plain(build(clean_table(spark, sf_dir)))


def _on_model(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: plain(build(X.model_table(clean_table(spark, sf_dir))))


def _statistics_queries() -> dict[str, Query]:
    return {
        "eda_numeric_summary": _on_model(lambda table: rounded(
            ST.numeric_summary(table), mean=4, median=9, sd=4, min=9, p25=9, p75=9,
            max=9)),
        "eda_default_rate_tables": _on_model(ST.default_rate_tables),
        "eda_correlation": _on_model(
            lambda table: rounded(ST.correlation(table), correlation=6)),
        "eda_monthly": _on_portfolio(lambda p: ST.monthly_rates(p.flat)),
        "eda_category_counts": _on_portfolio(lambda p: ST.category_counts(p.flat)),
        "eda_histogram": _on_portfolio(lambda p: ST.histogram(p.flat)),
        "eda_chi_square": _on_model(
            lambda table: rounded(ST.chi_square(table), statistic=6, p_value=6)),
        "eda_wilcoxon": _on_model(
            lambda table: rounded(ST.rank_sum(table), z=6, p_value=6)),
        "eda_statistical_tests": _on_model(
            lambda table: rounded(ST.statistical_tests(table), statistic=6, p_value=6)),
        "eda_findings": _on_model(ST.findings),
    }


def fixed_predictions(p: Portfolio) -> DataFrame:
    """Two deterministic PDs per disbursed loan, with ties, standing in for two models."""
    key = F.col("application_id")
    models = {"Model A": (7919, 997), "Model B": (104729, 991)}
    pds = F.array(*[
        F.struct(F.lit(name).alias("model"),
                 (((key * factor) % modulus + 1) / F.lit(1000.0)).alias("predicted_pd"))
        for name, (factor, modulus) in models.items()])
    return p.flat.where(V.disbursed()).select(
        "application_id", "customer_id", "default_flag", F.explode(pds).alias("p")).select(
        "p.model", "application_id", "customer_id", "default_flag", "p.predicted_pd")


def _counts(p: Portfolio) -> DataFrame:
    return EV.score_counts(fixed_predictions(p))


def _unranked(p: Portfolio) -> DataFrame:
    return EV.pd_counts(fixed_predictions(p))


def _scored(p: Portfolio) -> DataFrame:
    return SC.with_score(fixed_predictions(p).where("model = 'Model A'").drop("model"))


def _evaluation_queries() -> dict[str, Query]:
    def metric(*names: str) -> Query:
        return _on_portfolio(lambda p: rounded(
            EV.evaluate(_counts(p)).select("model", *names), **{n: 10 for n in names}))

    def unranked(*names: str) -> Query:
        return _on_portfolio(lambda p: rounded(
            EV.at_threshold(_unranked(p)).select("model", *names), **{n: 10 for n in names}))

    return {
        "ev_predict": _on_portfolio(lambda p: EV.with_class(fixed_predictions(p))),
        "ev_confusion": _on_portfolio(lambda p: EV.confusion(_unranked(p))),
        "ev_threshold_metrics": unranked("accuracy", "precision", "recall", "specificity", "f1"),
        "ev_roc_auc": metric("roc_auc"),
        "ev_gini": metric("gini"),
        "ev_pr_auc": metric("pr_auc"),
        "ev_ks": metric("ks"),
        "ev_brier": unranked("brier_score"),
        "ev_compare": metric(*EV.METRICS, "threshold"),
        "ev_roc_curve": _on_portfolio(lambda p: EV.roc_curve(_counts(p))),
        "ev_pr_curve": _on_portfolio(lambda p: EV.pr_curve(_counts(p))),
        "ev_calibration": _on_portfolio(lambda p: rounded(
            EV.calibration(fixed_predictions(p)), mean_predicted_probability=9)),
        "sc_score": _on_portfolio(lambda p: _scored(p).select(
            "application_id", "predicted_pd", "credit_score")),
        "sc_band": _on_portfolio(lambda p: _scored(p).select(
            "application_id", "credit_score", "risk_band")),
        "sc_monitoring": _on_portfolio(lambda p: _scored(p).select(
            "application_id", "risk_band", "risk_monitoring_flag")),
        "sc_apply": _on_portfolio(_scored),
        "sc_math_checks": _on_portfolio(lambda p: PS.math_checks(fixed_predictions(p))),
        "sc_output_checks": _on_portfolio(lambda p: PS.output_checks(_scored(p))),
        "sc_summary": _on_portfolio(
            lambda p: rounded(PS.score_summary(_scored(p)), value=9)),
        "sc_band_summary": _on_portfolio(lambda p: rounded(
            PS.band_summary(_scored(p)), mean_predicted_pd=9, mean_credit_score=9)),
        "sc_band_monotone": _on_portfolio(lambda p: PS.band_monotone(_scored(p))),
        "sc_histogram": _on_portfolio(lambda p: PS.score_histogram(_scored(p))),
    }


def _dashboard_queries() -> dict[str, Query]:
    return {
        "db_kpis": _on_portfolio(lambda p: DB.kpis(p.flat)),
        "db_status_counts": _on_portfolio(
            lambda p: DB.counts_by(p.flat, "application_status")),
        "db_daily_counts": _on_portfolio(lambda p: DB.counts_by(p.flat, "application_date")),
        "db_type_counts": _on_portfolio(
            lambda p: DB.counts_by(p.flat, "business_type", by_frequency=True)),
        "db_purpose_counts": _on_portfolio(
            lambda p: DB.counts_by(p.flat, "loan_purpose", by_frequency=True)),
        "db_rate_bureau": _on_clean(lambda table: DB.rate_by_band(table, "bureau_band")),
        "db_rate_dti": _on_clean(lambda table: DB.rate_by_band(table, "dti_band")),
        "db_rate_age": _on_clean(lambda table: DB.rate_by_band(table, "age_band")),
        "db_rate_history": _on_portfolio(lambda p: DB.rate_by_history(p.flat)),
        "db_rate_purpose": _on_portfolio(lambda p: DB.rate_by_purpose(p.flat)),
        "db_metric_table": _on_portfolio(
            lambda p: DB.metric_table(EV.evaluate(_counts(p)))),
        "db_choices": _on_model(DB.choices),
    }


def split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modelling set with its side and fold, written once per session and read back.

    Training, tuning and evaluation all start from this table, so they see the same split.
    """
    return _stored(spark, sf_dir, "split", lambda: PIPE.divided(
        clean_table(spark, sf_dir), SP.arithmetic_key("customer_id")))


_STORED: set[str] = set()


def _stored(spark: SparkSession, sf_dir: str, name: str,
            build: Callable[[], DataFrame]) -> DataFrame:
    path = _place(spark, sf_dir, name)
    if path not in _STORED:
        build().write.mode("overwrite").parquet(path)
        _STORED.add(path)
    return spark.read.parquet(path)


def cleanup(spark: SparkSession) -> None:
    """Remove what the queries of this application have stored; the next ones start anew."""
    own = work_folder(spark)
    _STORED.difference_update([path for path in _STORED if path.startswith(own)])
    star.cleanup(spark)


def _place(spark: SparkSession, sf_dir: str, name: str) -> str:
    scale = hashlib.sha256(sf_dir.encode()).hexdigest()[:12]
    return f"{work_folder(spark)}/{scale}/{name}"


def _side(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    return split_table(spark, sf_dir).where(F.col("side") == side)


def fitted(spark: SparkSession, sf_dir: str, kind: str) -> PipelineModel:
    """The logistic regression or the forest, fitted on the training side, saved, and loaded."""
    path = _place(spark, sf_dir, f"model_{kind}")
    if path not in _STORED:
        PIPE.assert_divided(split_table(spark, sf_dir))
        train = _side(spark, sf_dir, "train")
        M.save(M.fit_logistic(train) if kind == "logistic" else M.fit_forest(train), path)
        _STORED.add(path)
    return M.load(path)


def artifact(spark: SparkSession, sf_dir: str) -> ART.Artifact:
    """The regression with the medians, split and folds it was fitted with, as one artefact."""
    place = _place(spark, sf_dir, "artifact")
    if place not in _STORED:
        ART.save(place, fitted(spark, sf_dir, "logistic"), medians(spark, sf_dir),
                 split_table(spark, sf_dir))
        _STORED.add(place)
    return ART.load(spark, place)


def holdout_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models' PDs on the held-out side, each computed once."""
    def both() -> DataFrame:
        test = _side(spark, sf_dir, "test")
        return reduce(DataFrame.unionByName, [
            M.predict(fitted(spark, sf_dir, kind), test).withColumn("model", F.lit(name))
            for kind, name in (("logistic", "Logistic Regression"), ("forest", "Random Forest"))])

    return _stored(spark, sf_dir, "holdout", both)


def feature_moments(recipe: PipelineModel, rows: DataFrame, column: str) -> DataFrame:
    """(feature, low, high, mean, deviation) of a fitted recipe's vector."""
    names = F.array(*[F.lit(name) for name in M.feature_names(recipe)])
    values = recipe.transform(rows).select(
        F.posexplode(vector_to_array(F.col(column))).alias("position", "value"))
    return values.groupBy("position").agg(
        F.min("value").alias("low"), F.max("value").alias("high"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation")).select(
        F.get(names, F.col("position")).alias("feature"), "low", "high", "mean", "deviation")


def _membership(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    """Modelling rows whose customer is, or is not, among the training customers."""
    table = X.model_table(clean_table(spark, sf_dir))
    # Distinct, so that a customer with very many loans is one row on the side that is built.
    trained = _side(spark, sf_dir, "train").select("customer_id").distinct()
    return table.join(trained, "customer_id", how).select("application_id", "customer_id")


def both_outcomes(p: Portfolio) -> DataFrame:
    """Customers with a rejected and a disbursed application."""
    rows = p.joined("applications", "decisions")
    return rows.where(V.rejected()).select("customer_id").intersect(
        rows.where(V.disbursed()).select("customer_id"))


def never_lent(p: Portfolio) -> DataFrame:
    """Customers without a disbursed application."""
    rows = p.joined("applications", "decisions")
    return rows.select("customer_id").subtract(
        rows.where(V.disbursed()).select("customer_id"))


def cv_predictions(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Out-of-fold predictions of the regression or the forest, computed once."""
    fit = M.fit_logistic if kind == "logistic" else M.fit_forest
    return _stored(spark, sf_dir, f"cv_{kind}", lambda: M.cross_predict(
        _side(spark, sf_dir, "train"), fit))


def tuning_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions of every grid point, fitted on all rows outside each fold: one table,
    which all queries of the grid read.

    A query that was ended leaves the scores it has finished, and the next goes on there.
    """
    place = _place(spark, sf_dir, "tuning")
    if place not in _STORED:
        G.tune_predictions(_side(spark, sf_dir, "train"), place)
        _STORED.add(place)
    return spark.read.parquet(f"{place}/scores")


def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.summarise_folds(tuning_predictions(spark, sf_dir), by=["mtry", "min_n"])


def scored_once(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Rows and applications scored per group, and whether every PD is a probability."""
    return predictions.groupBy(*by).agg(
        F.count("*").alias("rows"), F.countDistinct("application_id").alias("applications"),
        F.min(F.coalesce(F.col("predicted_pd").between(0, 1), F.lit(False)).cast("int"))
        .alias("within"))


def balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean PD of the regression on its training rows, overall and per level of the nominal
    predictors. An unpenalised fit makes each equal to the observed default rate."""
    scored = M.predict(fitted(spark, sf_dir, "logistic"), _side(spark, sf_dir, "train"),
                       keep=S.NOMINAL_PREDICTORS)
    groups = F.array(F.struct(F.lit("all").alias("variable"), F.lit("all").alias("level")), *[
        F.struct(F.lit(name).alias("variable"), F.col(name).alias("level"))
        for name in S.NOMINAL_PREDICTORS])
    return scored.select("predicted_pd", F.explode(groups).alias("g")).groupBy(
        "g.variable", "g.level").agg(F.round(F.avg("predicted_pd"), 3).alias("default_rate"))


def reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that change when a model is saved once more and read back."""
    model, path = fitted(spark, sf_dir, "logistic"), _place(spark, sf_dir, "model_copy")
    M.save(model, path)
    rows = split_table(spark, sf_dir)
    again = M.predict(M.load(path), rows).withColumnRenamed("predicted_pd", "again")
    return M.predict(model, rows).join(again.select("application_id", "again"),
                                       "application_id").agg(
        F.count("*").alias("rows"),
        F.count_if(~F.col("predicted_pd").eqNullSafe(F.col("again"))).alias("differing"))


def recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdout applications and whether their score follows from the stored PD."""
    scored = SC.with_score(M.predict(fitted(spark, sf_dir, "logistic"),
                                     _side(spark, sf_dir, "test")))
    low, high = F.lit(1e-6), F.lit(1 - 1e-6)
    pd = F.greatest(low, F.least(high, F.col("predicted_pd")))
    factor = 50 / F.log(F.lit(2.0))
    score = 600 - factor * F.log(F.lit(20.0)) + factor * F.log((1 - pd) / pd)
    limited = F.greatest(F.lit(300.0), F.least(F.lit(850.0), score))
    return scored.select("application_id", (F.abs(F.col("credit_score") - limited) <= 0.51).cast(
        "int").alias("follows"))


def importance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest's variables and whether all importances are shares of one."""
    shares = M.importance(fitted(spark, sf_dir, "forest"))
    total = shares.agg((F.round(F.sum("importance"), 6) == 1).cast("int").alias("whole"))
    return shares.select("variable", F.col("importance").between(0, 1).cast("int").alias(
        "within")).crossJoin(F.broadcast(total))       # one row


def _model_queries() -> dict[str, Query]:
    def recipe_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
        model = fitted(spark, sf_dir, "logistic")
        moments = feature_moments(PipelineModel(model.stages[:-1]),
                                  _side(spark, sf_dir, "train"), "features")
        return rounded(moments.select("feature", "low", "high"), low=6, high=6)

    def recipe_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
        train = _side(spark, sf_dir, "train")
        moments = feature_moments(M.prepare(train, normalise=False)[0], train, "varying")
        return rounded(moments, low=6, high=6, mean=4, deviation=4)

    def scored_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
        test = _side(spark, sf_dir, "test")
        return PIPE.scored(M.predict(fitted(spark, sf_dir, "logistic"), test))

    return {
        "rel_semi_join": lambda s, d: _membership(s, d, "left_semi"),
        "rel_anti_join": lambda s, d: _membership(s, d, "left_anti"),
        "rel_intersect": _on_portfolio(both_outcomes),
        "rel_except": _on_portfolio(never_lent),
        "ml_group_split": lambda s, d: split_table(s, d).select(
            "application_id", "customer_id", "side"),
        "ml_split_check": lambda s, d: SP.split_check(split_table(s, d)),
        "ml_partition_report": lambda s, d: SP.partition_report(split_table(s, d)),
        "ml_group_folds": lambda s, d: _side(s, d, "train").select(
            "application_id", "customer_id", "fold"),
        "ml_fold_report": lambda s, d: SP.fold_report(_side(s, d, "train")),
        "ml_fold_check": lambda s, d: SP.fold_check(_side(s, d, "train")),
        "ml_recipe_lr": recipe_lr,
        "ml_recipe_rf": recipe_rf,
        "ml_logistic": lambda s, d: M.predict(
            fitted(s, d, "logistic"), _side(s, d, "test")),
        "ml_logistic_balance": balance,
        "ml_lr_coefficients": lambda s, d: M.coefficients(
            fitted(s, d, "logistic"), _side(s, d, "train")),
        "ml_lr_terms": lambda s, d: M.coefficients(fitted(s, d, "logistic")).select("term"),
        "ml_cv_metrics": lambda s, d: M.summarise_folds(cv_predictions(s, d, "logistic")),
        "ml_cv_check": lambda s, d: scored_once(cv_predictions(s, d, "logistic"), ["fold"]),
        "ml_random_forest": lambda s, d: M.predict(
            fitted(s, d, "forest"), _side(s, d, "test")),
        "ml_rf_importance": lambda s, d: M.importance(fitted(s, d, "forest")),
        "ml_random_forest_check": lambda s, d: scored_once(
            M.predict(fitted(s, d, "forest"), _side(s, d, "test"), keep=["side"]), ["side"]),
        "ml_rf_importance_check": importance_check,
        "ml_rf_cv": lambda s, d: M.summarise_folds(
            cv_predictions(s, d, "forest"), metrics=["roc_auc", "pr_auc"]),
        "ml_rf_cv_check": lambda s, d: scored_once(cv_predictions(s, d, "forest"), ["fold"]),
        "ml_rf_tuning": tuned,
        "ml_rf_tuning_grid": lambda s, d: tuned(s, d).select(
            "mtry", "min_n", "metric", "n", F.col("mean").between(0, 1).cast("int").alias("within")),
        "ml_rf_tuning_check": lambda s, d: scored_once(
            tuning_predictions(s, d), ["mtry", "min_n"]),
        "ml_rf_best": lambda s, d: M.best_parameters(tuned(s, d)),
        "ml_holdout_metrics": lambda s, d: EV.evaluate(
            EV.score_counts(holdout_predictions(s, d))),
        "ml_holdout_check": lambda s, d: holdout_predictions(s, d).groupBy("model").agg(
            F.count("*").alias("rows"), F.sum("default_flag").alias("defaults"),
            F.count_if(F.col("predicted_pd").isNull()).alias("left_out")),
        "ml_holdout_bins": lambda s, d: EV.calibration(holdout_predictions(s, d)).select(
            "model", "bin", "observations"),
        "ml_holdout_calibration": lambda s, d: EV.calibration(holdout_predictions(s, d)),
        "sc_apply_model": scored_holdout,
        "sc_apply_model_check": recomputed,
        "sc_output_checks_model": lambda s, d: PS.output_checks(scored_holdout(s, d)),
        "sc_summary_model": lambda s, d: PS.score_summary(scored_holdout(s, d)),
        "sc_band_summary_model": lambda s, d: PS.band_summary(scored_holdout(s, d)),
        "sink_model": lambda s, d: M.predict(  # saved and loaded by fitted()
            fitted(s, d, "logistic"), split_table(s, d), keep=["side"]),
        "sink_model_check": reloaded,
        "sink_model_manifest": lambda s, d: artifact(s, d).manifest.select("part", "rows"),
    }


def _source_queries() -> dict[str, Query]:
    def through_csv(name: str, build: Callable[[Portfolio], DataFrame]) -> Query:
        """Write to CSV and read back with the declared schema."""
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df, path = build(load_portfolio(spark, sf_dir)), _place(spark, sf_dir, name)
            files.write_csv(df, path)
            return plain(files.read_csv(spark, path, df.schema))
        return run

    def clean_through_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = X.clean_table(load_portfolio(spark, sf_dir).flat, medians(spark, sf_dir))
        return through_csv("csv_clean", lambda _: table)(spark, sf_dir)

    def text_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _place(spark, sf_dir, "csv_text")
        files.write_csv(damaged_text(load_portfolio(spark, sf_dir).flat), path)
        return files.read_csv_text(spark, path)

    def quarantined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
        path = _place(spark, sf_dir, "csv_damaged")
        files.write_csv(damaged_text(load_portfolio(spark, sf_dir).flat), path)
        return files.read_csv_quarantined(spark, path, S.FLAT_LONG_KEYS, f"{path}_read")

    def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = ["customer", "lineitem", "orders", "part"]
        files.require_artifacts(spark, [f"{sf_dir}/{name}.parquet" for name in names])
        counts = [spark.read.parquet(f"{sf_dir}/{name}.parquet").agg(
            F.count("*").alias("rows")).select(F.lit(name).alias("artifact"), "rows")
            for name in names]
        return reduce(DataFrame.unionAll, counts)

    def written_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _place(spark, sf_dir, "findings")
        files.write_lines(ST.findings(X.model_table(clean_table(spark, sf_dir))), path)
        return spark.read.text(path).withColumnRenamed("value", "line")

    return {
        "src_csv": through_csv("csv_flat", lambda p: p.flat),
        "src_csv_inferred": clean_through_csv,
        "src_csv_quarantine": lambda s, d: plain(quarantined(s, d)[0]),
        "src_csv_rejects": lambda s, d: quarantined(s, d)[1].select(
            F.get_json_object("record", "$.application_id").cast("long").alias(
                "application_id"), "reasons"),
        "sink_csv": through_csv("csv_exposure", V.customer_exposure),
        "src_require_columns": _on_portfolio(lambda p: files.column_report(
            files.require_columns(p.flat, S.FLAT_COLUMNS), S.FLAT_COLUMNS)),
        "src_cast": lambda s, d: plain(
            files.cast_columns(text_copy(s, d), S.FLAT_LONG_KEYS)),
        "src_cast_report": lambda s, d: files.cast_report(
            text_copy(s, d), S.FLAT_LONG_KEYS),
        "src_require_artifacts": artifacts,
        "sink_findings": written_findings,
    }


def damaged_text(flat: DataFrame) -> DataFrame:
    """The record as text with some values that do not parse."""
    key = F.col("application_id")
    text = flat.select(*[F.col(name).cast("string").alias(name) for name in flat.columns])
    return text.withColumns({
        "bureau_score": F.when(key % 17 == 0, "n/a").otherwise(F.col("bureau_score")),
        "approved_amount": F.when(key % 19 == 0, "12,5x").otherwise(F.col("approved_amount")),
        "application_date":
            F.when(key % 23 == 0, "31.31.2020").otherwise(F.col("application_date")),
    })


def _stream_queries() -> dict[str, Query]:
    def run(spark: SparkSession, sf_dir: str, name: str,
            predict: Callable[[DataFrame], DataFrame]) -> str:
        """Stream every application's input columns through scoring; returns the output."""
        schema = STREAM.applicant_schema()
        arrivals = _stored(spark, sf_dir, "applicants", lambda: load_portfolio(
            spark, sf_dir).flat.select(*STREAM.INPUT_COLUMNS))
        source = _place(spark, sf_dir, "applicants")
        output = _place(spark, sf_dir, f"{name}_{uuid.uuid4().hex}")
        if set(arrivals.columns) != set(schema.names):
            raise ValueError("applicant files do not have the expected columns")
        STREAM.score_stream(STREAM.read_applicants(spark, source, schema), predict, output,
                            f"{output}/checkpoint", medians(spark, sf_dir)).awaitTermination()
        return output

    def fixed_pd(features: DataFrame) -> DataFrame:
        return features.withColumn(
            "predicted_pd", ((F.col("application_id") * 7919) % 997 + 1) / F.lit(1000.0))

    def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
        output = run(spark, sf_dir, "stream_fixed", fixed_pd)
        return STREAM.read_scored(spark, output).drop("batch")

    def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
        output = run(spark, sf_dir, "stream_rejects", fixed_pd)
        return STREAM.read_rejected(spark, output).drop("batch")

    def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
        output = run(spark, sf_dir, "stream_commits", fixed_pd)
        return STREAM.read_commits(spark, output).agg(*[
            F.sum(name).alias(name) for name in ("arrived", "scored", "rejected")])

    def with_model(spark: SparkSession, sf_dir: str) -> DataFrame:
        model = fitted(spark, sf_dir, "logistic")
        output = run(spark, sf_dir, "stream_model", lambda rows: M.predict(model, rows))
        return STREAM.read_scored(spark, output).drop("batch")

    return {
        "sc_apply_stream": scored,
        "sc_apply_stream_rejects": rejected,
        "sc_apply_stream_commits": commits,
        "sc_apply_stream_model": with_model,
        "sc_apply_stream_model_check": lambda s, d: with_model(s, d).select(
            "application_id", (F.col("predicted_pd").between(0, 1) & F.col(
                "credit_score").isNotNull() & F.col("risk_band").isNotNull()).cast("int")
            .alias("scored")),
    }


def all_queries() -> dict[str, Query]:
    return {
        **_portfolio_queries(), **_quality_queries(), **_feature_queries(),
        **_statistics_queries(), **_evaluation_queries(), **_dashboard_queries(),
        **_source_queries(), **_stream_queries(), **_model_queries(),
    }
