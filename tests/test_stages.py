import shutil
import time
import warnings
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendbook import schemas as S
from lendbook.catalog import damaged
from lendbook.operators import artifacts as ART
from lendbook.operators import evaluate as E
from lendbook.operators import features as X
from lendbook.operators import forest_grid as G
from lendbook.operators import model as M
from lendbook.operators import quality as Q
from lendbook.operators import split as SP
from lendbook.plans import pipeline, questions, views
from lendbook.sources import files
from lendbook.sources.driver_tables import credit_applications, order_lines, workflow_days
from lendbook.sources.star import Portfolio, plain, publish
from lendbook.streaming import scoring


@pytest.fixture(scope="module")
def table(small):
    return X.model_table(X.clean_table(small.flat)).persist()


def test_star_and_flat_answers_agree(small):
    for question in (questions.portfolio_overview, questions.status_mix,
                     views.monthly_credit_kpis, views.customer_exposure):
        flat, star = question(small), question(small.as_star())
        assert flat.exceptAll(star).count() == 0 and star.exceptAll(flat).count() == 0


def test_star_join_needs_no_shuffle(spark, small):
    plan = small.as_star().joined("applications", "assessments")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "Exchange" not in text


def test_views_answer_sql(spark, small):
    views.register_views(small)
    by_sql = spark.sql("""
        SELECT business_type, COUNT(*) AS disbursed_loans,
               COUNT(*) FILTER (WHERE default_flag = 1) AS defaults
        FROM vw_default_analysis WHERE application_status = 'Disbursed'
        GROUP BY business_type""")
    by_call = questions.default_rate_by(small, "business_type").select(by_sql.columns)
    assert by_sql.exceptAll(by_call).count() == 0
    joined = spark.sql("""
        SELECT COUNT(*) AS n FROM loan_applications a JOIN loan_decisions d USING (application_id)
        JOIN loan_performance p USING (application_id) JOIN credit_assessments
        USING (application_id) JOIN customers USING (customer_id)""")
    assert joined.first()["n"] == 1500


def test_gate_stops_on_damage(small):
    Q.gate(Q.validation_suite(small.flat), Q.GATE_CHECKS)
    with pytest.raises(Q.QualityError, match="dq_bureau_range"):
        Q.gate(Q.validation_suite(damaged(small.flat)), Q.GATE_CHECKS)


def test_approval_without_review_is_a_violation(small):
    broken = small.flat.withColumn("credit_review_date", F.lit(None).cast("date"))
    row = Q.run_rules(broken, {"order": Q.portfolio_rules()["dq_approval_order"]}).first()
    assert row["violations"] == small.flat.where("approval_date IS NOT NULL").count()


def test_leakage_guard(table):
    assert len(X.leakage_guard(table.columns)) == 27
    with pytest.raises(X.LeakageError, match="days_past_due"):
        X.leakage_guard([*table.columns, "days_past_due"])


def test_reconciliation_fails_on_a_wrong_value(small):
    questions.assert_reconciled(small, {"applications": 1500, "defaults": 124})
    with pytest.raises(ValueError, match="rejected"):
        questions.assert_reconciled(small, {"rejected": 1})


def test_csv_round_trip_and_column_checks(spark, small, tmp_path):
    files.write_csv(small.flat, str(tmp_path / "flat"))
    back = files.read_csv(spark, str(tmp_path / "flat"), S.FLAT_LONG_KEYS)
    assert back.exceptAll(small.flat).count() == 0 and back.count() == 1500
    with pytest.raises(files.MissingColumnsError, match="loan_status"):
        files.require_columns(back.drop("loan_status"), S.FLAT_COLUMNS)
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        files.require_columns(back.withColumn("extra", F.lit(1)), S.FLAT_COLUMNS)
    assert any("extra" in str(w.message) for w in seen)


def test_missing_artifacts_are_all_named(spark, tmp_path):
    with pytest.raises(files.MissingArtifactsError, match="(?s)one.*two"):
        files.require_artifacts(spark, [str(tmp_path / "one"), str(tmp_path / "two")])


def test_one_order_with_most_lines(spark):
    """A hot order: sums, distinct suppliers and first days come out whole."""
    lines = spark.range(9000).select(
        F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") + 10).alias("l_orderkey"),
        (F.col("id") % 7).alias("l_partkey"), (F.col("id") % 1000).alias("l_suppkey"),
        F.lit(2.0).alias("l_quantity"), F.lit(1.25).alias("l_extendedprice"),
        F.lit(0.05).alias("l_discount"), F.lit(0.01).alias("l_tax"),
        F.lit("R").alias("l_returnflag"), F.lit("O").alias("l_linestatus"),
        F.date_add(F.lit("2020-01-01"), (F.col("id") % 900).cast("int"))
        .cast("timestamp").alias("l_shipdate"))
    parts = spark.range(7).select(F.col("id").alias("p_partkey"),
                                  (F.col("id") + 3).cast("int").alias("p_size"),
                                  F.lit(10.5).alias("p_retailprice"))
    hot = order_lines(lines, parts).where("l_orderkey = 1").first()
    assert (hot["n"], hot["price_cents"], hot["suppliers"]) == (6000, 750000, 1000)
    assert (hot["smallest_part"], hot["retail_cents"]) == (3, 6000 * 1050)
    orders = spark.createDataFrame([(1, "2020-02-01")], "o_orderkey long, day string").select(
        "o_orderkey", F.to_date("day").alias("order_day"))
    days = workflow_days(lines, orders).first()
    # id % 900 = 31 gives 2020-02-01, and 32, 33 follow unless divisible by three
    expected = sorted({r[0] for r in lines.where("l_orderkey = 1").select(
        F.to_date("l_shipdate")).distinct().collect() if str(r[0]) >= "2020-02-01"})[:3]
    assert [days["first_day"], days["second_day"], days["third_day"]] == expected


def test_lines_are_not_grouped_before_they_are_dealt(spark, tmp_path):
    """No task groups rows that hardly repeat a key, and the record is dealt once, for its buckets."""
    asked = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "7"}
    for name, value in asked.items():
        spark.conf.set(name, value)
    try:
        record = credit_applications(spark, "/root/testdata/sf0.001", 3)
        plan = record._jdf.queryExecution().executedPlan().toString()
        publish(record, "lendbook_dealt", str(tmp_path / "t"), 3, dealt=True)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    steps = [line.strip(" :+-") for line in plan.split("\n")]
    exchanges = [step for step in steps if step.startswith("Exchange")]
    by_hash = [step for step in exchanges if "partkey" in step or "custkey" in step]
    assert len(by_hash) == 4 and all(", 7)" in step for step in by_hash)
    assert all(", 3)" in step for step in exchanges if step not in by_hash)
    below = [steps[i + 1] for i, step in enumerate(steps) if step in exchanges]
    assert not any("partial" in step for step in below)
    assert len(list((tmp_path / "t").glob("*.parquet"))) == 3
    assert spark.table("lendbook_dealt").count() == record.count()
    spark.sql("DROP TABLE lendbook_dealt")


def test_logistic_beats_chance_on_held_out_customers(table):
    split = SP.group_split(table).persist()
    model = M.fit_logistic(split.where("side = 'train'"))
    scored = M.predict(model, split.where("side = 'test'")).withColumn("model", F.lit("lr"))
    assert E.evaluate(E.score_counts(scored)).first()["roc_auc"] > 0.6
    terms = M.coefficients(model)
    assert terms.where("abs(coefficient + non_default_coefficient) > 1e-12").count() == 0


def test_logistic_agrees_with_glm(table):
    """On independent predictors; on all of them the GLM solver fails, because some repeat
    each other."""
    names = ["previous_defaults", "collateral_value_imputed", "bureau_score_imputed",
             "credit_history_years"]
    raw = VectorAssembler(inputCols=names, outputCol="raw").transform(table)
    rows = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(
        raw).transform(raw)
    glm = GeneralizedLinearRegression(
        family="binomial", labelCol=S.LABEL, featuresCol="features", tol=1e-12).fit(rows)
    fit = M.logistic().fit(rows)
    both = glm.transform(fit.transform(rows).drop("prediction"))
    gap = F.abs(F.col("prediction") - vector_to_array("probability")[1])
    assert both.select(F.max(gap)).first()[0] < 1e-5


def test_unseen_level_and_missing_value(table):
    model = M.fit_logistic(table)
    row = table.limit(1)
    unseen = M.predict(model, row.withColumn("business_type", F.lit("NEW ONE")))
    assert 0 < unseen.first()["predicted_pd"] < 1
    empty = M.predict(model, row.withColumn("annual_revenue", F.lit(None).cast("double")))
    assert empty.first()["predicted_pd"] is None


def test_forest_and_tuning_on_a_small_grid(table, tmp_path):
    folded = SP.with_folds(table, folds=2)
    tuned = M.summarise_folds(G.tune_predictions(
        folded, str(tmp_path / "grid"), {"mtry": [3, 6], "min_n": [15]}, trees=30),
        by=["mtry", "min_n"]).persist()
    assert tuned.where("metric = 'roc_auc'").count() == 2
    assert M.best_parameters(tuned).first()["mtry"] in (3, 6)
    forest = M.fit_forest(table, trees=5, max_depth=4)
    shares = M.importance(forest).select(F.sum("importance")).first()[0]
    assert shares == pytest.approx(1.0)


def test_stream_scores_valid_and_rejects_invalid(spark, small, tmp_path):
    source = str(tmp_path / "in")
    applicants = small.flat.select(*scoring.INPUT_COLUMNS)
    applicants.repartition(3).write.parquet(source)
    stream = scoring.read_applicants(spark, source, files_per_batch=1)
    query = scoring.score_stream(
        stream, lambda rows: rows.withColumn("predicted_pd", F.lit(0.05)),
        str(tmp_path / "out"), str(tmp_path / "checkpoint"), X.fit_medians(small.flat))
    query.awaitTermination()
    scored = spark.read.parquet(str(tmp_path / "out/scored"))
    rejected = spark.read.parquet(str(tmp_path / "out/rejected"))
    assert scored.count() + rejected.count() == 1500
    assert rejected.where("problems LIKE '%bureau_score%'").count() == small.flat.where(
        "bureau_score IS NULL").count()
    assert scored.select("batch").distinct().count() == 3


def test_features_are_the_same_for_training_and_serving(small, table):
    served = scoring.applicant_features(
        small.flat.where("application_status = 'Disbursed'"), X.fit_medians(small.flat))
    trained = table.join(served.select("application_id"), "application_id").select(
        *served.columns)
    assert served.exceptAll(trained).count() == 0


@pytest.mark.parametrize("name", S.IMPUTED_COLUMNS)
def test_applicant_without_an_optional_input_is_scored(small, table, name):
    model = M.fit_logistic(table)
    row = small.flat.where("annual_revenue > 0 AND bureau_score IS NOT NULL AND "
                           "debt_to_income_ratio BETWEEN 0 AND 1").limit(5)
    emptied = scoring.checked(row.withColumn(name, F.lit(None).cast(row.schema[name].dataType)))
    accepted = emptied.where("problems = ''")
    if name == "bureau_score":
        assert accepted.count() == 0
        return
    scored = M.predict(model, scoring.applicant_features(accepted, X.fit_medians(small.flat)))
    assert scored.where("predicted_pd BETWEEN 0 AND 1").count() == row.count()


def test_applicant_without_a_needed_input_is_rejected(small):
    row = small.flat.limit(1).withColumn("credit_history_years", F.lit(None).cast("decimal(6,1)"))
    assert "credit_history_years must be given" in scoring.checked(row).first()["problems"]


def test_aliased_terms_are_told(table):
    doubled = table.withColumn("annual_revenue", F.col("monthly_revenue") * 12)
    terms = M.aliased_terms(M.fit_logistic(doubled), doubled)
    assert "annual_revenue" in terms and "business_age_years" not in terms


def test_fit_without_convergence_is_an_error(table, monkeypatch):
    regression = M.logistic
    monkeypatch.setattr(M, "logistic", lambda: regression().setMaxIter(1))
    with pytest.raises(M.ConvergenceError):
        M.fit_logistic(table)


def test_tuning_sample_takes_whole_customers(table):
    part = M.labelled_sample(table, 60)
    kept = {row["customer_id"] for row in part.select("customer_id").collect()}
    assert 0 < part.count() < table.count()
    assert table.where(F.col("customer_id").isin(list(kept))).count() == part.count()


def test_tuning_sample_is_exact_and_bounds_only_the_fit(table, tmp_path):
    folded = SP.with_folds(table, folds=2)
    counts = [r["n"] for r in folded.groupBy("customer_id").agg(F.count("*").alias("n")).collect()]
    assert 60 <= M.labelled_sample(folded, 60).count() < 60 + max(counts)
    assert M.labelled_sample(folded, 10 ** 9).count() == folded.count()
    scored = G.tune_predictions(folded, str(tmp_path / "grid"), {"mtry": [3, 6], "min_n": [15]},
                                trees=3, labelled_rows=60)
    rows = {r["mtry"]: r["count"] for r in scored.groupBy("mtry").count().collect()}
    assert rows == {3: folded.count(), 6: folded.count()}


def test_folds_of_many_rows_are_fitted_one_by_one(spark, monkeypatch):
    """Before, five fits kept their rows at a time, beside the rows of all folds in memory."""
    held, rows = [], spark.range(100).select(
        "id", (F.col("id") % 5).alias("fold"), F.rand(1).alias("predicted_pd"))

    def one(train, part):
        running.append(1)
        most.append(len(running))
        time.sleep(0.5)
        running.pop()
        return part

    running, most = [], []
    persist = type(rows).persist
    monkeypatch.setattr(type(rows), "persist", lambda self, *a: held.append(a) or persist(self, *a))
    for kept, expected in ((150, 1), (2_000_000, 2)):
        monkeypatch.setattr(M, "ROWS_KEPT", kept)
        most.clear()
        scored = M._over_folds(rows, one, 5)
        assert scored.count() == 100 and scored.select("fold").distinct().count() == 5
        assert max(most) == 1 if expected == 1 else max(most) > 1
    assert all(level and not level[0].useMemory for level in held)


def test_the_regression_keeps_its_rows_once(table, monkeypatch):
    kept, persist = [], type(table).persist
    monkeypatch.setattr(type(table), "persist",
                        lambda self, *a: kept.append(self) or persist(self, *a))
    M.fit_logistic(table)
    assert kept == []


def test_tuning_fits_all_rows_unless_asked_for_fewer(table, tmp_path):
    """Before, 2000 rows of whole customers were fitted."""
    many = table.crossJoin(table.sparkSession.range(7)).withColumns({
        "customer_id": F.col("customer_id") * 7 + F.col("id"),
        "application_id": F.col("application_id") * 7 + F.col("id")}).drop("id")
    folded, order = SP.with_folds(many, folds=2), ["application_id"]
    assert folded.count() > 2500
    told = [G.tune_predictions(folded, str(tmp_path / name), {"mtry": [3], "min_n": [15]}, trees=2,
                               **asked).orderBy(*order).collect()
            for name, asked in (("plain", {}), ("all", {"labelled_rows": 10 ** 9}),
                                ("some", {"labelled_rows": 2000}))]
    assert told[0] == told[1] != told[2]


def test_rows_beyond_a_task_are_tuned_whole(table, tmp_path, monkeypatch):
    """Nodes that are too large are cut from counts; all rows are fitted and scored."""
    folded, grid = SP.with_folds(table, folds=2), {"mtry": [5], "min_n": [10]}
    seen = []
    grow = G.large_nodes
    monkeypatch.setattr(G, "large_nodes", lambda *a: seen.append(grow(*a)) or seen[-1])
    monkeypatch.setattr(G, "WORK_DEALT", 1500)      # several jobs
    parts = [G.tune_predictions(folded, str(tmp_path / name), grid, trees=12, rows_per_task=rows)
             for name, rows in (("whole", None), ("dealt", 90))]
    assert len(seen) == 2 and all(len(top.feature) > 3 for tops, _ in seen for top in tops.values())
    assert all(part.count() == part.select("application_id").distinct().count() == folded.count()
               and part.where("predicted_pd BETWEEN 0 AND 1").count() == folded.count()
               for part in parts)
    whole, dealt = (part.select("application_id", F.col("predicted_pd").alias(name))
                    for name, part in zip(("a", "b"), parts))
    assert whole.join(dealt, "application_id").agg(F.corr("a", "b")).first()[0] > 0.7


def test_many_ways_to_score_agree():
    rng = np.random.default_rng(6)
    features = rng.integers(0, 9, (300, 4)).astype(float)
    labels = (rng.random(300) < features[:, 0] / 9).astype(float)
    sample = G.Sample.of(features, labels)
    grown = G.grow(sample, 2, 4, 5, rng)
    plain = G.score(grown, features)
    assert np.array_equal(G.walked(grown, features), plain)
    many = np.concatenate([features] * 60)
    assert np.array_equal(G.shares(grown, many), np.rint(np.tile(plain, 60) * G.UNIT))
    assert np.array_equal(G.shares(grown, features), np.rint(plain * G.UNIT))
    assert len(G.shares(grown, features[:0])) == 0


def test_a_grid_goes_on_where_it_stands(spark, table, tmp_path):
    folded, place = SP.with_folds(table, folds=2), str(tmp_path / "grid")
    order = ["mtry", "min_n", "application_id"]
    small = G.tune_predictions(folded, place, {"mtry": [3], "min_n": [15]}, trees=4)
    first = small.orderBy(*order).collect()
    grown = []
    grow, G.grow_grid = G.grow_grid, lambda *a, **k: grown.append((set(a[1]), a[2])) or grow(*a)
    try:
        G.tune_predictions(folded, place, {"mtry": [3], "min_n": [15]}, trees=4)
        assert grown == []
        both = G.tune_predictions(folded, place, {"mtry": [3, 6], "min_n": [15]}, trees=4)
    finally:
        G.grow_grid = grow
    assert [point for _, points in grown for point in points] == [(6, 15)]
    rows = both.orderBy(*order).collect()
    assert rows[:len(first)] == first and len(rows) == 2 * len(first)
    anew = G.tune_predictions(folded.repartition(7), str(tmp_path / "other"),
                              {"mtry": [3, 6], "min_n": [15]}, trees=4)
    assert anew.orderBy(*order).collect() == rows


def plain_cut(features, labels, weight):
    """The least Gini impurity over every cut of every column."""
    best = None
    for column in features.T:
        for cut in np.unique(column)[:-1]:
            impurity = 0.0
            for side in (column <= cut, column > cut):
                n, good = weight[side].sum(), (weight * labels)[side].sum()
                impurity += 2 * good * (n - good) / n if n else 0.0
            best = impurity if best is None else min(best, impurity)
    return best


def test_trees_cut_best_and_stop_at_min_n():
    rng = np.random.default_rng(3)
    for trial in range(20):
        features = rng.integers(0, 6, (60, 4)).astype(float)
        labels = (rng.random(60) < 0.2 + 0.1 * features[:, trial % 4]).astype(float)
        sample = G.Sample.of(features, labels)
        trees = G.grow(sample, 4, 8, 3, np.random.default_rng(trial))
        drawn = np.random.default_rng(trial)
        weights = [np.bincount(drawn.integers(0, 60, 60), minlength=60) for _ in range(3)]
        total = np.zeros(60)
        for root in range(3):
            open_nodes = [(root, np.arange(60))]
            while open_nodes:
                node, rows = open_nodes.pop()
                weight = weights[root][rows].astype(float)
                own = labels[rows]
                n, good = weight.sum(), (weight * own).sum()
                assert trees.share[node] == pytest.approx(good / n)
                least = plain_cut(features[rows][weight > 0], own[weight > 0], weight[weight > 0])
                now = 2 * good * (n - good) / n
                if n < 8 or now == 0 or least is None or least > now - 1e-9:
                    assert trees.feature[node] == -1
                    total[rows] += trees.share[node]
                    continue
                right = features[rows, trees.feature[node]] > trees.cut[node]
                made = 0.0
                for side in (right, ~right):
                    m, g = weight[side].sum(), (weight * own)[side].sum()
                    made += 2 * g * (m - g) / m
                assert made == pytest.approx(least)
                open_nodes += [(trees.left[node], rows[~right]),
                               (trees.left[node] + 1, rows[right])]
        assert G.score(trees, features) == pytest.approx(total)


def test_ranked_cuts_score_like_values():
    """Also values that equal a cut, a tree of one leaf, and rows that do not fill a byte."""
    rng = np.random.default_rng(5)
    features = rng.integers(0, 9, (203, 5)).astype(float) / 2
    labels = (rng.random(203) < features[:, 0] / 5).astype(float)
    sample = G.Sample.of(features, labels)
    lone = G.Trees(1, np.array([-1]), np.zeros(1), np.zeros(1, np.int64), np.array([0.25]))
    forests = {(2, 3): [G.grow(sample, 2, 3, 4, rng), lone], (5, 9): [G.grow(sample, 5, 9, 3, rng)]}
    asked = np.concatenate([features, features - 0.25, [[-1e300] * 5, [1e300] * 5]])
    cuts, placed = G.ranked(forests, 5)
    codes = G.lower_cuts(asked, cuts)
    assert codes.dtype == np.uint16
    for point, forest in forests.items():
        for trees, own in zip(forest, placed[point]):
            plain = np.zeros(len(asked))
            for row, values in enumerate(asked):
                for node in range(trees.count):
                    while trees.feature[node] >= 0:
                        node = trees.left[node] + (values[trees.feature[node]] > trees.cut[node])
                    plain[row] += trees.share[node]
            assert np.array_equal(G.score(trees, asked), plain)
            assert np.array_equal(G.score(own, codes), plain)


def test_rows_are_scored_many_at_a_time():
    frames = [pd.DataFrame({"a": range(n)}) for n in (3, 0, 4, 2, 1)]
    assert [len(part) for part in G.together(iter(frames), 5)] == [7, 3]
    assert list(G.together(iter(frames[1:2]), 5)) == []


def test_grid_of_rows_without_a_predictor(table, tmp_path):
    folded = SP.with_folds(table, folds=2)
    holed = folded.withColumn("annual_revenue", F.when(
        F.col("application_id") % 5 > 0, F.col("annual_revenue")))
    scored = G.tune_predictions(holed, str(tmp_path / "grid"), {"mtry": [40], "min_n": [5]},
                                trees=3)
    missing = holed.where("annual_revenue is null").count()
    assert scored.count() == folded.count()
    assert scored.where("predicted_pd is null").count() == missing > 0
    with pytest.raises(ValueError, match="no folds"):
        G.tune_predictions(folded.limit(0), str(tmp_path / "empty"))


def test_empty_columns_are_told_and_pass_the_gate(spark, small):
    rows = small.flat.count()
    empty = small.flat.withColumn("bureau_score", F.lit(None).cast("int"))
    report = {r["check"]: r["violations"] for r in Q.gate_suite(empty, rows).collect()}
    assert report["dq_col_count"] == 0
    assert [r["column"] for r in Q.empty_columns(empty).collect()] == ["bureau_score"]
    more = Q.gate_suite(small.flat.withColumn("extra", F.lit(None).cast("int")), rows)
    assert {r["check"]: r["violations"] for r in more.collect()}["dq_col_count"] == 1
    assert Q.column_count(small.flat.limit(0), 30).first()["violations"] == 0
    assert Q.empty_columns(small.flat.limit(0)).collect() == []


def test_full_duplicates(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (1, "a"), (None, "a"), (None, "a"),
                                  (None, "a")], "x int, y string")
    assert Q.full_duplicates(rows).first()["violations"] == 3
    assert Q.full_duplicates(rows.limit(0)).first()["violations"] == 0


def test_rows_without_a_pd_are_left_out_and_counted(spark):
    rows = spark.createDataFrame([("m", 0.9, 1), ("m", 0.1, 0), ("m", None, 1)],
                                 "model string, predicted_pd double, default_flag int")
    assert E.evaluate(E.score_counts(rows)).first()["recall"] == 1.0
    assert E.at_threshold(E.pd_counts(rows)).first()["recall"] == 1.0
    assert M.left_out(rows, ["model"]).first()["left_out"] == 1


def test_gate_lets_a_missing_debt_ratio_through_and_counts_rows(small):
    rows = small.flat.count()
    no_ratio = small.flat.withColumn("debt_to_income_ratio", F.lit(None).cast("decimal(6,3)"))
    report = {r["check"]: r["violations"] for r in Q.gate_suite(no_ratio, rows).collect()}
    assert report["dq_dti_range_or_missing"] == 0 and len(report) == len(Q.GATE_CHECKS) == 13
    with pytest.raises(Q.QualityError, match="dq_row_count"):
        Q.gate(Q.gate_suite(small.flat, rows + 1))
    above = small.flat.withColumn("debt_to_income_ratio", F.lit(1.5).cast("decimal(6,3)"))
    with pytest.raises(Q.QualityError, match="dq_dti_range_or_missing"):
        Q.gate(Q.gate_suite(above, rows))


FITS = {"Logistic Regression": M.fit_logistic,
        "Random Forest": lambda train: M.fit_forest(train, trees=10)}


def test_from_csv_to_scores(spark, small, tmp_path):
    path = str(tmp_path / "record.csv")
    text = small.flat.withColumns({
        name: F.concat(F.lit("K"), F.col(name).cast("string")) for name in S.ID_COLUMNS})
    files.write_csv(text, path)
    flat, rejects = files.read_csv_quarantined(spark, path, S.FLAT_TEXT_KEYS,
                                               str(tmp_path / "read"))
    out = pipeline.run(flat, str(tmp_path / "work"), 1500, FITS, rejects=rejects)
    assert out.clean.count() == 1500
    assert out.scored.count() == out.split.where("side = 'test'").count()
    metrics = {r["model"]: r["roc_auc"] for r in out.metrics.collect()}
    assert set(metrics) == set(FITS) and min(metrics.values()) > 0.5
    assert out.confusion.count() == 8 and out.calibration.count() == 20
    for name in FITS:
        kept = out.artifacts[name]
        assert kept.medians == X.fit_medians(flat)
        assert kept.split.count() == out.split.count()
    with pytest.raises(Q.QualityError, match="dq_row_count"):
        pipeline.run(flat, str(tmp_path / "other"), 1501)


def test_from_five_tables_to_scores(small, tmp_path):
    star = Portfolio(small.customers, small.applications, small.assessments, small.decisions,
                     small.performance)
    fits = {"Logistic Regression": M.fit_logistic}
    out = pipeline.run(star, str(tmp_path / "work"), 1500, fits)
    flat = pipeline.run(small.flat, str(tmp_path / "flat"), 1500, fits)
    assert out.clean.exceptAll(flat.clean).count() == 0 and out.clean.count() == 1500
    assert out.metrics.collect() == flat.metrics.collect()
    torn = Portfolio(small.customers, small.applications, small.assessments.where(
        "application_id % 7 > 0"), small.decisions, small.performance)
    with pytest.raises(Q.QualityError, match="dq_row_count"):
        pipeline.run(torn, str(tmp_path / "torn"), 1500, fits)


def test_the_gate_tells_before_medians_fail(small, tmp_path):
    empty = small.flat.withColumn("bureau_score", F.lit(None).cast("int"))
    late = empty.withColumn("approval_date", F.date_sub("application_date", 3))
    with pytest.raises(Q.QualityError, match="dq_approval_order"):
        pipeline.run(late, str(tmp_path / "late"), 1500)
    with pytest.raises(ValueError, match="no finite median for: bureau_score"):
        pipeline.run(empty, str(tmp_path / "empty"), 1500)


def test_damaged_lines_go_to_the_reject_table(spark, tmp_path):
    (tmp_path / "in.csv").write_text(
        "id,day,amount,name\n1,2024-01-31,1.50,plain\nzz,31.31.2020,2,\"a, b\"\n"
        "3,2024-02-30,x,c\n4,2024-01-01\n5,2024-01-01,1,d,too many\n6,,,\n"
        "7,2024-03-01,2.25,\"two words\"\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField(
        "day", T.DateType()), T.StructField("amount", T.DecimalType(8, 2)), T.StructField(
        "name", T.StringType())])
    good, rejects = files.read_csv_quarantined(
        spark, str(tmp_path / "in.csv"), schema, str(tmp_path / "read"))
    assert good.schema == schema
    assert [row["id"] for row in good.orderBy("id").collect()] == [1, 6, 7]
    assert good.where("id = 6 AND day IS NULL AND amount IS NULL").count() == 1
    assert good.select("amount").where("id = 7").first()[0] == Decimal("2.25")
    told = {row["record"]: row["reasons"] for row in rejects.collect()}
    assert told.pop("4,2024-01-01") == "the line does not have 4 fields"
    assert told.pop("5,2024-01-01,1,d,too many") == "the line does not have 4 fields"
    assert sorted(told.values()) == [
        "day is no date; amount is no decimal(8,2)", "id is no int; day is no date"]
    assert any('"name":"a, b"' in record for record in told)
    report = Q.with_rejects(Q.row_count(good, 3), rejects)
    with pytest.raises(Q.QualityError, match="'src_no_rejects': 4"):
        Q.gate(report)
    (tmp_path / "none.csv").write_text("id,day,amount,name\n")
    good, rejects = files.read_csv_quarantined(
        spark, str(tmp_path / "none.csv"), schema, str(tmp_path / "none"))
    assert (good.count(), rejects.count()) == (0, 0)


def test_an_artifact_is_whole_or_not_there(spark, table, tmp_path):
    place = str(tmp_path / "models")
    with pytest.raises(ART.ArtifactError, match="no whole version"):
        ART.load(spark, place)
    split = SP.with_folds(SP.group_split(table))
    model, medians = M.fit_logistic(split), dict.fromkeys(S.IMPUTED_COLUMNS, 1.5)
    first = ART.save(place, model, medians, split)
    second = ART.save(place, M.fit_forest(split, trees=3, max_depth=3), medians, split)
    assert ART.versions(spark, place) == [first.version, second.version]
    assert ART.load(spark, place).version == second.version
    kept = ART.load(spark, place, first.version)
    assert kept.medians == medians and {r["part"]: r["rows"] for r in kept.manifest.collect()} == {
        "model": len(M.feature_names(model)), "medians": 4, "split": split.count(),
        "train": split.where("side = 'train'").count()}
    spark.createDataFrame([("bureau_score", 2.5)], "variable string, median double").write.mode(
        "overwrite").parquet(f"{place}/{second.version}/medians")
    with pytest.raises(ART.ArtifactError, match="medians"):
        ART.load(spark, place)
    M.save(M.fit_logistic(split.where("fold <> 1")), f"{place}/{first.version}/model")
    with pytest.raises(ART.ArtifactError, match="model"):
        ART.load(spark, place, first.version)
    shutil.rmtree(f"{place}/{second.version}/manifest")
    assert ART.versions(spark, place) == [first.version]


def test_a_batch_without_a_commit_is_not_shown(spark, small, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    small.flat.select(*scoring.INPUT_COLUMNS).repartition(3).write.parquet(source)
    calls = []

    def predict(rows):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return rows.withColumn("predicted_pd", F.lit(0.05))

    def stream():
        scoring.score_stream(scoring.read_applicants(spark, source, files_per_batch=1), predict,
                             out, str(tmp_path / "checkpoint"),
                             X.fit_medians(small.flat)).awaitTermination()

    with pytest.raises(StreamingQueryException):
        stream()
    spark.range(5).write.parquet(f"{out}/scored/batch=1")          # what a broken batch leaves
    assert scoring.read_commits(spark, out).count() == 1
    assert {row["batch"] for row in scoring.read_scored(spark, out).select(
        "batch").distinct().collect()} == {0}
    stream()
    sums = scoring.read_commits(spark, out).agg(*[F.sum(name) for name in (
        "arrived", "scored", "rejected")]).first()
    assert tuple(sums) == (1500, scoring.read_scored(spark, out).count(),
                           scoring.read_rejected(spark, out).count())
    assert sums[1] + sums[2] == 1500


def test_stages_stop(small, table, tmp_path):
    one_class = SP.with_folds(SP.group_split(table)).withColumn("default_flag", F.lit(0))
    with pytest.raises(ValueError, match="split is invalid"):
        pipeline.assert_divided(one_class)
    torn = SP.with_folds(SP.group_split(table)).withColumn("fold", F.when(
        F.col("application_id") % 2 == 0, 1).otherwise(2))
    with pytest.raises(ValueError, match="folds are invalid"):
        pipeline.assert_divided(torn)
    with pytest.raises(Q.QualityError, match="pd_range"):
        pipeline.scored(table.select(*S.ID_COLUMNS, S.LABEL).withColumn(
            "predicted_pd", F.lit(1.5)))


def test_plain_turns_decimals_into_doubles(small):
    kinds = {f.dataType.typeName() for f in plain(small.flat).schema}
    assert "decimal" not in kinds


def test_cleanup_removes_tables_and_folder(spark, tmp_path):
    """In another session's place: the shared portfolio of the tests must stay."""
    from lendbook.sources import star

    before = dict(star._PUBLISHED)
    star._PUBLISHED.clear()
    star._PUBLISHED[spark.sparkContext.applicationId, "gone"] = "lendbook_gone"
    spark.range(3).write.mode("overwrite").option("path", str(tmp_path / "t")).saveAsTable(
        "lendbook_gone")
    removed = []
    keep, star.remove_work = star.remove_work, removed.append
    try:
        star.cleanup(spark)
    finally:
        star.remove_work = keep
        star._PUBLISHED.update(before)
    assert not spark.catalog.tableExists("lendbook_gone") and removed == [spark]
