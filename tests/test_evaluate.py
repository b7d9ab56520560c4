import random

import pytest
from pyspark.sql import functions as F

from lendbook.functions import scorecard as SC
from lendbook.operators import evaluate as E
from lendbook.plans import scoring as P


def frame(spark, rows, model="m"):
    return spark.createDataFrame(
        [(model, i, p, y) for i, (p, y) in enumerate(rows)],
        "model string, application_id long, predicted_pd double, default_flag int")


def metrics(spark, rows):
    return E.evaluate(E.score_counts(frame(spark, rows))).first().asDict()


def test_metrics_against_brute_force_with_ties(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(1, 40) / 40, int(rng.random() < 0.3)) for _ in range(400)]
    got = metrics(spark, rows)
    bad = [p for p, y in rows if y]
    good = [p for p, y in rows if not y]
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(bad) / len(good)
    assert got["roc_auc"] == pytest.approx(auc, abs=1e-12)
    assert got["gini"] == pytest.approx(2 * auc - 1, abs=1e-12)
    cuts = sorted({p for p, _ in rows})
    ks = max(abs(sum(p <= c for p in bad) / len(bad) - sum(p <= c for p in good) / len(good))
             for c in cuts)
    assert got["ks"] == pytest.approx(ks, abs=1e-12)
    points = [(0.0, 1.0)]
    for cut in sorted(cuts, reverse=True):
        hits, alarms = sum(p >= cut for p in bad), sum(p >= cut for p in good)
        points.append((hits / len(bad), hits / (hits + alarms)))
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert got["pr_auc"] == pytest.approx(area, abs=1e-12)
    brier = sum((y - p) ** 2 for p, y in rows) / len(rows)
    assert got["brier_score"] == pytest.approx(brier, abs=1e-12)


@pytest.mark.parametrize("counts, expected", [
    ((21, 17, 966, 271), (0.5526, 0.0719, 0.9827, 0.1273)),
    ((17, 12, 971, 275), (0.5862, 0.0582, 0.9878, 0.1059))])
def test_recorded_confusions(spark, counts, expected):
    tp, fp, tn, fn = counts
    rows = [(0.5, 1)] * tp + [(0.9, 0)] * fp + [(0.1, 0)] * tn + [(0.4999, 1)] * fn
    got = metrics(spark, rows)
    assert tuple(round(got[n], 4) for n in
                 ("precision", "recall", "specificity", "f1")) == expected


def test_no_positive_prediction_leaves_precision_empty(spark):
    got = metrics(spark, [(0.1, 1), (0.2, 0)])
    assert got["precision"] is None and got["f1"] is None and got["recall"] == 0.0


def test_curves_have_their_end_points(spark):
    counts = E.score_counts(frame(spark, [(0.2, 0), (0.8, 1), (0.8, 0)]))
    roc = {(r["specificity"], r["sensitivity"]) for r in E.roc_curve(counts).collect()}
    assert roc == {(0.0, 1.0), (0.5, 1.0), (1.0, 0.0)}
    pr = {(r["recall"], r["precision"]) for r in E.pr_curve(counts).collect()}
    assert pr == {(0.0, 1.0), (1.0, 0.5), (1.0, 1 / 3)}


def test_calibration_splits_one_hot_probability_by_key(spark):
    rows = E.calibration(frame(spark, [(0.5, i % 2) for i in range(25)])).collect()
    assert sorted((r["bin"], r["observations"]) for r in rows) == [
        (b, 3 if b <= 5 else 2) for b in range(1, 11)]


def test_scorecard_anchors(spark):
    pds = [(1 / 21,), (1 / 41,), (1 / 11,)]
    got = [r[0] for r in spark.createDataFrame(pds, "p double").select(
        SC.raw_score(F.col("p"))).collect()]
    assert got == pytest.approx([600, 650, 550], abs=1e-8)


@pytest.mark.parametrize("pd, points", [(0.0, 850), (1.0, 300), (1 / 21, 600), (None, None)])
def test_score_limits(spark, pd, points):
    row = spark.createDataFrame([(pd,)], "p double").select(SC.score(F.col("p"))).first()
    assert row[0] == points


@pytest.mark.parametrize("points, band, flag", [
    (300, "Very High Risk", "Enhanced review"), (549, "Very High Risk", "Enhanced review"),
    (550, "High Risk", "Enhanced review"), (599, "High Risk", "Enhanced review"),
    (600, "Elevated Risk", "Enhanced review"), (650, "Moderate Risk", "Standard review"),
    (700, "Low Risk", "Routine monitoring"), (850, "Very Low Risk", "Routine monitoring")])
def test_risk_band_edges(spark, points, band, flag):
    row = spark.createDataFrame([(points,)], "s int").select(
        SC.risk_band(F.col("s")).alias("b"),
        SC.monitoring_flag(SC.risk_band(F.col("s"))).alias("f")).first()
    assert (row["b"], row["f"]) == (band, flag)


def test_empty_bands_are_kept(spark):
    scored = SC.with_score(frame(spark, [(1 / 21, 0), (1 / 21, 1)]))
    rows = P.band_summary(scored).collect()
    assert [r["risk_band"] for r in rows] == SC.RISK_LEVELS
    assert {r["risk_band"]: r["applicants"] for r in rows}["Elevated Risk"] == 2
    assert rows[0]["actual_default_rate"] is None and rows[0]["actual_defaults"] == 0


def test_output_checks_find_a_score_that_rises(spark):
    scored = SC.with_score(frame(spark, [(0.1, 0), (0.2, 0), (0.3, 1)]))
    def broken(df):
        return {r["check"]: r["violations"] for r in P.output_checks(df).collect()}
    assert set(broken(scored).values()) == {0}
    raised = scored.withColumn("credit_score", F.when(F.col("predicted_pd") == 0.3, 840)
                               .otherwise(F.col("credit_score")))
    assert broken(raised)["score_monotone"] > 0
