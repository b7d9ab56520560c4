import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lendbook.operators.prefix import running_totals, tile
from lendbook.operators.quantiles import exact_medians, exact_quantiles, wide_quantiles
from lendbook.operators.segments import segment_rates, segment_rates_many
from lendbook.operators.split import assert_split, fold_check, group_split, split_check, with_folds


def skewed(spark, rows=3000, seed=3):
    """A third of the rows belong to one group and one value."""
    rng = random.Random(seed)
    data = [("hot" if i % 3 == 0 else f"g{rng.randrange(5)}",
             7 if i % 3 == 0 else rng.randrange(400), i) for i in range(rows)]
    return spark.createDataFrame(data, "g string, v int, id long").repartition(8)


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_running_totals_equal_a_global_window(spark, groups):
    df = skewed(spark).withColumn("one", F.lit(1))
    order = Window.partitionBy(*groups).orderBy("v", "id")
    expected = df.select("id", F.sum("one").over(order.rowsBetween(
        Window.unboundedPreceding, 0)).alias("cum_one"),
        F.count("*").over(Window.partitionBy(*groups)).alias("total_one"))
    got = running_totals(df, ["v", "id"], ["one"], groups).select("id", "cum_one", "total_one")
    assert got.exceptAll(expected).count() == 0 and got.count() == 3000


def test_running_totals_shuffle_rows_once_and_broadcast_no_hint(spark, tmp_path):
    skewed(spark).withColumn("one", F.lit(1)).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    got = running_totals(df, ["v", "id"], ["one"], ["g"])
    assert "ResolvedHint" not in got._jdf.queryExecution().analyzed().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = got.select("*")._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = [plan[place + 1] for place, line in enumerate(plan) if "Exchange" in line]
    # One shuffle is of rows, the others of sums by range and group.
    assert len([line for line in below if "Project" in line and "bucketizer" in line]) == 1, plan
    assert len(below) == 4
    assert "rangepartitioning" not in "".join(plan)


@pytest.mark.parametrize("kind", ["int", "bigint", "double", "string", "decimal(38,4)", "date",
                                  "timestamp", "boolean"])
def test_running_totals_over_any_kind(spark, kind):
    values = {"date": "date_add(date'2020-01-01', cast(v as int))",
              "timestamp": "timestamp_seconds(v)", "string": "concat('a common start ', v)",
              "boolean": "v > 200"}.get(kind, f"cast(v as {kind})")
    df = skewed(spark).selectExpr(
        f"if(v % 11 = 1, null, {values}) AS v", "id", "1L AS one")
    order = Window.orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)
    expected = df.select("id", F.sum("one").over(order).alias("cum_one"))
    got = running_totals(df, ["v", "id"], ["one"]).select("id", "cum_one")
    assert got.exceptAll(expected).count() == 0 and got.count() == 3000


def test_a_hot_value_is_spread(spark):
    from lendbook.operators.prefix import ranged

    df = spark.range(30_000).selectExpr("if(id % 3 > 0, 0.5D, id / 30000) AS v", "id")
    sizes = [row["count"] for row in ranged(df, ["v", "id"]).groupBy(
        "_range", "_part").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 6000
    odd = spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (None, 3), (-0.0, 4),
                                 (0.0, 5), (float("-inf"), 6)], "v double, id int")
    assert sorted(row["_range"] for row in ranged(odd, ["v"]).collect())[0] == 0.0


@pytest.mark.parametrize("rows", [3, 10, 97, 100])
def test_tile_equals_ntile(spark, rows):
    df = spark.range(rows).withColumn("pos", F.row_number().over(Window.orderBy("id")))
    both = df.select(tile(F.col("pos"), F.lit(rows), 10).alias("mine"),
                     F.ntile(10).over(Window.orderBy("id")).alias("spark"))
    assert both.where("mine <> spark").count() == 0


@pytest.mark.parametrize("fetched, steps", [(20_000, 128), (5, 16), (1, 4)])
def test_wide_quantiles_equal_percentile(spark, fetched, steps):
    df = spark.range(20_000).selectExpr(
        "pow(2.5D, id % 97) * (id % 13 - 6) AS wide", "if(id % 3 > 0, 0.5D, id / 7) AS hot",
        "cast(id % 2 AS int) AS two", "cast(NULL AS double) AS none",
        "if(id % 5 > 0, double('NaN'), id * 1.0D) AS holed",
        "if(id % 10 = 0, double('-Infinity'), if(id % 10 = 1, double('Infinity'), id)) AS ends",
        "cast(id AS decimal(20,3)) / 8 AS money", "if(id = 77, 1L, NULL) AS one")
    probs = {"p0": 0.0, "p25": 0.25, "median": 0.5, "p999": 0.999, "p100": 1.0}
    names = [name for name in df.columns]
    got = {row[0]: row[1:] for row in wide_quantiles(df, names, probs, fetched, steps).collect()}
    assert set(got) == set(names) - {"none"}
    clean = df.select(*[F.nanvl(F.col(n).cast("double"), F.lit(None).cast("double")).alias(n)
                        for n in names])
    for name in got:
        wanted = clean.agg(*[F.percentile(name, F.lit(p)) for p in probs.values()]).first()
        assert tuple(got[name]) == pytest.approx(tuple(wanted), rel=1e-12), name
    assert wide_quantiles(df.limit(0), names, probs).collect() == []


def test_wide_quantiles_shuffle_no_row_per_value(spark):
    """Rows written to shuffles: one for each task and pass, and the values of the last brackets."""
    df = spark.range(0, 50_000, 1, 4).selectExpr("id * 1.5D AS a", "sin(id) AS b")
    tracker = spark._jsc.sc().statusTracker()
    spark.sparkContext.setJobGroup("wide", "")
    wide_quantiles(df, ["a", "b"], {"median": 0.5}, fetched=100)
    store = spark._jsc.sc().statusStore()
    written = 0
    for job in tracker.getJobIdsForGroup("wide"):
        for stage in tracker.getJobInfo(job).get().stageIds():
            written += store.lastStageAttempt(stage).shuffleWriteRecords()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < written < 500


def test_exact_quantiles_equal_percentile(spark):
    df = skewed(spark).select(F.col("g").alias("variable"),
                              (F.col("v") / 3).alias("value"))
    probs = {"p25": 0.25, "median": 0.5, "p90": 0.9}
    expected = {r[0]: r[1:] for r in df.groupBy("variable").agg(
        *[F.percentile("value", F.lit(p)) for p in probs.values()]).collect()}
    for row in exact_quantiles(df, probs).collect():
        assert tuple(row)[1:] == pytest.approx(expected[row["variable"]], abs=1e-12)


def test_medians_ignore_null_and_nan_and_fail_when_empty(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (float("nan"), None), (4.0, None)],
                               "a double, b double")
    assert exact_medians(df, ["a"]) == {"a": 2.5}
    with pytest.raises(ValueError, match="b"):
        exact_medians(df, ["a", "b"])


def test_segment_rates_variants(spark):
    df = spark.createDataFrame([("x", 1), ("x", 0), (None, 1)], "s string, default_flag int")
    rows = {r["s"]: r for r in segment_rates(df, "s").collect()}
    assert rows["x"]["default_rate_pct"] == 50.0 and rows[None]["defaults"] == 1
    assert segment_rates(df, "s", drop_null=True).count() == 1
    many = segment_rates_many(df, ["s"], unit="fraction").collect()
    assert {(r["variable"], r["segment"], r["default_rate"]) for r in many} == {
        ("s", "x", 0.5), ("s", None, 1.0)}


def test_group_split_properties(spark):
    df = skewed(spark).select(F.concat("g", (F.col("id") % 40).cast("string"))
                              .alias("customer_id"), "id", (F.col("id") % 4 == 0).cast("int")
                              .alias("default_flag"))
    split = group_split(df).persist()
    check = split_check(split).first()
    assert check["overlap"] == 0
    assert_split(split)
    share = split.where("side = 'train'").count() / 3000
    largest = df.groupBy("customer_id").count().agg(F.max("count")).first()[0] / 3000
    assert 0.80 - largest < share <= 0.80
    assert split.count() == 3000
    again = group_split(df.repartition(3))
    assert split.select("id", "side").exceptAll(again.select("id", "side")).count() == 0
    checks = {r["check"]: r["violations"] for r in fold_check(with_folds(split)).collect()}
    assert checks == {"overlap": 0, "missing_class": 0}


def test_one_class_fold_is_reported(spark):
    df = spark.createDataFrame([("a", 1, 0), ("b", 2, 0), ("b", 2, 1)],
                               "customer_id string, fold int, default_flag int")
    checks = {r["check"]: r["violations"] for r in fold_check(df).collect()}
    assert checks == {"overlap": 0, "missing_class": 1}
