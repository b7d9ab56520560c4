"""Default models on Spark ML: feature recipe, logistic regression, random forest,
cross-validation over customer-grouped folds. ``forest_grid`` tunes forests."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    SQLTransformer, StandardScaler, VarianceThresholdSelector, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendbook import schemas as S
from lendbook.operators import evaluate as E
from lendbook.operators.features import leakage_guard
from lendbook.operators.forest import Forest
from lendbook.operators.quantiles import unpivot
from lendbook.session import work_folder

# The benchmark forest and the tuning grid.
FOREST = {"mtry": 6, "min_n": 15, "trees": 500}
GRID = {"mtry": [3, 6, 9, 12], "min_n": [5, 15, 25]}
SEED = 20260922
UNKNOWN_LEVEL = "unknown"
PARALLELISM = 5
#: Rows that the fits of several folds keep in memory or on disk at a time.
ROWS_KEPT = 2_000_000
#: Trees are hardly bounded in depth: this is the greatest depth of Spark's own trees.
MAX_DEPTH = 30


def nominal_levels(train: DataFrame, max_levels: int = 1000) -> dict[str, list[str]]:
    """Sorted training levels of each nominal predictor; a missing value is a level.

    Each level becomes a column of the model, so more than ``max_levels`` in all is an error: a
    predictor like that is an identifier. Nothing is dropped.
    """
    filled = train.select(*[
        F.coalesce(F.col(name), F.lit(UNKNOWN_LEVEL)).alias(name)
        for name in S.NOMINAL_PREDICTORS])
    found = unpivot(filled, S.NOMINAL_PREDICTORS, as_type="string").distinct()
    rows = found.limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"nominal predictors have more than {max_levels} levels")
    return {name: sorted(row["value"] for row in rows if row["variable"] == name)
            for name in S.NOMINAL_PREDICTORS}


def _indicators(levels: dict[str, list[str]]) -> dict[str, str]:
    """Indicator name -> SQL condition, the first level of each predictor left out.

    A level unseen in training sets no indicator, like the left-out level.
    """
    conditions: dict[str, str] = {}
    for column, names in levels.items():
        for level in names[1:]:
            base = re.sub(r"\W+", "_", f"{column}_{level}")
            name, count = base, 1
            while name in conditions:
                count += 1
                name = f"{base}_{count}"
            text = level.replace("\\", "\\\\").replace("'", "\\'")
            conditions[name] = (f"CAST(COALESCE(`{column}`, '{UNKNOWN_LEVEL}') = '{text}' "
                                "AS DOUBLE)")
    return conditions


def recipe(train: DataFrame, normalise: bool, max_levels: int = 1000) -> list:
    """Stages from the modelling table to a feature vector: indicator columns, constant columns
    dropped, and for the regression every column centred and scaled."""
    leakage_guard(set(train.columns) - {"side", "fold"})
    conditions = _indicators(nominal_levels(train, max_levels))
    selected = ", ".join(f"{sql} AS `{name}`" for name, sql in conditions.items())
    stages = [
        SQLTransformer(statement="SELECT *" + (f", {selected}" if selected else "")
                       + " FROM __THIS__"),
        VectorAssembler(inputCols=[*S.NUMERIC_PREDICTORS, *conditions], outputCol="assembled",
                        handleInvalid="keep"),
        VarianceThresholdSelector(featuresCol="assembled", outputCol="varying",
                                  varianceThreshold=0.0),
    ]
    if normalise:
        stages.append(StandardScaler(inputCol="varying", outputCol="features", withMean=True,
                                     withStd=True))
    return stages


def complete_rows(train: DataFrame) -> DataFrame:
    """Rows without a missing predictor; only those can be fitted."""
    return train.dropna(subset=S.NUMERIC_PREDICTORS)


def prepare(train: DataFrame, normalise: bool) -> tuple[PipelineModel, DataFrame]:
    """The fitted recipe and the training rows it has turned into (label, vector)."""
    rows = complete_rows(train)
    fitted = Pipeline(stages=recipe(rows, normalise)).fit(rows)
    vector = fitted.stages[-1].getOutputCol()
    return fitted, fitted.transform(rows).select(S.LABEL, vector)


def spread(rows: DataFrame) -> DataFrame:
    """At least one partition per core, so that every pass of a fit uses the cluster."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def logistic() -> LogisticRegression:
    return LogisticRegression(labelCol=S.LABEL, featuresCol="features", regParam=0.0,
                              standardization=False, maxIter=200, tol=1e-8)


class ConvergenceError(ValueError):
    """Raised when a fit stops at its limit of iterations."""


def fit_logistic(train: DataFrame) -> PipelineModel:
    """Unpenalised logistic regression of default; fails when it does not converge."""
    prepared, rows = prepare(train, normalise=True)
    model = logistic().fit(spread(rows))        # which keeps its own blocks of the rows
    steps = model.summary.totalIterations
    if steps >= model.getMaxIter():
        raise ConvergenceError(f"the regression has not converged after {steps} iterations")
    return PipelineModel([*prepared.stages, model])


def aliased_terms(model: PipelineModel, train: DataFrame, tolerance: float = 1e-9) -> list[str]:
    """Terms that are linear combinations of the terms before them.

    Their weight cannot be told from that of the others. Found by sweeping the correlations of
    the columns, one small matrix, in order of the terms.
    """
    recipe = PipelineModel(model.stages[:-1])
    rows = recipe.transform(complete_rows(train)).select("features")
    left = Correlation.corr(rows, "features").first()[0].toArray().copy()
    found = []
    for place, name in enumerate(feature_names(model)):
        if left[place, place] < tolerance:
            found.append(name)
            continue
        left -= left[:, [place]] @ left[[place], :] / left[place, place]
    return found


def fit_forest(train: DataFrame, mtry: int = FOREST["mtry"], min_n: int = FOREST["min_n"],
               trees: int = FOREST["trees"], max_depth: int = MAX_DEPTH,
               seed: int = SEED) -> PipelineModel:
    """Random forest of default.

    ``min_n`` is the size a node needs to be split; here each child is bounded, so half of it is
    used.
    """
    prepared, rows = prepare(train, normalise=False)
    vectors = rows.select(S.LABEL, vector_to_array("varying").alias("features"))
    rows = spread(vectors).persist()
    try:
        model = Forest.fit(rows, S.LABEL, "features", mtry, max(1, (min_n + 1) // 2), trees,
                           max_depth, seed)
    finally:
        rows.unpersist()
    return PipelineModel([*prepared.stages, model])


def predict(model: PipelineModel, df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Ids, label if present, and the probability of default; missing where a predictor is."""
    wanted = [*S.ID_COLUMNS, S.LABEL, *keep]
    names = [name for name in dict.fromkeys(wanted) if name in df.columns]
    if isinstance(model.stages[-1], Forest):
        vectors = PipelineModel(model.stages[:-1]).transform(df).select(
            *names, vector_to_array("varying").alias("_features"))
        return model.stages[-1].score(vectors, "_features", "predicted_pd")
    probability = vector_to_array(F.col("probability"))[1]
    return model.transform(df).select(
        *names, F.nanvl(probability, F.lit(None).cast("double")).alias("predicted_pd"))


def feature_names(model: PipelineModel) -> list[str]:
    """Names of the vector's entries after constant columns were dropped."""
    inputs = model.stages[1].getInputCols()
    return [inputs[index] for index in sorted(model.stages[2].selectedFeatures)]


def coefficients(model: PipelineModel, train: DataFrame | None = None) -> DataFrame:
    """(term, coefficient, odds_ratio) for default, and the same with the sign turned round for
    non-default. One row per model term.

    With the training rows, ``aliased`` tells the terms whose coefficient has no meaning of its
    own, because other terms determine them.
    """
    aliased = set(aliased_terms(model, train)) if train is not None else set()
    fit = model.stages[-1]
    terms = [("(Intercept)", float(fit.intercept))]
    terms += [(name, float(value))
              for name, value in zip(feature_names(model), fit.coefficients.toArray())]
    rows = [(term, value, math.exp(value), -value, math.exp(-value), int(term in aliased))
            for term, value in terms]
    return SparkSession.getActiveSession().createDataFrame(
        rows, "term string, coefficient double, odds_ratio double, non_default_coefficient double, "
              "non_default_odds_ratio double, aliased int")


def importance(model: PipelineModel) -> DataFrame:
    """(variable, importance) of a forest, largest first. One row per feature."""
    values = model.stages[-1].importances()
    rows = sorted(zip(feature_names(model), map(float, values)), key=lambda r: -r[1])
    return SparkSession.getActiveSession().createDataFrame(
        rows, "variable string, importance double")


CV_METRICS = {"roc_auc": "roc_auc", "pr_auc": "pr_auc", "accuracy": "accuracy",
              "precision": "precision", "recall": "recall", "specificity": "specificity",
              "f1": "f_meas"}


def _over_folds(folded: DataFrame, one: Callable[[DataFrame, DataFrame], DataFrame],
                parallelism: int) -> DataFrame:
    """Predictions of every fold, from ``one(rows outside it, rows inside it)``.

    Folds are independent, so several are worked on at a time, as CrossValidator does, but as each
    fit keeps its rows, together they keep no more than ``ROWS_KEPT``, or those of one fold. The
    result is checkpointed: models score once, whatever is computed from it.
    """
    work_folder(folded.sparkSession)
    rows = folded.persist(StorageLevel.DISK_ONLY)
    try:
        sizes = {row["fold"]: row["count"] for row in rows.groupBy("fold").count().collect()}
        numbers = sorted(sizes)
        parallelism = max(1, min(parallelism, ROWS_KEPT // max(1, sum(sizes.values()))))
        # One wrapper per fold: each carries its own copy of the job properties.
        tasks = [
            inheritable_thread_target(folded.sparkSession)(partial(
                one, rows.where(F.col("fold") != number), rows.where(F.col("fold") == number)))
            for number in numbers]
        with ThreadPool(min(parallelism, len(tasks))) as pool:
            parts = pool.map(lambda task: task(), tasks)
        return reduce(DataFrame.unionByName, parts).checkpoint()
    finally:
        rows.unpersist()


def cross_predict(folded: DataFrame, fit: Callable[[DataFrame], PipelineModel],
                  parallelism: int = PARALLELISM) -> DataFrame:
    """Out-of-fold predictions: every fold is scored by a model fitted on the others."""
    return _over_folds(
        folded, lambda train, held: predict(fit(train), held, keep=["fold"]), parallelism)


def summarise_folds(predictions: DataFrame, by: Iterable[str] = (),
                    metrics: Iterable[str] = tuple(CV_METRICS)) -> DataFrame:
    """(metric, mean, std_err, n) over folds, from one counting job for all folds.

    Rows without a PD are left out, as they are in the holdout metrics; ``left_out`` counts them.
    """
    by, metrics = list(by), list(metrics)
    keys = [*by, "fold"]
    per_fold = E.evaluate(E.score_counts(predictions, by=keys), by=keys)
    named = per_fold.select(*keys, *[F.col(name).alias(CV_METRICS[name]) for name in metrics])
    long = named.unpivot(keys, [CV_METRICS[name] for name in metrics], "metric", "value")
    return long.groupBy(*by, "metric").agg(
        F.avg("value").alias("mean"),
        (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("std_err"),
        F.count("value").alias("n"))


def cross_validate(folded: DataFrame, fit: Callable[[DataFrame], PipelineModel],
                   metrics: Iterable[str] = tuple(CV_METRICS)) -> DataFrame:
    return summarise_folds(cross_predict(folded, fit), metrics=metrics)


def sampled(folded: DataFrame, rows: int) -> Column:
    """Whether a row belongs to the sample of ``labelled_sample``.

    The threshold is exact: customers are taken in order of the hash of their id until they hold
    ``rows`` rows. The driver reads at most ``rows`` counts, one per customer.
    """
    if folded.count() <= rows:
        return F.lit(True)
    place = F.xxhash64(F.lit("tuning"), "customer_id")
    counts = folded.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    last, held = None, 0
    for row in counts.orderBy("place").limit(rows).collect():
        if held >= rows:
            break
        last, held = row["place"], held + row["n"]
    return place <= F.lit(last).cast("long")


def labelled_sample(folded: DataFrame, rows: int) -> DataFrame:
    """``rows`` labelled rows or, as customers are taken whole, a few more; all if there are less.

    Customers with the lowest hash of their id are taken.
    """
    return folded.where(sampled(folded, rows))


def best_parameters(tuned: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """The grid point with the highest mean of a metric."""
    return tuned.where(F.col("metric") == metric).orderBy(
        F.desc("mean"), "mtry", "min_n").limit(1).select(
        "mtry", "min_n", F.col("mean").alias(f"cv_{metric}"),
        F.col("std_err").alias(f"cv_{metric}_std_err"))


def left_out(predictions: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Rows that no metric counts because a predictor, and so the PD, is missing."""
    return predictions.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("predicted_pd").isNull()).alias("left_out"))


def save(model: PipelineModel, path: str) -> None:
    """A forest is stored beside its recipe, as the tables it is."""
    if isinstance(model.stages[-1], Forest):
        PipelineModel(model.stages[:-1]).write().overwrite().save(path)
        model.stages[-1].save(f"{path}/grown")
    else:
        model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    model = PipelineModel.load(path)
    if hasattr(model.stages[-1], "selectedFeatures"):       # a recipe alone
        forest = Forest.load(SparkSession.getActiveSession(), f"{path}/grown")
        return PipelineModel([*model.stages, forest])
    return model
