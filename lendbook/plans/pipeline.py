"""From application records to scored applicants: gate, clean, split, fit, evaluate, score.

Each stage refuses to go on when what it needs does not hold: damaged records are not cleaned, an
overlapping or one-class split is not trained on, and scores that fail their checks are not
handed out. Every stage is written once under ``place`` and read by the next.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendbook.functions.scorecard import with_score
from lendbook.operators import artifacts as ART
from lendbook.operators import evaluate as E
from lendbook.operators import features as X
from lendbook.operators import model as M
from lendbook.operators import quality as Q
from lendbook.operators import split as SP
from lendbook.plans import scoring as PS
from lendbook.sources.star import Portfolio


#: The models that are fitted, compared and reported; the first one gives the scores.
MODELS: dict[str, Callable[[DataFrame], PipelineModel]] = {
    "Logistic Regression": M.fit_logistic, "Random Forest": M.fit_forest}


@dataclass(frozen=True)
class Outcome:
    """What the stages leave behind. ``artifacts`` holds each model with its medians and split."""

    clean: DataFrame
    split: DataFrame
    artifacts: dict[str, ART.Artifact]
    predictions: DataFrame
    metrics: DataFrame
    confusion: DataFrame
    calibration: DataFrame
    scored: DataFrame


def gated(flat: DataFrame, expected_rows: int, rejects: DataFrame | None = None) -> DataFrame:
    """The record as it is, once the gate is passed; ``rejects`` come from the source's reader."""
    report = Q.gate_suite(flat, expected_rows)
    if rejects is not None:
        report = Q.with_rejects(report, rejects)
    Q.gate(report, [*Q.GATE_CHECKS, "src_no_rejects"])
    return flat


def cleaned(flat: DataFrame, expected_rows: int, medians: Callable[[], dict[str, float]]
            ) -> DataFrame:
    """The clean table. Medians are asked for when the gate is passed: a damaged column is told
    by the gate, not by a median that cannot be fitted."""
    return X.clean_table(gated(flat, expected_rows), medians())


def divided(clean: DataFrame, order: Column | None = None, folds: int = 5) -> DataFrame:
    """The modelling set with side and fold."""
    return SP.with_folds(SP.group_split(X.model_table(clean), order=order), folds, order=order)


def assert_divided(split: DataFrame) -> None:
    """No customer on two sides or in two folds, and both outcomes everywhere."""
    SP.assert_split(split)
    SP.assert_folds(split.where("side = 'train'"))


def scored(predictions: DataFrame) -> DataFrame:
    """Scores of predictions, once their checks are passed."""
    rows = with_score(predictions)
    Q.gate(PS.output_checks(rows))
    return rows


def run(source: DataFrame | Portfolio, place: str, expected_rows: int,
        fits: dict[str, Callable[[DataFrame], PipelineModel]] | None = None,
        order: Column | None = None, rejects: DataFrame | None = None) -> Outcome:
    """All stages over an application record (30 columns; see ``schemas``) or five tables.

    ``files.read_csv_quarantined`` of one file gives a record and its ``rejects``;
    ``Portfolio(customers, applications, assessments, decisions, performance)`` stands for five
    tables. Every model in ``fits`` is fitted on the same split, saved with it, evaluated and
    compared; the first one scores the held-out applicants.
    """
    flat = source.record() if isinstance(source, Portfolio) else source
    spark, fits = flat.sparkSession, fits or MODELS

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{place}/{name}")
        return spark.read.parquet(f"{place}/{name}")

    record = written(gated(flat, expected_rows, rejects), "record")
    medians = X.fit_medians(record)
    clean = written(X.clean_table(record, medians), "clean")
    split = written(divided(clean, order), "split")
    assert_divided(split)
    train, test = (split.where(F.col("side") == side) for side in ("train", "test"))
    saved = {name: ART.save(f"{place}/artifacts/{name.lower().replace(' ', '_')}", fit(train),
                            medians, split) for name, fit in fits.items()}
    predictions = written(reduce(DataFrame.unionByName, [
        M.predict(one.model, test).withColumn("model", F.lit(name))
        for name, one in saved.items()]), "predictions")
    first = predictions.where(F.col("model") == next(iter(fits))).drop("model")
    result = written(scored(first.where("predicted_pd IS NOT NULL")), "scored")
    return Outcome(clean, split, saved, predictions, E.evaluate(E.score_counts(predictions)),
                   E.confusion(E.pd_counts(predictions)), E.calibration(predictions), result)
