"""Scoring of applicants as they arrive.

The job keeps no state: every applicant is checked, given the same features the models were
trained on, scored and written; applicants that fail the input checks go to a reject table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lendbook import schemas as S
from lendbook.functions.scorecard import with_score
from lendbook.operators import features as X

INPUT_COLUMNS = [
    "application_id", "customer_id", "business_type", "business_age_years",
    "number_of_employees", "monthly_revenue", "annual_revenue", "requested_loan_amount",
    "loan_tenure_months", "loan_purpose", "existing_loans", "existing_monthly_debt",
    "debt_to_income_ratio", "bureau_score", "credit_history_years", "previous_defaults",
    "collateral_value", "bank_account_age_years",
]

# Predictors without an imputed form; an applicant without one could not be scored.
REQUIRED = [name for name in INPUT_COLUMNS if name in S.NUMERIC_PREDICTORS and name not in (
    "annual_revenue", "monthly_revenue", "requested_loan_amount", "loan_tenure_months",
    "debt_to_income_ratio")]


def applicant_schema(flat: T.StructType = S.FLAT_LONG_KEYS) -> T.StructType:
    return T.StructType([flat[name] for name in INPUT_COLUMNS])


def input_problems() -> Column:
    """Names of the input checks an applicant fails; a missing value fails its check."""
    positive = ["annual_revenue", "monthly_revenue", "requested_loan_amount",
                "loan_tenure_months"]
    checks = {f"{name} must be positive": F.col(name) > 0 for name in positive}
    checks |= {f"{name} must be given": F.col(name).isNotNull() for name in REQUIRED}
    checks["debt_to_income_ratio must be within 0 and 1"] = \
        F.col("debt_to_income_ratio").between(0, 1)
    checks["bureau_score must be within 300 and 850"] = \
        F.col("bureau_score").between(*S.BUREAU_RANGE)
    failed = [F.when(~F.coalesce(holds, F.lit(False)), F.lit(text))
              for text, holds in checks.items()]
    return F.concat_ws("; ", *failed)


def applicant_features(applicants: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Modelling columns of an applicant, missing values flagged and imputed as in training."""
    entered = X.impute(X.missing_flags(applicants), medians)
    derived = X.flags(X.ratios(entered)).drop("collateral_coverage_ratio").withColumnRenamed(
        "collateral_coverage_ratio_imputed", "collateral_coverage_ratio")
    return derived.select(
        *S.ID_COLUMNS, *S.NOMINAL_PREDICTORS,
        *[F.col(name).cast("double").alias(name) for name in S.NUMERIC_PREDICTORS])


def checked(applicants: DataFrame) -> DataFrame:
    return applicants.withColumn("problems", input_problems())


def read_applicants(spark: SparkSession, path: str, schema: T.StructType | None = None,
                    files_per_batch: int = 1000) -> DataFrame:
    """Stream of applicants from a directory of Parquet files."""
    return (spark.readStream.schema(schema or applicant_schema())
            .option("maxFilesPerTrigger", files_per_batch).parquet(path))


def score_stream(applicants: DataFrame, predict: Callable[[DataFrame], DataFrame],
                 output: str, checkpoint: str, medians: dict[str, float]) -> StreamingQuery:
    """Score everything that is available and stop.

    ``medians`` are those the model was trained with. ``predict`` adds ``predicted_pd`` to the
    feature table. Each batch overwrites its own folder, so a batch that is repeated after a
    failure leaves no duplicates. Its commit record, the rows that arrived and those seen on the
    way into either table, comes last; ``read_scored`` and ``read_rejected`` show committed
    batches only, so both tables always tell of the same applicants.
    """
    def write(batch: DataFrame, number: int) -> None:
        rows = checked(batch).persist()
        try:
            accepted = applicant_features(rows.where(F.col("problems") == ""), medians)
            scored = with_score(predict(accepted)).select(
                *S.ID_COLUMNS, "predicted_pd", "credit_score", "risk_band",
                "risk_monitoring_flag")
            rejected = rows.where(F.col("problems") != "").select(*S.ID_COLUMNS, "problems")
            seen = {"scored": Observation(), "rejected": Observation()}
            for name, part in (("scored", scored), ("rejected", rejected)):
                part.observe(seen[name], F.count(F.lit(1)).alias("n")).write.mode(
                    "overwrite").parquet(f"{output}/{name}/batch={number}")
            told = {name: seen[name].get["n"] for name in seen}
            arrived = rows.count()
            if arrived != sum(told.values()):
                raise ValueError(f"batch {number}: {arrived} applicants, but {told}")
            batch.sparkSession.createDataFrame(
                [(arrived, told["scored"], told["rejected"])], _COMMIT).coalesce(1).write.mode(
                "overwrite").parquet(f"{output}/commits/batch={number}")
        finally:
            rows.unpersist()

    return (applicants.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


_COMMIT = "arrived bigint, scored bigint, rejected bigint"


def read_commits(spark: SparkSession, output: str) -> DataFrame:
    """(batch, arrived, scored, rejected) of every committed batch."""
    return spark.read.schema(f"{_COMMIT}, batch bigint").parquet(f"{output}/commits")


def _committed(spark: SparkSession, output: str, name: str) -> DataFrame:
    done = read_commits(spark, output).select("batch")
    rows = spark.read.parquet(f"{output}/{name}").withColumn("batch", F.col("batch").cast("long"))
    return rows.join(done, "batch", "left_semi").select(*[
        column for column in rows.columns if column != "batch"], "batch")


def read_scored(spark: SparkSession, output: str) -> DataFrame:
    return _committed(spark, output, "scored")


def read_rejected(spark: SparkSession, output: str) -> DataFrame:
    return _committed(spark, output, "rejected")
