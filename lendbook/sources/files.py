"""CSV, Parquet and text at the edges, with column and type checks."""

from __future__ import annotations

import warnings
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSV_OPTIONS = {"header": "true", "nullValue": "", "emptyValue": "", "dateFormat": "yyyy-MM-dd"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and a declared schema; an empty field is missing."""
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV with every field as text, for the type checks below."""
    return spark.read.options(**CSV_OPTIONS, inferSchema="false").csv(path)


#: Name of the column with a line that has too few or too many fields.
BROKEN_LINE = "_corrupt_record"


def checked_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header as text, one column per declared column, and ``reasons``.

    ``reasons`` names every field that does not parse as its declared type, or tells that the line
    does not have the declared number of fields; it is empty for a good row. A line is read
    whole for this, whatever columns are asked for.
    """
    text = T.StructType([T.StructField(name, T.StringType()) for name in schema.names]
                        + [T.StructField(BROKEN_LINE, T.StringType())])
    rows = spark.read.schema(text).options(
        **CSV_OPTIONS, mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN_LINE,
        columnPruning="false").csv(path)
    unparsed = [
        F.when(F.col(field.name).isNotNull()
               & F.col(field.name).try_cast(field.dataType).isNull(),
               F.lit(f"{field.name} is no {field.dataType.simpleString()}"))
        for field in schema if not isinstance(field.dataType, T.StringType)]
    broken = F.when(F.col(BROKEN_LINE).isNotNull(), F.lit(
        f"the line does not have {len(schema)} fields"))
    return rows.withColumn("reasons", F.coalesce(broken, F.concat_ws("; ", *unparsed)))


def read_csv_quarantined(spark: SparkSession, path: str, schema: T.StructType,
                         place: str) -> tuple[DataFrame, DataFrame]:
    """The good rows of a CSV in their declared types, and the rejected ones with the reasons.

    The file is parsed once; what comes of it is written below ``place``, where the reject table
    stays: ``record`` is the line, or its fields by name, and ``reasons`` says why. No value
    is ever lost by turning it into a missing one. ``quality.with_rejects`` shows the count to
    the gate.
    """
    bad = F.col("reasons") != ""
    checked_csv(spark, path, schema).withColumn("rejected", bad).write.mode(
        "overwrite").partitionBy("rejected").parquet(f"{place}/lines")
    text = T.StructType([T.StructField(name, T.StringType())
                         for name in [*schema.names, BROKEN_LINE, "reasons"]]
                        + [T.StructField("rejected", T.BooleanType())])
    rows = spark.read.schema(text).parquet(f"{place}/lines")
    record = F.coalesce(F.col(BROKEN_LINE), F.to_json(F.struct(*schema.names)))
    rows.where("rejected").select(record.alias("record"), "reasons").write.mode(
        "overwrite").parquet(f"{place}/rejects")
    good = cast_columns(rows.where("NOT rejected"), schema)
    return good, spark.read.schema("record string, reasons string").parquet(f"{place}/rejects")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV directory with a header per part, no row names, missing values empty."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def write_lines(df: DataFrame, path: str, line: str = "line") -> None:
    df.select(line).write.mode("overwrite").text(path)


class MissingColumnsError(ValueError):
    """Raised when a source lacks required columns."""


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Fail on missing columns, warn about unexpected ones, which are kept."""
    required = list(required)
    missing = [name for name in required if name not in df.columns]
    extra = [name for name in df.columns if name not in required]
    if missing:
        raise MissingColumnsError(f"required columns are missing: {', '.join(missing)}")
    if extra:
        warnings.warn(f"unexpected columns kept: {', '.join(extra)}", stacklevel=2)
    return df


def column_report(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """(column, present, filled) for the required columns."""
    required = list(required)
    counted = df.agg(*[
        (F.count(name) if name in df.columns else F.lit(0).cast("bigint")).alias(name)
        for name in required])
    return counted.unpivot([], required, "column", "filled").withColumn(
        "present", F.col("column").isin(df.columns).cast("int"))


def cast_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns in their declared types; text that does not parse becomes missing."""
    return df.select(*[
        F.col(field.name).try_cast(field.dataType).alias(field.name) for field in schema])


def cast_report(df: DataFrame, schema: T.StructType) -> DataFrame:
    """(column, missing, failed): absent values, and values that do not parse."""
    names = schema.names
    counted = df.agg(*[
        F.struct(
            F.count_if(F.col(field.name).isNull()).alias("missing"),
            F.count_if(F.col(field.name).isNotNull()
                       & F.col(field.name).try_cast(field.dataType).isNull())
            .alias("failed")).alias(field.name)
        for field in schema])
    return counted.unpivot([], names, "column", "counts").select(
        "column", "counts.missing", "counts.failed")


class MissingArtifactsError(FileNotFoundError):
    """Raised when inputs of a stage are absent."""


def require_artifacts(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """Refuse to start while inputs are absent, and name every one of them."""
    paths = list(paths)
    missing = []
    for path in paths:
        try:
            spark.read.format("binaryFile").load(path).schema
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            missing.append(path)
    if missing:
        raise MissingArtifactsError(f"inputs are missing: {', '.join(missing)}")
    return paths
