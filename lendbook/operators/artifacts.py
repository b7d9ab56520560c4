"""One versioned artefact of training: model, medians, split and folds, with a manifest.

A version is a folder of its own. Its manifest, counts and digests of every part, is written last,
so a version without one is not there for readers. They check the parts against it, and what was
fitted together is loaded together.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendbook import schemas as S
from lendbook.operators import model as M

SPLIT_COLUMNS = [*S.ID_COLUMNS, S.LABEL, "side", "fold"]
_MANIFEST = "part string, `rows` bigint, digest string"


class ArtifactError(ValueError):
    """Raised when no whole version is there, or a part is not what its manifest says."""


@dataclass(frozen=True)
class Artifact:
    """The parts of one version. ``split`` has ids, label, side and fold of the training set."""

    version: str
    model: PipelineModel
    medians: dict[str, float]
    split: DataFrame
    manifest: DataFrame


def _of_rows(df: DataFrame) -> tuple[int, str]:
    """Number of rows, and a digest that does not depend on their order."""
    code = F.xxhash64(*[F.col(name).cast("string") for name in sorted(df.columns)])
    row = df.agg(F.count("*").alias("n"), F.sum(code.cast("decimal(38,0)")).alias("sum"),
                 F.bit_xor(code).alias("xor")).first()
    return row["n"], f"{row['sum'] or 0}:{row['xor'] or 0}"


def _of_model(spark: SparkSession, model: PipelineModel) -> tuple[int, str]:
    """Number of features, and a digest of their names and of what was fitted."""
    names = M.feature_names(model)
    fit = model.stages[-1]
    if isinstance(fit, LogisticRegressionModel):
        fitted = [float(fit.intercept), *map(float, fit.coefficients.toArray())]
    else:       # every cut and every leaf
        fitted = fit.digest()
    row = spark.range(1).select(F.sha2(F.lit(repr((names, fitted))), 256)).first()
    return len(names), row[0]


def _digests(spark: SparkSession, model: PipelineModel, medians: DataFrame,
             split: DataFrame) -> dict[str, tuple[int, str]]:
    return {"model": _of_model(spark, model), "medians": _of_rows(medians),
            "split": _of_rows(split),
            "train": _of_rows(split.where("side = 'train'"))}


def save(place: str, model: PipelineModel, medians: dict[str, float],
         split: DataFrame) -> Artifact:
    """Write a new version below ``place`` and load it. Versions are ordered by name."""
    spark = split.sparkSession
    latest = versions(spark, place)
    number = 1 + max((int(name[1:7]) for name in latest), default=0)
    version = f"v{number:06d}-{uuid.uuid4().hex[:8]}"
    folder = f"{place}/{version}"
    M.save(model, f"{folder}/model")
    spark.createDataFrame(sorted(medians.items()), "variable string, median double").coalesce(
        1).write.parquet(f"{folder}/medians")
    split.select(*SPLIT_COLUMNS).write.parquet(f"{folder}/split")
    parts = _digests(spark, M.load(f"{folder}/model"),
                     spark.read.parquet(f"{folder}/medians"),
                     spark.read.parquet(f"{folder}/split"))
    spark.createDataFrame([(name, *told) for name, told in parts.items()], _MANIFEST).coalesce(
        1).write.parquet(f"{folder}/manifest")
    return load(spark, place, version)


def versions(spark: SparkSession, place: str) -> list[str]:
    """Names of the whole versions, oldest first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(
        f"{place}/v*/manifest/_SUCCESS")) or []
    names = [re.search(r"/(v\d{6}-[0-9a-f]{8})/manifest/", str(one.getPath())) for one in found]
    return sorted(name[1] for name in names if name)


def load(spark: SparkSession, place: str, version: str | None = None) -> Artifact:
    """A version, by default the newest whole one, once its parts agree with its manifest."""
    whole = versions(spark, place)
    if not whole or version is not None and version not in whole:
        raise ArtifactError(f"no whole version {version or ''} below {place}")
    version = version or whole[-1]
    folder = f"{place}/{version}"
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    told = {row["part"]: (row["rows"], row["digest"]) for row in manifest.collect()}
    model = M.load(f"{folder}/model")
    medians, split = (spark.read.parquet(f"{folder}/{name}") for name in ("medians", "split"))
    found = _digests(spark, model, medians, split)
    wrong = sorted(name for name in found.keys() | told.keys()
                   if found.get(name) != told.get(name))
    if wrong:
        raise ArtifactError(f"{folder} is not what its manifest says: {', '.join(wrong)}")
    values = {row["variable"]: row["median"] for row in medians.collect()}
    return Artifact(version, model, values, split, manifest)
