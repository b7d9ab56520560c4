"""Helpers the operators share: table access, worker-side caches, ranking without one task."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lendbook.session import work_folder

#: Names of the columns of ``documents``; pipeline stages give back these and no others.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Rows and bytes of an Arrow batch, so that a batch of very long texts stays bounded.
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; also the place where the session's Arrow batches are bounded."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    for key, value in BATCH_SETTINGS.items():
        spark.conf.set(key, value)


def kept_in_worker(key: str, make: Callable[[], Any]) -> Any:
    """An object built once for the life of a Python worker process.

    Functions sent by value get fresh globals with every task; vocabularies and lazily built
    automata are worth keeping between tasks of one worker.
    """
    shelf = sys.modules.setdefault("_lendbook_worker_shelf",
                                   types.ModuleType("_lendbook_worker_shelf"))
    if not hasattr(shelf, key):
        setattr(shelf, key, make())
    return getattr(shelf, key)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as written to a table in the shared work folder.

    A table rather than a checkpoint: what the optimizer knows of a checkpoint's columns grows
    with every renaming in a loop, until the driver cannot hold it. Tables stay under
    ``spark.checkpoint.dir`` in the folder of the application.
    """
    place = f"{work_folder(df.sparkSession)}/llm/{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def positions(df: DataFrame, order_by: Column, group_by: Sequence[str] = (),
              rows_per_bin: int = 100_000, rows: int | None = None) -> DataFrame:
    """Add ``position``: gapless from 0 within each group.

    Rows are dealt into bins by a hash of ``order_by``; bins are counted, the counts are summed
    into offsets (a table of groups times bins) and rows are numbered inside their bin. No task
    holds more than a bin, however large a group is. ``order_by`` is also the order in a bin.
    """
    group_by = list(group_by)
    rows = df.count() if rows is None else rows
    bins = max(8, -(-rows // rows_per_bin))
    binned = df.withColumn("_bin", F.pmod(F.xxhash64(F.lit("bin"), order_by), F.lit(bins)))
    keys = [*group_by, "_bin"]
    counts = binned.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group_by).orderBy("_bin").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order_by))
    return (
        binned.withColumn("_number", number)
        .join(offsets, keys)
        .withColumn("position", (F.col("_number") - 1 + F.col("_before")).cast("long"))
        .drop("_bin", "_number", "_before")
    )
