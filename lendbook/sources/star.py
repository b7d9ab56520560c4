"""The five-entity star and its layout on disk."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendbook import schemas as S
from lendbook.session import remove_work, work_folder
from lendbook.sources.driver_tables import credit_applications

#: Applications of a bucket; they and their lines are grouped and sorted in a task's memory.
ROWS_PER_BUCKET = 500_000
MAX_BUCKETS = 50_000


def customers(flat: DataFrame) -> DataFrame:
    return flat.select("customer_id").distinct()


def applications(flat: DataFrame) -> DataFrame:
    return flat.select(*S.ENTITY_COLUMNS["applications"])


def assessments(flat: DataFrame) -> DataFrame:
    return flat.select(*S.ENTITY_COLUMNS["assessments"])


def decisions(flat: DataFrame) -> DataFrame:
    return flat.select(*S.ENTITY_COLUMNS["decisions"])


def performance(flat: DataFrame) -> DataFrame:
    return flat.select(*S.ENTITY_COLUMNS["performance"])


@dataclass(frozen=True)
class Portfolio:
    """The entities of one portfolio.

    ``flat`` is set when all entities come from one application record. The entities are then
    one-to-one by construction and joining them back is a projection of that record; without
    it they are joined on the application key.
    """

    customers: DataFrame
    applications: DataFrame
    assessments: DataFrame
    decisions: DataFrame
    performance: DataFrame
    flat: DataFrame | None = None

    @staticmethod
    def of_flat(flat: DataFrame) -> "Portfolio":
        return Portfolio(customers(flat), applications(flat), assessments(flat),
                         decisions(flat), performance(flat), flat)

    def as_star(self) -> "Portfolio":
        """The same entities with every join carried out."""
        return Portfolio(self.customers, self.applications, self.assessments, self.decisions,
                         self.performance)

    def joined(self, *entities: str) -> DataFrame:
        """Inner join of entities on the application key.

        Only the entities a question needs are named, because a join that merely confirms a
        key exists cannot be dropped by the optimizer.
        """
        if self.flat is not None:
            columns = list(dict.fromkeys(
                name for entity in entities for name in S.ENTITY_COLUMNS[entity]))
            return self.flat.select(*columns)
        return reduce(lambda left, right: left.join(right, "application_id"),
                      [getattr(self, entity) for entity in entities])


    def record(self) -> DataFrame:
        """The 30-column application record. From separate tables, an application that is missing
        in one of them, or whose customer is, is not in it; the gate counts rows."""
        if self.flat is not None:
            return self.flat
        whole = self.joined("applications", "assessments", "decisions", "performance")
        return whole.join(self.customers.select("customer_id"), "customer_id", "left_semi").select(
            *S.FLAT_COLUMNS)


def bucket_count(spark: SparkSession, rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Enough buckets to use the cluster and to keep each one's rows in memory."""
    cores = spark.sparkContext.defaultParallelism
    rounds = max(1, math.ceil(rows / rows_per_bucket / cores))     # of tasks, all cores in each
    return min(MAX_BUCKETS, rounds * cores)


def publish(flat: DataFrame, table: str, location: str, buckets: int,
            dealt: bool = False) -> DataFrame:
    """Write the application record bucketed by its key and read it back.

    Entities projected from the bucketed table join on the key without a shuffle. Rows are
    clustered by status inside a bucket, so filters on status skip row groups. Rows that are
    ``dealt`` by the key into as many partitions are not shuffled again.
    """
    spark = flat.sparkSession
    (
        (flat if dealt else flat.repartition(buckets, "application_id"))
        .write.mode("overwrite").format("parquet").option("path", location)
        .bucketBy(buckets, "application_id").sortBy("application_status")
        .saveAsTable(table)
    )
    return spark.table(table)


_PUBLISHED: dict[tuple[str, str], str] = {}


def load_portfolio(spark: SparkSession, sf_dir: str, refresh: bool = False) -> Portfolio:
    """The portfolio behind a directory of driver tables, derived once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if refresh or key not in _PUBLISHED:
        name = hashlib.sha256("|".join(key).encode()).hexdigest()[:16]
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
        table = f"lendbook_{name}"
        buckets = bucket_count(spark, orders)
        publish(credit_applications(spark, sf_dir, buckets), table,
                f"{work_folder(spark)}/{table}", buckets, dealt=True)
        _PUBLISHED[key] = table
    return Portfolio.of_flat(spark.table(_PUBLISHED[key]))


def cleanup(spark: SparkSession) -> None:
    """Drop the application's published tables and delete its work folder."""
    application = spark.sparkContext.applicationId
    for key in [key for key in _PUBLISHED if key[0] == application]:
        spark.sql(f"DROP TABLE IF EXISTS {_PUBLISHED.pop(key)}")
    remove_work(spark)


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for consumers without a fixed-point type."""
    return df.select(*[
        F.col(field.name).cast("double").alias(field.name)
        if field.dataType.typeName() == "decimal" else F.col(field.name)
        for field in df.schema])
