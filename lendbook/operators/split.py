"""Customer-grouped split and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendbook.functions.exprs import fraction
from lendbook.operators.prefix import running_totals

SEED = 20260922


def shuffle_key(group: str, seed: int = SEED) -> Column:
    """A fixed pseudo-random order of groups; it does not depend on how rows are laid out."""
    return F.xxhash64(F.lit(seed), F.col(group))


def arithmetic_key(group: str) -> Column:
    """The same idea in plain arithmetic, for whole-number keys and engines without the hash."""
    return (F.col(group) % 2147483648) * 2654435761 % 4294967296


def group_split(df: DataFrame, group: str = "customer_id", train_percent: int = 80,
                order: Column | None = None) -> DataFrame:
    """Add ``side``: whole groups go to 'train', in shuffled order, while the running number of
    rows stays within the share; the rest is 'test'.

    The running total is taken over one row per group, in ranges, so neither many groups nor a
    very large one ends up in a single task.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("rows")).withColumn(
        "_order", shuffle_key(group) if order is None else order)
    ordered = running_totals(sizes, ["_order", group], ["rows"])
    fits = F.col("cum_rows") * 100 <= F.col("total_rows") * train_percent
    sides = ordered.select(group, F.when(fits, "train").otherwise("test").alias("side"))
    return df.join(sides, group)


def split_check(df: DataFrame, group: str = "customer_id",
                label: str = "default_flag") -> DataFrame:
    """One row: groups found on both sides, and classes per side."""
    per_group = df.groupBy(group, "side").agg(
        F.count("*").alias("rows"), F.min(label).alias("low"), F.max(label).alias("high"))
    sides = per_group.groupBy(group).agg(
        F.count("*").alias("sides"),
        *[F.min(F.when(F.col("side") == s, F.col("low"))).alias(f"{s}_low")
          for s in ("train", "test")],
        *[F.max(F.when(F.col("side") == s, F.col("high"))).alias(f"{s}_high")
          for s in ("train", "test")])
    both = [((F.min(f"{s}_low") == 0) & (F.max(f"{s}_high") == 1)).cast("int")
            .alias(f"{s}_has_both_classes") for s in ("train", "test")]
    return sides.agg(F.count_if(F.col("sides") > 1).alias("overlap"), *both)


def assert_split(df: DataFrame) -> None:
    row = split_check(df).first()
    if row["overlap"] or not row["train_has_both_classes"] or not row["test_has_both_classes"]:
        raise ValueError(f"grouped split is invalid: {row.asDict()}")


def with_folds(df: DataFrame, folds: int = 5, group: str = "customer_id",
               order: Column | None = None) -> DataFrame:
    """Add ``fold`` (from 1), the same for all rows of a group; no shuffle."""
    key = shuffle_key(group) if order is None else order
    return df.withColumn("fold", (F.pmod(key, F.lit(folds)) + 1).cast("int"))


def _sizes(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(
        F.count("*").alias("rows"), F.count_distinct("customer_id").alias("customers"),
        F.count_if(F.col("default_flag") == 1).alias("defaults"),
        F.count_if(F.col("default_flag") == 0).alias("non_defaults"),
        fraction(F.count_if(F.col("default_flag") == 1), F.count("*")).alias("default_rate"))


def partition_report(df: DataFrame) -> DataFrame:
    return _sizes(df, "side")


def fold_report(df: DataFrame) -> DataFrame:
    return _sizes(df, "fold")


def fold_check(df: DataFrame) -> DataFrame:
    """One row: customers in more than one fold, and folds that lack a class."""
    spread = df.groupBy("customer_id").agg(
        F.min("fold").alias("first"), F.max("fold").alias("last")).agg(
        F.count_if(F.col("first") != F.col("last")).alias("violations")).select(
        F.lit("overlap").alias("check"), "violations")
    classes = _sizes(df, "fold").agg(
        F.count_if((F.col("defaults") == 0) | (F.col("non_defaults") == 0))
        .alias("violations")).select(F.lit("missing_class").alias("check"), "violations")
    return spread.unionAll(classes)


def assert_folds(df: DataFrame) -> None:
    failed = {row["check"]: row["violations"] for row in fold_check(df).collect()
              if row["violations"]}
    if failed:
        raise ValueError(f"folds are invalid: {failed}")
