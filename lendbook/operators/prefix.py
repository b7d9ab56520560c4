"""Running totals over a global order without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence
from math import inf, nextafter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a range, and how many ranges there are at most.
ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 5_000


def running_totals(df: DataFrame, order_by: Sequence[str], sums: Sequence[str],
                   group_by: Sequence[str] = ()) -> DataFrame:
    """Add ``cum_x`` (inclusive) and ``total_x`` for every column in ``sums``.

    The order, ascending with missing values first, is cut into ranges at explicit limits, which one
    small aggregate reads off the first column (see ``ranged``). Rows are then shuffled once, by
    range and group, summed inside each range, and shifted by the sums of the ranges before it: a
    table with one row per range and group, summed before it is shuffled. A range is a
    function of the row alone, so work that is done again after a loss falls into the same ranges.

    ``order_by`` should be unique within a group, or already aggregated, so that equal keys need
    no order among themselves; a hot group is spread over as many ranges as its rows fill, and a
    hot value of the first column over ranges of the second.
    """
    group_by, order_by = list(group_by), list(order_by)
    rows = ranged(df, order_by)
    keys = ["_range", "_part", *group_by]
    within = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    summed = rows.select("*", *[F.sum(name).over(within).alias(f"_in_{name}") for name in sums])
    per_range = rows.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in sums])
    group = Window.partitionBy(*group_by)
    before = group.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_range.select(
        *keys,
        *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_before_{name}")
          for name in sums],
        *[F.sum(name).over(group).alias(f"total_{name}") for name in sums])
    return summed.join(shifts, keys).select(
        *df.columns,
        *[(F.col(f"_in_{name}") + F.col(f"_before_{name}")).alias(f"cum_{name}")
          for name in sums],
        *[F.col(f"total_{name}") for name in sums])


def images(df: DataFrame, names: Sequence[str]) -> list[tuple[Column, float]]:
    """Numbers that together never fall along the ascending order of the columns, nulls first.

    With each comes the size below which rows with an equal number are equal in what it stands
    for, so that the next number may tell them apart.
    """
    found = []
    for name in names:
        column, kind = F.col(name), df.schema[name].dataType
        value, exact = column.cast("double"), inf
        if isinstance(kind, T.StringType):
            code = column.cast("binary")
            for start in (1, 7):
                part = F.rpad(F.hex(F.substring(code, start, 6)), 12, "0")
                found.append((F.conv(part, 16, 10).cast("double"), inf))
            found[-1] = (found[-1][0], 0.0)
            continue
        if isinstance(kind, T.DateType):
            value = F.unix_date(column).cast("double")
        elif isinstance(kind, T.TimestampType):
            value, exact = F.unix_micros(column).cast("double"), 2.0 ** 53
        elif isinstance(kind, T.LongType):
            exact = 2.0 ** 53
        elif isinstance(kind, T.DecimalType):
            exact = inf if kind.precision <= 15 else 0.0
        found.append((F.when(F.isnan(value), F.lit(inf)).otherwise(value), exact))
    lowest = F.lit(-inf)
    return [(F.coalesce(value, lowest), exact) for value, exact in found]


def _cut(df: DataFrame, value: str, into: str, limits: Sequence[float]) -> DataFrame:
    """``into``: the number of limits, explicit values, that are not above ``value``."""
    inner = sorted({float(limit) for limit in limits} - {inf, -inf})
    edges = [-inf, *inner, inf]
    return Bucketizer(splits=edges, inputCol=value, outputCol=into).transform(df) if inner else (
        df.withColumn(into, F.lit(0.0)))


def _limits(rows: DataFrame, value: str) -> list[float]:
    """Approximate quantiles that cut ``value`` into ranges for all cores and of bounded size."""
    def steps(count: int) -> Column:
        places = F.array(*[F.lit(place / count) for place in range(1, count)])
        return F.percentile_approx(value, places, F.lit(20 * count))

    cores = rows.sparkSession.sparkContext.defaultParallelism
    told = rows.agg(F.count(F.lit(1)).alias("n"), steps(cores + 1).alias("limits")).first()
    if told["n"] <= ROWS_PER_RANGE * (cores + 1):
        return told["limits"] or []
    step = max(1, MAX_RANGES * ROWS_PER_RANGE // told["n"])
    return rows.agg(steps(MAX_RANGES)).first()[0][::step]


def ranged(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Add ``_range`` and ``_part``, numbers that rise along the order and part it evenly.

    Limits are approximate quantiles of the order's first number. Where one value fills several
    ranges, it gets a range of its own, and quantiles of the next number cut that into parts.
    """
    first, *more = images(df, order_by)
    marked = df.withColumn("_image", first[0])
    limits = _limits(marked, "_image")
    hot = sorted({limit for limit in limits if limits.count(limit) > 1
                  and abs(limit) < first[1]})
    rows = _cut(marked, "_image", "_range", [*limits, *[nextafter(limit, inf) for limit in hot]])
    if not more or not hot:
        return rows.withColumn("_part", F.lit(0.0)).drop("_image")
    among = F.col("_image").isin(hot)
    rows = rows.withColumn("_next", F.when(among, more[0][0]).otherwise(F.lit(-inf)))
    return _cut(rows, "_next", "_part", _limits(rows.where(among), "_next")).drop(
        "_image", "_next")


def tile(position: Column, rows: Column, tiles: int) -> Column:
    """Tile number of a row at ``position`` (from 1) among ``rows``; larger tiles come first."""
    size = F.call_function("div", rows, F.lit(tiles))
    larger = rows % tiles
    in_larger = larger * (size + 1)
    late = larger + F.call_function("div", position - in_larger - 1,
                                    F.greatest(size, F.lit(1))) + 1
    early = F.call_function("div", position - 1, size + 1) + 1
    return F.when(position <= in_larger, early).otherwise(late).cast("int")
