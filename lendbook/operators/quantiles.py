"""Exact interpolated quantiles of many columns at once."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor, inf as INF

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendbook.functions.exprs import not_nan
from lendbook.operators.prefix import running_totals


def unpivot(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = (),
            variable: str = "variable", value: str = "value",
            as_type: str = "double") -> DataFrame:
    """One row per (row, column): the column's name and its value."""
    typed = df.select(*ids, *[F.col(name).cast(as_type).alias(name) for name in columns])
    return typed.unpivot(list(ids), list(columns), variable, value)


def exact_quantiles(long: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Quantiles of ``value`` per ``variable``, interpolated between neighbours.

    ``percentile`` keeps every distinct value of a group in one buffer. Here equal values are
    counted first, and the two neighbours of each quantile are found by running counts, so
    continuous measures of any size stay spread over the cluster. Returns one row per variable
    with a column per entry of ``probs``.
    """
    counted = (
        long.withColumn("value", not_nan(F.col("value"))).where(F.col("value").isNotNull())
        .groupBy("variable", "value").agg(F.count("*").alias("rows"))
    )
    ranked = running_totals(counted, ["value"], ["rows"], ["variable"])
    first = F.col("cum_rows") - F.col("rows")

    def value_at(position: Column) -> Column:
        return F.max(F.when((first <= position) & (position < F.col("cum_rows")),
                            F.col("value")))

    aggregates = [F.max("total_rows").alias("_n")]
    for name, prob in probs.items():
        place = (F.col("total_rows") - 1) * F.lit(float(prob))
        low = F.floor(place)
        aggregates += [value_at(low).alias(f"_low_{name}"),
                       value_at(F.ceil(place)).alias(f"_high_{name}")]
    found = ranked.groupBy("variable").agg(*aggregates)

    def interpolated(name: str, prob: float) -> Column:
        place = (F.col("_n") - 1) * F.lit(float(prob))
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        return (low + (high - low) * (place - F.floor(place))).alias(name)

    return found.select("variable", *[interpolated(n, p) for n, p in probs.items()])


#: Values of a bracket that are fetched once it is this narrow.
FETCHED = 20_000
#: Steps of the grid that a pass lays over every bracket; its error is a small part of a step.
STEPS = 128


def wide_quantiles(df: DataFrame, columns: Sequence[str], probs: dict[str, float],
                   fetched: int = FETCHED, steps: int = STEPS) -> DataFrame:
    """The same quantiles of whole columns, by selection: no sort and no row per value.

    Every wanted rank has an open bracket of values it lies in, at first all. A pass over the table
    counts, for all columns and brackets at once, the values up to either end and takes a rough
    grid of quantiles inside. The counts are exact: they tell whether the rank's value is an end
    of the bracket, and between which steps of the grid it lies, which is the next bracket. A
    pass narrows a bracket to a few steps, so their number grows with the logarithm of the rows.
    Brackets with at most ``fetched`` values are read off by counting those values. What is
    shuffled is a row of counts and grids a task, then the values of the last brackets.
    Columns without values give no row.
    """
    values = df.select(*[not_nan(F.col(name).cast("double")).alias(name) for name in columns])
    counts = values.agg(*[F.count(name).alias(name) for name in columns]).first().asDict()
    ranks = {}
    for name in (name for name in columns if counts[name]):
        places = [(counts[name] - 1) * float(prob) for prob in probs.values()]
        ranks |= {(name, rank): None for place in places for rank in (floor(place), ceil(place))}
    brackets = dict.fromkeys(ranks, (-INF, INF))
    small: dict[tuple[str, float, float], int] = {}
    while open_ := [key for key in ranks if ranks[key] is None
                    and (key[0], *brackets[key]) not in small]:
        asked = list(dict.fromkeys((name, *brackets[name, rank]) for name, rank in open_))
        told = dict(zip(asked, values.agg(*[
            _inside(*bracket, steps).alias(str(place))
            for place, bracket in enumerate(asked)]).first()))
        for name, rank in open_:
            low, high = brackets[name, rank]
            seen = told[name, low, high]
            if rank < seen["below"] or rank >= seen["to_high"]:     # the grid was too rough
                brackets[name, rank] = (-INF, low) if rank < seen["below"] else (high, INF)
            elif rank < seen["to_low"]:
                ranks[name, rank] = low
            elif rank >= seen["to_low"] + seen["inside"]:
                ranks[name, rank] = high
            elif seen["inside"] <= fetched:
                small[name, low, high] = seen["to_low"]
            else:
                grid = [low, *seen["grid"], high]
                step = int((rank - seen["to_low"]) * steps / seen["inside"])
                brackets[name, rank] = (grid[max(0, step - 1)], grid[min(steps, step + 2)])
    _fetch(values, small, brackets, ranks)

    def quantile(name: str, prob: float) -> float:
        place = (counts[name] - 1) * float(prob)
        low, high = ranks[name, floor(place)], ranks[name, ceil(place)]
        return low if low == high else low + (high - low) * (place - floor(place))

    rows = [(name, *[quantile(name, prob) for prob in probs.values()])
            for name in columns if counts[name]]
    return df.sparkSession.createDataFrame(rows, ", ".join(
        ["variable string", *[f"`{name}` double" for name in probs]]))


def _inside(name: str, low: float, high: float, steps: int) -> Column:
    value = F.col(name)
    within = (value > low) & (value < high)
    grid = F.percentile_approx(F.when(within, value), F.array(*[
        F.lit(place / steps) for place in range(1, steps)]), F.lit(20 * steps))
    return F.struct(
        F.count_if(value < low).alias("below"), F.count_if(value <= low).alias("to_low"),
        F.count_if(within).alias("inside"), F.count_if(value <= high).alias("to_high"),
        grid.alias("grid"))


def _fetch(values: DataFrame, small: dict[tuple[str, float, float], int],
           brackets: dict[tuple[str, int], tuple[float, float]],
           ranks: dict[tuple[str, int], float | None]) -> None:
    """Set the ranks that lie in narrow brackets, whose values are counted one by one."""
    if not small:
        return
    numbers = {bracket: place for place, bracket in enumerate(small)}
    held = F.filter(F.array(*[
        F.when((F.col(name) > low) & (F.col(name) < high),
               F.struct(F.lit(place).alias("bracket"), F.col(name).alias("value")))
        for (name, low, high), place in numbers.items()]), lambda one: one.isNotNull())
    counted: dict[int, list[tuple[float, int]]] = {}
    for row in values.select(F.explode(held).alias("v")).groupBy("v.bracket", "v.value").agg(
            F.count("*").alias("rows")).collect():
        counted.setdefault(row["bracket"], []).append((row["value"], row["rows"]))
    for (name, rank), found in list(ranks.items()):
        bracket = (name, *brackets[name, rank])
        if found is None:
            before = small[bracket]
            for value, rows in sorted(counted[numbers[bracket]]):
                before += rows
                if rank < before:
                    ranks[name, rank] = value
                    break


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Median of each column as a plain number; fails when a column has no values."""
    rows = wide_quantiles(df, columns, {"median": 0.5}).collect()
    medians = {row["variable"]: row["median"] for row in rows}
    empty = [name for name in columns if medians.get(name) is None]
    if empty:
        raise ValueError(f"no finite median for: {', '.join(empty)}")
    return medians
