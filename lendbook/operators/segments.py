"""Default rates by segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendbook.functions.exprs import fraction, percent
from lendbook.operators.quantiles import unpivot


def _aggregates(count_name: str, unit: str, balance: bool, flag: str) -> list[Column]:
    known = F.count(flag)
    bad = F.count_if(F.col(flag) == 1)
    rate = percent(bad, known).alias("default_rate_pct") if unit == "pct" else \
        fraction(bad, known).alias("default_rate")
    columns = [F.count("*").alias(count_name), bad.alias("defaults"), rate]
    if balance:
        columns.append(F.sum("outstanding_balance").alias("outstanding_balance"))
    return columns


def segment_rates(df: DataFrame, by: str | Sequence[str], balance: bool = False,
                  unit: str = "pct", drop_null: bool = False,
                  count_name: str = "disbursed_loans", flag: str = "default_flag") -> DataFrame:
    """Loans, defaults and default rate per value of ``by`` (percent or fraction)."""
    keys = [by] if isinstance(by, str) else list(by)
    if drop_null:
        df = df.dropna(subset=keys)
    return df.groupBy(*keys).agg(*_aggregates(count_name, unit, balance, flag))


def segment_rates_many(df: DataFrame, columns: Sequence[str], balance: bool = False,
                       unit: str = "pct", drop_null: bool = False,
                       count_name: str = "disbursed_loans",
                       flag: str = "default_flag") -> DataFrame:
    """The same for many segmentations in one pass, as (variable, segment, ...)."""
    ids = [flag, "outstanding_balance"] if balance else [flag]
    long = unpivot(df, columns, ids, value="segment", as_type="string")
    return segment_rates(long, ["variable", "segment"], balance, unit,
                         drop_null=drop_null, count_name=count_name, flag=flag)
