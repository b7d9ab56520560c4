"""Tail probabilities as Column expressions; they run on one row per test."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 2000
WIDTH = 10.0


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) for a standard normal Z.

    Simpson's rule over the ten units past |z|; what lies beyond is below double precision.
    """
    width = WIDTH / STEPS
    start = F.abs(z)

    def add(total: Column, step: Column) -> Column:
        weight = (F.when((step == 0) | (step == STEPS), 1.0)
                  .when(step % 2 == 1, 4.0).otherwise(2.0))
        at = start + step * width
        return total + weight * F.exp(-at * at / 2)

    area = F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), add)
    return area * F.lit(2 * width / 3 / math.sqrt(2 * math.pi))


def chi_square_tail(statistic: Column, freedom: Column) -> Column:
    """P(X >= statistic) for X chi-square with a whole number of degrees of freedom.

    A finite sum: Poisson terms for even degrees; for odd ones the terms are half a step off
    and the normal tail is added.
    """
    half = statistic / 2
    odd = (freedom % 2).cast("double")
    is_odd = odd == 1
    terms = (freedom / 2).cast("int")
    tail = F.when(is_odd, normal_two_sided(F.sqrt(statistic))).otherwise(0.0)
    first = F.exp(-half) * F.when(
        is_odd, F.sqrt(half) * (2 / math.sqrt(math.pi))).otherwise(1.0)
    steps = F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(
        F.array().cast("array<int>"))
    return F.aggregate(
        steps, F.struct(tail.alias("tail"), first.alias("term")),
        lambda state, step: F.struct(
            (state["tail"] + state["term"]).alias("tail"),
            (state["term"] * half / (step + odd / 2)).alias("term")),
        lambda state: state["tail"])
