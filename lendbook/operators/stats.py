"""Exploratory statistics of the modelling set."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendbook import schemas as S
from lendbook.functions.bands import PORTFOLIO
from lendbook.functions.exprs import count_where, div, fraction, month_label
from lendbook.functions.pvalues import chi_square_tail, normal_two_sided
from lendbook.operators.prefix import running_totals
from lendbook.operators.quantiles import unpivot, wide_quantiles
from lendbook.operators.segments import segment_rates_many
from lendbook.plans import views as V


def numeric_summary(table: DataFrame,
                    columns: Sequence[str] = tuple(S.PROFILED_COLUMNS)) -> DataFrame:
    """Count, mean, median, deviation, extremes and quartiles per numeric column."""
    measures = {
        "count": F.count, "mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max}
    wide = table.agg(*[
        F.struct(*[measure(F.col(column).cast("double")).alias(name)
                   for name, measure in measures.items()]).alias(column) for column in columns])
    moments = wide.select(F.explode(F.array(*[
        F.struct(F.lit(column).alias("variable"), F.col(column).alias("m"))
        for column in columns])).alias("row")).select("row.variable", "row.m.*")
    quantiles = wide_quantiles(table, columns, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    # One row per column on either side.
    return moments.join(quantiles, "variable").select(
        "variable", "count", "mean", "median", "sd", "min", "p25", "p75", "max")


SEGMENT_VARIABLES = ["bureau_band", "dti_band", "age_band", "has_previous_default",
                     "business_type", "loan_purpose", "lr_band", "amt_band"]


def with_eda_bands(table: DataFrame) -> DataFrame:
    """Bands over the modelling columns; the bureau band uses the imputed score."""
    source = {
        "bureau_band": ("bureau_score_band", "bureau_score_imputed"),
        "dti_band": ("dti_band", "debt_to_income_ratio"),
        "age_band": ("business_age_band", "business_age_years"),
        "lr_band": ("loan_to_revenue_band", "loan_to_annual_revenue_ratio"),
        "amt_band": ("requested_loan_amount_band", "requested_loan_amount"),
    }
    return table.withColumns({
        name: F.when(F.col(column).isNotNull(), PORTFOLIO[preset].of(F.col(column)))
        for name, (preset, column) in source.items()}).withColumn(
        "has_previous_default", F.col("has_previous_default").cast("int"))


def default_rate_tables(table: DataFrame) -> DataFrame:
    """(variable, segment, loans, defaults, default_rate) for eight segmentations."""
    return segment_rates_many(with_eda_bands(table), SEGMENT_VARIABLES, unit="fraction",
                              count_name="loans")


# The columns of the correlation matrix and of the two tests.
CORRELATED = ["bureau_score_imputed", "debt_to_income_ratio", "business_age_years",
              "loan_to_annual_revenue_ratio", "collateral_coverage_ratio",
              "monthly_debt_to_revenue_ratio"]
CHI_SQUARE_VARIABLES = ["business_type", "loan_purpose", "has_previous_default"]
RANK_SUM_VARIABLES = ["bureau_score_imputed", "debt_to_income_ratio", "business_age_years",
                      "loan_to_annual_revenue_ratio"]


def correlation(table: DataFrame, columns: Sequence[str] = tuple(CORRELATED)) -> DataFrame:
    """Pearson matrix in long form; a row counts for a pair when both values are present."""
    pairs = list(combinations_with_replacement(columns, 2))
    one_row = table.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = []
    for a, b in pairs:
        for left, right in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(left).alias("var1"), F.lit(right).alias("var2"),
                                  F.col(f"`{a}|{b}`").alias("correlation")))
    return one_row.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def monthly_rates(flat: DataFrame) -> DataFrame:
    return flat.groupBy(month_label(F.col("application_date")).alias("month")).agg(
        F.count("*").alias("applications"),
        fraction(count_where(V.granted()), F.count("*")).alias("approval"),
        fraction(count_where(V.disbursed()), F.count("*")).alias("disbursed"))


def category_counts(flat: DataFrame) -> DataFrame:
    fields = ["application_status", "business_type", "loan_purpose"]
    return (unpivot(flat, fields, variable="field", value="category", as_type="string")
            .groupBy("field", "category").agg(F.count("*").alias("count")))


def histogram(flat: DataFrame, columns: Sequence[str] = ("requested_loan_amount",
                                                         "approved_amount"),
              bins: int = 40) -> DataFrame:
    """Equal-width counts of money columns, empty bins kept, the maximum in the last bin."""
    long = unpivot(flat, columns, variable="field", as_type="decimal(18,2)").where(
        "value IS NOT NULL")
    limits = long.groupBy("field").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    reach = F.col("high") - F.col("low")
    bin_of = F.when(reach == 0, 1).otherwise(F.least(
        F.lit(bins), div((F.col("value") - F.col("low")) * bins, reach) + 1)).cast("int")
    counts = (
        long.join(F.broadcast(limits), "field")  # one row per column
        .groupBy("field", bin_of.alias("bin")).agg(F.count("*").alias("count"))
    )
    every = limits.select("*", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    start = F.col("low") + div(reach * 100 * (F.col("bin") - 1), F.lit(bins)).cast(
        "decimal(20,0)") / F.lit(100)
    return every.join(counts, ["field", "bin"], "left").select(
        "field", "bin", start.cast("decimal(18,2)").alias("lower"),
        F.coalesce("count", F.lit(0)).alias("count"))


def chi_square(table: DataFrame, columns: Sequence[str] = tuple(CHI_SQUARE_VARIABLES),
               label: str = S.LABEL, yates: bool = True) -> DataFrame:
    """Independence of nominal columns and the label, from the contingency counts.

    With ``yates`` a two-by-two table gets the continuity correction.
    """
    cells = (
        unpivot(table, columns, [label], value="category", as_type="string")
        .where("category IS NOT NULL").groupBy("variable", "category")
        .agg(F.count_if(F.col(label) == 0).alias("good"),
             F.count_if(F.col(label) == 1).alias("bad"))
    )
    test = Window.partitionBy("variable")  # one row per category by now
    whole = F.sum(F.col("good") + F.col("bad")).over(test)
    margins = cells.select(
        "*", whole.alias("n"), F.count("*").over(test).alias("categories"),
        F.sum("good").over(test).alias("all_good"), F.sum("bad").over(test).alias("all_bad"))
    size = (F.col("good") + F.col("bad")).cast("double")
    correct = (F.col("categories") == 2) & F.lit(yates)

    def part(observed: str, margin: str):
        expected = size * F.col(margin) / F.col("n")
        gap = F.abs(F.col(observed) - expected)
        kept = F.when(correct, gap - F.least(gap, F.lit(0.5))).otherwise(gap)
        return F.try_divide(kept * kept, expected)

    tests = margins.groupBy("variable").agg(
        F.sum(part("good", "all_good") + part("bad", "all_bad")).alias("statistic"),
        (F.max("categories") - 1).alias("freedom"), F.max("n").alias("n"))
    return tests.withColumn("p_value", chi_square_tail(F.col("statistic"), F.col("freedom")))


def rank_sum(table: DataFrame, columns: Sequence[str] = tuple(RANK_SUM_VARIABLES),
             label: str = S.LABEL) -> DataFrame:
    """Rank-sum statistic of class 0 against class 1 with the normal approximation.

    Ties share the middle rank and shrink the variance; the continuity correction is one half.
    Rows are first counted per distinct value, so ranks come from running counts.
    """
    counts = (
        unpivot(table, columns, [label]).where("value IS NOT NULL")
        .groupBy("variable", "value")
        .agg(F.count("*").alias("rows"),
             F.count_if(F.col(label) == 0).alias("good"))
    )
    ranked = running_totals(counts, ["value"], ["rows", "good"], ["variable"])
    exact = "decimal(38,0)"
    rows = F.col("rows").cast("decimal(19,0)")
    twice_rank = (F.col("cum_rows") * 2 - F.col("rows") + 1).cast("decimal(19,0)")
    sums = ranked.groupBy("variable").agg(
        F.sum((F.col("good").cast("decimal(18,0)") * twice_rank).cast(exact)).alias("twice_sum"),
        F.sum((rows.cast("double") * rows * rows - rows)).alias("ties"),
        F.max("total_rows").alias("n"), F.max("total_good").alias("n0"))
    n, n0 = F.col("n").cast("double"), F.col("n0").cast("double")
    n1 = n - n0
    statistic = F.col("twice_sum").cast("double") / 2 - n0 * (n0 + 1) / 2
    middle = statistic - n0 * n1 / 2
    variance = n0 * n1 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1)))
    z = F.try_divide(middle - F.signum(middle) * 0.5, F.sqrt(variance))
    return sums.select(
        "variable", statistic.alias("statistic"), z.alias("z"), "n"
    ).withColumn("p_value", normal_two_sided(F.col("z")))


def statistical_tests(table: DataFrame) -> DataFrame:
    """Both families of tests in one table."""
    chi = chi_square(table).select(
        F.lit("Chi-square").alias("test"), "variable", "statistic", "p_value", "n")
    ranks = rank_sum(table).select(
        F.lit("Wilcoxon").alias("test"), "variable", "statistic", "p_value", "n")
    return chi.unionByName(ranks)


def findings(table: DataFrame) -> DataFrame:
    """Sentences built from the computed rates, as (position, line)."""
    rates = default_rate_tables(table)
    rate = F.col("default_rate") * 100

    def pick(variable: str, segment: str | None = None):
        at = F.col("variable") == variable
        return F.when(at if segment is None else at & (F.col("segment") == segment), rate)

    flag = F.col("variable") == "has_previous_default"
    numbers = rates.agg(
        F.sum(F.when(flag, F.col("loans"))).alias("loans"),
        (fraction(F.sum(F.when(flag, F.col("defaults"))),
                  F.sum(F.when(flag, F.col("loans")))) * 100).alias("overall"),
        F.max(pick("has_previous_default", "1")).alias("prior"),
        F.max(pick("has_previous_default", "0")).alias("no_prior"),
        F.min(pick("bureau_band")).alias("lowest"), F.max(pick("bureau_band")).alias("highest"))
    two = {name: F.round(F.col(name), 2) for name in
           ("overall", "prior", "no_prior", "lowest", "highest")}
    # The wording of the report.
    lines = [
        F.format_string("Disbursed population: %d loans with %.2f%% defaults.",
                        F.col("loans"), two["overall"]),
        F.format_string("Prior-default rate: %.2f%% versus %.2f%%.",
                        two["prior"], two["no_prior"]),
        F.format_string("Bureau-band rates range from %.2f%% to %.2f%%.",
                        two["lowest"], two["highest"]),
    ]
    return numbers.select(F.posexplode(F.array(*lines)).alias("position", "line"))
