"""Statistics: histograms with all bins, means and medians that skip zeros, the object in the middle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.operators.order import row_numbers


def histogram(df: DataFrame, value: str, n_bins: int | None = None) -> DataFrame:
    """All bins between the least and the greatest value, empty ones too: bin, lower, centre, upper, n. Without n_bins
    their number is the root of the number of values. One pass for the range, one for the counts."""
    known = df.where(F.col(value).isNotNull())
    low, high, n = known.agg(F.min(value), F.max(value), F.count("*")).first()
    bins = n_bins or max(1, math.isqrt(n))
    width = 0.0 if n == 0 else (high - low) / bins + 1e-10
    grid = df.sparkSession.range(bins if n else 0).select(F.col("id").cast("int").alias("bin"))
    if not n:
        low = 0.0
    at = F.least(F.floor((F.col(value) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = known.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    lower = F.lit(low) + F.col("bin") * F.lit(width)
    return grid.join(counts, "bin", "left").select("bin", lower.alias("lower"), (lower + F.lit(width) / 2).alias("centre"), (lower + F.lit(width)).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"))


def is_zero_or_nan(value: Column) -> Column:
    return (value == 0) | F.isnan(value)


def filtered_mean(value: Column) -> Column:
    """Mean of the values that are neither 0 nor NaN; NaN if none is left."""
    return F.coalesce(F.avg(F.when(~is_zero_or_nan(value), value)), F.lit(float("nan")))


def filtered_median(value: Column) -> Column:
    """Median of the values that are neither 0 nor NaN; NaN if none is left."""
    return F.coalesce(F.median(F.when(~is_zero_or_nan(value), value)), F.lit(float("nan")))


def median_object(df: DataFrame, group: list[str], by: list[str]) -> DataFrame:
    """Of each group the row at place n / 2 (n even) or (n - 1) / 2 in the order of by, from 0."""
    if not group:
        n = df.count()
        return row_numbers(df, by, "__n").where(F.col("__n") == n // 2 + 1).drop("__n")
    own = df.withColumns({"__n": F.row_number().over(Window.partitionBy(*group).orderBy(*by)), "__all": F.count("*").over(Window.partitionBy(*group))})
    return own.where(F.col("__n") == F.floor(F.col("__all") / 2) + 1).drop("__n", "__all")


def combinations(df: DataFrame, key: str, name: str, group: str) -> DataFrame:
    """Pairs of different rows of a group in the order of key, by an equi-join on the group."""
    a = df.select(F.col(group).alias("__g"), F.col(key).alias("first"), F.col(name).alias("first_name"))
    b = df.select(F.col(group).alias("__h"), F.col(key).alias("second"), F.col(name).alias("second_name"))
    return a.join(b, (F.col("__g") == F.col("__h")) & (F.col("first") < F.col("second"))).select(F.col("__g").alias(group), "first", "first_name", "second", "second_name")


def line_through(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Slope and intercept; equal x raise."""
    slope = F.when(x1 == x2, F.raise_error(F.lit("a line needs two different x"))).otherwise((y2 - y1) / (x2 - x1))
    return slope, y1 - slope * x1
