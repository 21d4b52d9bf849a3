"""Joins and filters on ranges, expressed as equi-joins and predicates that Spark can push down and shuffle on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.operators.order import ROWS_PER_BIN, bin_by, cuts


def within(value: Column, low: float, high: float, bin_col: Column | None = None, width: float | None = None) -> Column:
    """low <= value <= high; with a bin column (floor(value / width)) also the bins' range, so that files and row groups
    laid out by bin are skipped."""
    exact = value.between(low, high)
    if bin_col is None or width is None:
        return exact
    return bin_col.between(int(low // width), int(high // width)) & exact


def bin_of(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(width)).cast("long")


def stab_join(points: DataFrame, point: str, intervals: DataFrame, low: str, high: str, width: float, on: list[str] | None = None, closed: bool = True) -> DataFrame:
    """Points with the intervals that hold them (low <= point <= high, or < high if not closed). Each interval is
    copied to the bins it touches, then bins are equi-joined and the exact test follows; a point is in one bin, so no
    pair comes twice. A point or an end that is null matches nothing."""
    p = points.withColumn("__bin", bin_of(F.col(point), width))
    i = intervals.where(F.col(low) <= F.col(high)).withColumn("__ibin", F.explode(F.sequence(bin_of(F.col(low), width), bin_of(F.col(high), width))))
    keys = [p[k] == i[k] for k in on or []]
    upper = (F.col(point) <= F.col(high)) if closed else (F.col(point) < F.col(high))
    condition = (p["__bin"] == i["__ibin"]) & (F.col(low) <= F.col(point)) & upper
    for k in keys:
        condition = condition & k
    out = p.join(i, condition).drop("__bin", "__ibin")
    for k in on or []:
        out = out.drop(i[k])
    return out


def overlap_join(left: DataFrame, l_low: str, l_high: str, right: DataFrame, r_low: str, r_high: str, width: float) -> DataFrame:
    """Pairs of intervals that overlap (closed ends). Both sides are copied to their bins; a pair is kept in the first
    bin that both touch."""
    a = left.withColumn("__a", F.explode(F.sequence(bin_of(F.col(l_low), width), bin_of(F.col(l_high), width))))
    b = right.withColumn("__b", F.explode(F.sequence(bin_of(F.col(r_low), width), bin_of(F.col(r_high), width))))
    first = F.greatest(bin_of(F.col(l_low), width), bin_of(F.col(r_low), width))
    out = a.join(b, (a["__a"] == b["__b"]) & (F.col(l_low) <= F.col(r_high)) & (F.col(r_low) <= F.col(l_high)))
    return out.where(F.col("__a") == first).drop("__a", "__b")


def neighbours(probes: DataFrame, at: str, rows: DataFrame, key: str, values: list[str], rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """Each probe with the struct of (key, *values) of the last row at or before it (prev) and of the first row at or
    after it (next); null where there is none, and for a null probe. Ties of key go to the first by values.

    The distinct times of probes and rows, one narrow row each, are cut to bins by their quantiles; inside a bin prev is
    a running value in ascending and next one in descending order, each linear, and bins without a row before or after
    take it from the nearest bin that has one (a window over the bins, order.QUANTILES at most). The probes are joined
    back by their time, so that many equal ones are a join that Spark can split."""
    own = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("double").alias("__t")).agg(F.min(F.struct(*values)).alias("__s"))
    own = own.select("__t", F.struct(F.col("__t").alias("key"), *[F.col(f"__s.{v}").alias(v) for v in values]).alias("__r"))
    asked = probes.select(F.col(at).cast("double").alias("__t")).where("__t is not null").distinct()
    both = own.join(asked.withColumn("__asked", F.lit(True)), "__t", "full")
    found = both.withColumn("__bin", bin_by(F.col("__t"), sorted(set(cuts(both, F.col("__t"), rows_per_bin)))))
    edges = found.groupBy("__bin").agg(F.min("__r").alias("__first"), F.max("__r").alias("__last"))
    back = Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = edges.select("__bin", F.last("__last", ignorenulls=True).over(back).alias("__back"), F.last("__first", ignorenulls=True).over(ahead).alias("__ahead"))
    upto = lambda *order: Window.partitionBy("__bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("__prev", F.last("__r", ignorenulls=True).over(upto("__t"))).withColumn("__next", F.last("__r", ignorenulls=True).over(upto(F.desc("__t"))))
    found = found.where("__asked").join(F.broadcast(bins), "__bin").select(F.col("__t").alias("__at"), F.coalesce("__prev", "__back").alias("prev"), F.coalesce("__next", "__ahead").alias("next"))
    return probes.join(found, F.col(at).cast("double") == F.col("__at"), "left").drop("__at")


def nearest(probes: DataFrame, at: str, rows: DataFrame, key: str, values: list[str], rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """Each probe with the columns key and values of the row nearest to it; the lower key wins a tie."""
    both = neighbours(probes, at, rows, key, values, rows_per_bin)
    lower = F.col("next").isNull() | (F.abs(F.col(at) - F.col("prev.key")) <= F.abs(F.col("next.key") - F.col(at)))
    pick = F.when(F.col("prev").isNotNull() & lower, F.col("prev")).otherwise(F.col("next"))
    return both.withColumn("__n", pick).select(*probes.columns, F.col("__n.key").alias(key), *[F.col(f"__n.{v}").alias(v) for v in values])


def interpolated(probes: DataFrame, at: str, points: DataFrame, x: str, y: str, name: str = "y", rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """Each probe with the value of the line through the neighbouring points; before the first and after the last one
    theirs. Points of equal x count with their mean; null without points."""
    merged = points.groupBy(x).agg(F.avg(y).alias(y))
    both = neighbours(probes, at, merged, x, [y], rows_per_bin)
    a, b = F.col("prev"), F.col("next")
    line = a[y] + (b[y] - a[y]) * (F.col(at) - a["key"]) / (b["key"] - a["key"])
    value = F.when(a.isNull(), b[y]).when(b.isNull() | (a["key"] == b["key"]), a[y]).otherwise(line)
    return both.select(*probes.columns, value.alias(name))
