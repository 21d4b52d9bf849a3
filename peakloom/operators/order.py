"""Numbering and running sums over a whole table without one task that sees it all.

Rows are dealt to bins between quantiles of the leading order column, as many as the row count asks for, so that neither
outliers nor clusters fill a bin; a value that fills several bins alone is cut by the second order column. Each bin is
numbered alone and shifted by the totals of the bins before it. To the driver come a count and at most QUANTILES
quantiles (as many again for each hot value); the table of bin totals has one row a bin, BINS at most.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BIN = 100_000
#: Quantiles that are asked for in one pass, and how exact they are (ranks are right to a share of 1 / ACCURACY).
QUANTILES, ACCURACY = 2_000, 20_000


def _number(df: DataFrame, name: str) -> Column | None:
    """An order column as a number, or None if it isn't one."""
    kind = df.schema[name].dataType.simpleString()
    if kind.startswith(("timestamp", "date")):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    return F.col(name).cast("double") if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal") else None


def _quantiles(value: Column, n: int = QUANTILES) -> Column:
    return F.percentile_approx(value, [k / n for k in range(1, n)], ACCURACY)


def _thinned(quantiles: list[float] | None, rows: int, rows_per_bin: int) -> list[float]:
    """Of the quantiles, those that cut so many rows to bins of about rows_per_bin."""
    bins = max(1, -(-rows // rows_per_bin))
    if bins == 1 or not quantiles:
        return []
    return quantiles[:: max(1, (len(quantiles) + 1) // bins)]


def cuts(df: DataFrame, value: Column, rows_per_bin: int = ROWS_PER_BIN) -> list[float]:
    """Ascending values that cut df to bins of about rows_per_bin rows by value; none if there are no more rows than that.
    A value with many rows comes several times. One pass; nulls count for nothing."""
    n, quantiles = df.agg(F.count(value), _quantiles(value)).first()
    return _thinned(quantiles, n, rows_per_bin)


def bin_by(value: Column, at: list[float]) -> Column:
    """How many of the ascending cuts a value reaches, -1 for null: looked up among every k-th cut, then among the k after
    that one."""
    if not at:
        return F.when(value.isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long")
    k = max(1, int(len(at) ** 0.5))
    reached = lambda xs: F.size(F.filter(xs, lambda x: x <= value))
    coarse, fine = F.array(*map(F.lit, at[::k])), F.array(*map(F.lit, at))
    first = reached(coarse)
    rest = F.when(first == 0, 0).otherwise((first - 1) * k + reached(F.slice(fine, F.greatest((first - 1) * k + 1, F.lit(1)), F.lit(k))))
    return F.when(value.isNull(), F.lit(-1)).otherwise(rest).cast("long")


def _binned(df: DataFrame, by: list[str], rows_per_bin: int) -> DataFrame:
    """Adds __bin and, to cut hot values of the leading column further, __sub."""
    lead, second = _number(df, by[0]), _number(df, by[1]) if len(by) > 1 else None
    if lead is None:
        raise ValueError(f"{by[0]} must be a number or a time")
    at = cuts(df, lead, rows_per_bin)
    hot = [v for v, n in Counter(at).items() if n > 1] if second is not None else []
    out = df.withColumn("__bin", bin_by(lead, sorted(set(at))))
    sub = F.lit(0).cast("long")
    if hot:
        found = df.select(lead.alias("v"), second.alias("s")).where(F.col("v").isin(hot)).groupBy("v").agg(F.count("*").alias("n"), _quantiles(F.col("s")).alias("q")).collect()
        for r in found:
            sub = F.when(lead == r["v"], bin_by(second, sorted(set(_thinned(r["q"], r["n"], rows_per_bin))))).otherwise(sub)
        # what shares a bin with a hot value is greater than it
        sub = F.when(lead.isin(hot), sub).otherwise(F.lit(QUANTILES + 1)).cast("long")
    return out.withColumn("__sub", sub)


def running_sums(df: DataFrame, by: list[str], sums: dict[str, Column], rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """Adds, for each name, the sum of its column over the rows up to this one in the order of by (nulls first)."""
    binned = _binned(df, by, rows_per_bin)
    for k, (name, value) in enumerate(sums.items()):
        binned = binned.withColumn(f"__v{k}", value.cast("long"))
    names = list(sums)
    inside = Window.partitionBy("__bin", "__sub").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("__b", "__c").rowsBetween(Window.unboundedPreceding, -1)
    totals = binned.groupBy(F.col("__bin").alias("__b"), F.col("__sub").alias("__c")).agg(*[F.sum(f"__v{k}").alias(f"__t{k}") for k in range(len(names))])
    totals = totals.select("__b", "__c", *[F.coalesce(F.sum(f"__t{k}").over(before), F.lit(0)).alias(f"__s{k}") for k in range(len(names))])
    out = binned.withColumns({f"__r{k}": F.sum(f"__v{k}").over(inside) for k in range(len(names))})
    out = out.join(totals, (out["__bin"] == totals["__b"]) & (out["__sub"] == totals["__c"]))
    return out.select(*df.columns, *[(F.col(f"__r{k}") + F.col(f"__s{k}")).alias(n) for k, n in enumerate(names)])


def row_numbers(df: DataFrame, by: list[str], name: str = "number", rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """Adds the place of each row, from 1, in the order of by."""
    return running_sums(df, by, {name: F.lit(1)}, rows_per_bin)
