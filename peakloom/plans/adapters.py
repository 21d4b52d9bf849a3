"""The synthetic tables seen as spectra: orders as headers, lineitem as peaks, embeddings as profile spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.operators.order import running_sums
from peakloom.session import table


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers without the cycle, which needs an order over all of them; see with_cycle()."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderkey").cast("double") * 0.25).alias("time"),
        F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(2).alias("ms_level"),
        F.col("o_totalprice").alias("tic0"),
        (400 + (F.col("o_custkey") % 24) * 25).cast("double").alias("iso_min"),
        (425 + (F.col("o_custkey") % 24) * 25).cast("double").alias("iso_max"),
        F.col("o_orderdate").alias("acq"),
        F.col("o_orderstatus").alias("encoding"),
        F.col("o_orderpriority").alias("activation"),
        F.col("o_custkey").alias("source"),
    )


def with_cycle(headers: DataFrame) -> DataFrame:
    """Adds the cycle: how many level 1 spectra came up to each id."""
    return running_sums(headers, ["id"], {"cycle": F.when(F.col("ms_level") == 1, 1).otherwise(0)})


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("spectrum_id"), (F.col("l_extendedprice") / 100.0).alias("mz"), F.col("l_quantity").alias("intensity"), F.col("l_discount").alias("lhwhm"), F.col("l_tax").alias("rhwhm")
    )


#: The same two tables for an SQL query, to be followed by a SELECT or more tables.
SQL = """WITH sp AS (
 SELECT o_orderkey AS id, CAST(o_orderkey AS DOUBLE) * 0.25 AS time, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 2 END AS ms_level,
  CAST(SUM(CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cycle,
  o_totalprice AS tic0, CAST(400 + (o_custkey % 24) * 25 AS DOUBLE) AS iso_min, CAST(425 + (o_custkey % 24) * 25 AS DOUBLE) AS iso_max,
  o_orderdate AS acq, o_orderstatus AS encoding, o_orderpriority AS activation, o_custkey AS source FROM orders),
pk AS (SELECT l_orderkey AS spectrum_id, l_extendedprice / 100.0 AS mz, l_quantity AS intensity, l_discount AS lhwhm, l_tax AS rhwhm FROM lineitem)
"""
