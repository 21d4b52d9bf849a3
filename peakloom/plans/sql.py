"""SQL over a run: views of the spectra tables, and statements with named parameters."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from peakloom.plans import adapters


def register(spark: SparkSession, sf_dir: str) -> None:
    """The views v_spectrum and v_peak over a data folder."""
    adapters.with_cycle(adapters.spectra(spark, sf_dir)).createOrReplaceTempView("v_spectrum")
    adapters.peaks(spark, sf_dir).createOrReplaceTempView("v_peak")


def query(spark: SparkSession, statement: str, **values: Any) -> DataFrame:
    """A statement with :name parameters, bound as values, not as text."""
    return spark.sql(statement, args=values)


def single(df: DataFrame) -> Any:
    """The first column of the first row, or None."""
    row = df.first()
    return None if row is None else row[0]
