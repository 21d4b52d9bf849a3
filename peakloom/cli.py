"""Command line: peak lists from tile stores, stores as Parquet, and chromatograms.

    python -m peakloom.cli store2parquet -i run.sqlite -o folder
    python -m peakloom.cli parquet2mgf -i folder -o mgf_folder [--level 2] [--precursor main|refined] [--cutoff X]
    python -m peakloom.cli xic -i folder --mz 500 --tolerance 0.01 [--method MAX|NEAREST|SUM] -o folder

A folder of Parquet tables holds peaks.parquet (spectrum_id, mz, intensity) and spectra.parquet (id, time, ms_level,
iso_min, iso_max, title, charge).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.operators import precursor, xic
from peakloom.sources import mgf, sqlite


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/peaks.parquet"), spark.read.parquet(f"{folder}/spectra.parquet")


def to_mgf(spark: SparkSession, folder: str, out: str, level: int = 2, estimator: str = "main", cutoff: float | None = None) -> None:
    """Spectra of a level (2 or 3) as MGF files; titles and charges are the headers' own."""
    if level not in (2, 3):
        raise ValueError("peak lists are made of level 2 or 3")
    peaks, spectra = _tables(spark, folder)
    own = spectra.where(F.col("ms_level") == level)
    arrays = peaks.groupBy("spectrum_id").agg(F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("peaks"))
    mz = precursor.estimated(spectra, peaks, estimator).withColumnRenamed("id", "__id")
    rows = own.join(arrays, F.col("id") == F.col("spectrum_id")).join(mz, F.col("id") == F.col("__id"), "left")
    mgf.write(rows.select("id", "title", "time", F.coalesce("precursor_mz", F.lit(0.0)).alias("precursor_mz"), "charge", "peaks"), out, cutoff=cutoff)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="peakloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("store2parquet", "parquet2mgf", "xic"):
        c = commands.add_parser(name)
        c.add_argument("-i", required=True)
        c.add_argument("-o", required=True)
    commands.choices["parquet2mgf"].add_argument("--level", type=int, default=2)
    commands.choices["parquet2mgf"].add_argument("--precursor", default="main", choices=sorted(precursor.ESTIMATORS))
    commands.choices["parquet2mgf"].add_argument("--cutoff", type=float)
    commands.choices["xic"].add_argument("--mz", type=float, required=True)
    commands.choices["xic"].add_argument("--tolerance", type=float, required=True)
    commands.choices["xic"].add_argument("--method", default="MAX", choices=xic.METHODS)
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("peakloom").getOrCreate()
    if a.command == "store2parquet":
        sqlite.import_store(spark, a.i, a.o)
    elif a.command == "parquet2mgf":
        to_mgf(spark, a.i, a.o, a.level, a.precursor, a.cutoff)
    else:
        peaks, spectra = _tables(spark, a.i)
        xic.xic(peaks, spectra, a.mz, a.tolerance, method=a.method).write.parquet(a.o)


if __name__ == "__main__":
    main()
