"""Tiles of m/z and time, run slices, numbering and layout of a run."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.operators.order import row_numbers, running_sums
from peakloom.operators.ranges import bin_of


@dataclass(frozen=True)
class TileSizes:
    """Heights (Da) and widths (seconds) of tiles by level; 0 seconds means a row for each time."""

    mz_ms1: float = 5.0
    mz_msn: float = 10_000.0
    time_ms1: float = 15.0
    time_msn: float = 0.0


def tiled(peaks: DataFrame, spectra: DataFrame, mz_width: float = 5.0, rt_width: float = 15.0) -> DataFrame:
    """Peaks with their level, isolation window (0 for level 1), m/z bin and time row."""
    own = spectra.select(F.col("id").alias("__id"), "time", "ms_level", F.when(F.col("ms_level") == 1, F.lit(0.0)).otherwise(F.col("iso_min")).alias("iso"))
    return peaks.join(own, F.col("spectrum_id") == F.col("__id")).drop("__id").withColumns({"mz_bin": bin_of(F.col("mz"), mz_width), "rt_row": bin_of(F.col("time"), rt_width)})


def tile_statistics(tiles: DataFrame) -> DataFrame:
    """One row a tile: first and last time and spectrum, and its number of peaks."""
    return tiles.groupBy("ms_level", "iso", "rt_row", "mz_bin").agg(
        F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.min("spectrum_id").alias("first_spectrum_id"), F.max("spectrum_id").alias("last_spectrum_id"), F.count("*").alias("n_peaks")
    )


def run_slices(tiles: DataFrame, mz_width: float = 5.0) -> DataFrame:
    """The m/z bins in use by level, numbered by level and bin: one row a slice, so a window over all of them is small."""
    own = tiles.select("ms_level", "mz_bin").distinct()
    number = F.row_number().over(Window.orderBy("ms_level", "mz_bin")).cast("long")
    return own.select(number.alias("number"), "ms_level", "mz_bin", (F.col("mz_bin") * mz_width).cast("double").alias("begin_mz"), ((F.col("mz_bin") + 1) * mz_width).cast("double").alias("end_mz"))


def densified(tiles: DataFrame) -> DataFrame:
    """Each time row of a level with every slice of the level, 0 peaks where the tile is missing."""
    counts = tiles.groupBy("ms_level", "rt_row", "mz_bin").agg(F.count("*").alias("n"))
    rows = counts.select("ms_level", "rt_row").distinct()
    columns = counts.select("ms_level", "mz_bin").distinct()
    return rows.join(columns, "ms_level").join(counts, ["ms_level", "rt_row", "mz_bin"], "left").select("ms_level", "rt_row", "mz_bin", F.coalesce("n", F.lit(0)).alias("n_peaks"))


def resequenced(spectra: DataFrame, by: list[str]) -> DataFrame:
    """New ids in the order of by, from 1, and the cycle: how many level 1 spectra came so far."""
    return running_sums(spectra, by, {"new_id": F.lit(1), "new_cycle": F.when(F.col("ms_level") == 1, 1).otherwise(0)})


def renumbered(spectra: DataFrame, peaks: DataFrame) -> DataFrame:
    """Spectra with peaks, numbered from 1 by id."""
    return row_numbers(spectra.join(peaks.select("spectrum_id").distinct(), F.col("id") == F.col("spectrum_id"), "left_semi"), ["id"], "new_id")


def anchored_rows(spectra: DataFrame, width: float, group: list[str]) -> DataFrame:
    """Time rows as a writer opens them: the first spectrum opens one, and each that is more than width later than the
    opening one opens the next. The rule is sequential within a group (run, level, window): give the run as part of the
    group where there are several. A group's headers pass through one task in sorted batches, which keeps nothing but
    the group and the opening time from one batch to the next."""
    own = spectra.select(*group, "id", F.col("time").cast("double").alias("time"))
    schema = T.StructType([*own.schema.fields, T.StructField("row_start", T.DoubleType())])
    dealt = own.repartition(*group).sortWithinPartitions(*group, "time", "id")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, opened = None, 0.0
        for frame in frames:
            starts = []
            keys = frame[group].astype(object).where(frame[group].notna(), None)
            for key, t in zip(keys.itertuples(index=False, name=None), frame["time"].tolist(), strict=True):
                if key != last or t - opened > width:
                    last, opened = key, t
                starts.append(opened)
            yield frame.assign(row_start=starts)

    return dealt.mapInPandas(fold, schema)


def dia_histogram(peaks: DataFrame, spectra: DataFrame, bin_size: float = 1.0) -> DataFrame:
    """Summed intensity by isolation window and m/z bin (cut towards 0) of level 2 spectra; every peak counts."""
    own = spectra.where("ms_level = 2").select("id", "iso_min")
    at = F.floor(F.col("mz") / bin_size).cast("bigint")
    return peaks.join(own, F.col("spectrum_id") == F.col("id")).groupBy("iso_min", at.alias("bin")).agg(F.sum("intensity").alias("intensity"))


def write_histogram(histogram: DataFrame, path: str) -> None:
    """As tab-separated text with a header, in the order of window and bin."""
    histogram.repartitionByRange("iso_min", "bin").sortWithinPartitions("iso_min", "bin").write.option("sep", "\t").option("header", True).csv(path)


def write_run(tiles: DataFrame, path: str) -> None:
    """A run as Parquet: folders by level, sorted by m/z bin, time row and spectrum, so that row groups act as tiles."""
    tiles.repartitionByRange("ms_level", "mz_bin").sortWithinPartitions("ms_level", "mz_bin", "rt_row", "spectrum_id", "mz").write.partitionBy("ms_level").parquet(path)
