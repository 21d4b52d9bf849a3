"""Extracted-ion chromatograms and the range queries below them.

Inputs are a peak table (spectrum_id, mz, intensity, ...) and a header table (id, time, ms_level, iso_min, iso_max).
Filters on m/z reach the peak scan, those on time and level the header scan; one shuffle by spectrum follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.operators.ranges import within
from peakloom.operators.tiling import TileSizes

METHODS = ("MAX", "NEAREST", "SUM")


def header_window(headers: DataFrame, min_rt: float | None, max_rt: float | None, ms_level: int, parent_mz: float | None = None) -> DataFrame:
    """Headers of a level in a time window (a negative start is 0; an end of 0 or less, or none, is open) and, for
    level 2, of isolation windows that hold parent_mz."""
    if parent_mz is not None and ms_level != 2:
        raise ValueError("a parent m/z needs level 2")
    out = headers.where(F.col("ms_level") == ms_level)
    if min_rt is not None and min_rt > 0:
        out = out.where(F.col("time") >= min_rt)
    if max_rt is not None and max_rt > 0:
        out = out.where(F.col("time") <= max_rt)
    if parent_mz is not None:
        out = out.where(F.lit(float(parent_mz)).between(F.col("iso_min"), F.col("iso_max")))
    return out


def peaks_in_range(peaks: DataFrame, headers: DataFrame, min_mz: float, max_mz: float, min_rt: float | None = None, max_rt: float | None = None, ms_level: int = 1, parent_mz: float | None = None) -> DataFrame:
    """Peaks with min_mz <= mz <= max_mz of the spectra of header_window(), with their time. Peaks of a laid out run
    (tiling.write_run) have their level, m/z bin and time row; then folders and row groups outside are skipped."""
    own = header_window(headers, min_rt, max_rt, ms_level, parent_mz).select(F.col("id").alias("__id"), "time")
    laid_out = {"ms_level", "mz_bin", "rt_row"} <= set(peaks.columns)
    if laid_out:
        peaks = peaks.where((F.col("ms_level") == ms_level) & within(F.col("mz"), min_mz, max_mz, F.col("mz_bin"), TileSizes().mz_ms1))
        for end, value in ((">=", min_rt), ("<=", max_rt)):
            if value is not None and value > 0:
                peaks = peaks.where(f"rt_row {end} {int(value // TileSizes().time_ms1)}")
        peaks = peaks.drop("time")
    else:
        peaks = peaks.where(F.col("mz").between(min_mz, max_mz))
    return peaks.join(own, F.col("spectrum_id") == F.col("__id")).drop("__id")


def slices_in_range(peaks: DataFrame, headers: DataFrame, *window, **more) -> DataFrame:
    """One row a spectrum with peaks in the window: number, sum and m/z range of those."""
    return peaks_in_range(peaks, headers, *window, **more).groupBy("spectrum_id", "time").agg(
        F.count("*").alias("n_peaks"), F.sum("intensity").alias("sum_intensity"), F.min("mz").alias("min_mz"), F.max("mz").alias("max_mz")
    )


def reduce_spectra(peaks: DataFrame, method: str, centre: float | None = None, tolerance: float | None = None) -> DataFrame:
    """One peak a spectrum: MAX the most intense (of ties the highest m/z), NEAREST the nearest to centre within
    tolerance (of ties the lower m/z), SUM the summed intensity at the m/z of the middle peak by intensity."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; one of {', '.join(METHODS)}")
    peak = F.struct("intensity", "mz")
    grouped = peaks.groupBy("spectrum_id", "time")
    if method == "MAX":
        out = grouped.agg(F.max(peak).alias("p"))
    elif method == "NEAREST":
        if centre is None or tolerance is None:
            raise ValueError("NEAREST needs a centre and a tolerance")
        near = peaks.withColumn("d", F.abs(F.col("mz") - F.lit(float(centre)))).where(F.col("d") <= tolerance)
        out = near.groupBy("spectrum_id", "time").agg(F.min(F.struct("d", "mz", "intensity")).alias("p"))
    else:
        sums = grouped.agg(F.sum("intensity").alias("total"), F.array_sort(F.collect_list(peak)).alias("all"))
        out = sums.select("spectrum_id", "time", F.struct(F.col("total").alias("intensity"), F.get("all", F.floor(F.size("all") / 2).cast("int"))["mz"].alias("mz")).alias("p"))
    return out.select("spectrum_id", "time", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"))


def xic(peaks: DataFrame, headers: DataFrame, mz: float, tolerance: float, min_rt: float | None = None, max_rt: float | None = None, method: str = "MAX", ms_level: int = 1, parent_mz: float | None = None) -> DataFrame:
    """The chromatogram of mz +- tolerance (Da)."""
    own = peaks_in_range(peaks, headers, mz - tolerance, mz + tolerance, min_rt, max_rt, ms_level, parent_mz)
    return reduce_spectra(own, method, mz, tolerance)


def xic_in_range(peaks: DataFrame, headers: DataFrame, min_mz: float, max_mz: float, min_rt: float | None = None, max_rt: float | None = None, method: str = "MAX") -> DataFrame:
    """The chromatogram of an m/z range: its middle and half its width."""
    return xic(peaks, headers, (min_mz + max_mz) / 2, (max_mz - min_mz) / 2, min_rt, max_rt, method)


def ppm_to_da(mz, ppm):
    return mz * ppm / 1e6


def da_to_ppm(mz, da):
    return da * 1e6 / mz


PROTON_MASS = 1.007276466812
