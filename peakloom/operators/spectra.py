"""Headers, whole spectra, run slices and array-wise lookups inside a spectrum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.operators.ranges import bin_of


def headers(spectra: DataFrame, ms_level: int | None = None) -> DataFrame:
    """The header columns; the precursor of level 1 is null."""
    own = spectra if ms_level is None else spectra.where(F.col("ms_level") == ms_level)
    precursor = F.when(F.col("ms_level") > 1, (F.col("iso_min") + F.col("iso_max")) / 2)
    return own.select("id", "time", "ms_level", "cycle", F.col("tic0").alias("tic"), precursor.alias("precursor_mz"))


def header_for_time(spectra: DataFrame, time: float, ms_level: int) -> DataFrame:
    """The header nearest in time, the lower id of ties."""
    gap = F.abs(F.col("time") - F.lit(float(time)))
    return spectra.where(F.col("ms_level") == ms_level).agg(F.min_by("id", F.struct(gap, "id")).alias("id"))


def spectrum_arrays(peaks: DataFrame) -> DataFrame:
    """One row a spectrum: its peaks as an array of (mz, intensity, lhwhm, rhwhm), by m/z."""
    return peaks.groupBy("spectrum_id").agg(F.array_sort(F.collect_list(F.struct("mz", "intensity", "lhwhm", "rhwhm"))).alias("peaks"))


def slices(peaks: DataFrame, width: float = 5.0) -> DataFrame:
    """Spectrum slices: one row a spectrum and m/z bin, its peaks as an array by m/z."""
    return peaks.groupBy("spectrum_id", bin_of(F.col("mz"), width).alias("mz_bin")).agg(F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("peaks"))


def merged(parts: DataFrame) -> DataFrame:
    """Slices back to spectra: parts by their first m/z, one after the other; empty ones don't count."""
    full = parts.where(F.size("peaks") > 0).select("spectrum_id", F.struct(F.col("peaks")[0]["mz"].alias("first"), "peaks").alias("part"))
    whole = full.groupBy("spectrum_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return whole.select("spectrum_id", F.flatten(F.transform("parts", lambda p: p["peaks"])).alias("peaks"))


def mz_range_filter(peaks: Column, low: float, high: float) -> Column:
    """Peaks with low <= mz < high; null if none is left."""
    if low > high:
        raise ValueError("low must not exceed high")
    kept = F.filter(peaks, lambda p: (p["mz"] >= low) & (p["mz"] < high))
    return F.when(F.size(kept) > 0, kept)


def nearest_peak(peaks: Column, mz: Column, ppm: float) -> Column:
    """The peak nearest to mz within ppm, the lower of ties; null if none is."""
    close = F.filter(peaks, lambda p: F.abs(p["mz"] - mz) <= mz * ppm / 1e6)
    best = F.array_min(F.transform(close, lambda p: F.struct(F.abs(p["mz"] - mz).alias("d"), p["mz"].alias("mz"), p["intensity"].alias("intensity"))))
    return F.when(best.isNotNull(), F.struct(best["mz"].alias("mz"), best["intensity"].alias("intensity")))


def nearest_peak_index(peaks: Column, value: Column) -> Column:
    """The index, from 0, of the peak nearest to value, the lower of ties; null without peaks."""
    return F.array_min(F.transform(peaks, lambda p, i: F.struct(F.abs(p["mz"] - value).alias("d"), i.alias("i"))))["i"]


def peak_index(peaks: Column, value: Column, ppm: float) -> Column:
    """As nearest_peak_index() if nearer than ppm (strictly), else -1."""
    best = F.array_min(F.transform(peaks, lambda p, i: F.struct(F.abs(p["mz"] - value).alias("d"), i.alias("i"))))
    return F.coalesce(F.when(1e6 * best["d"] / value < ppm, best["i"]), F.lit(-1))


def dense(vectors: DataFrame, first_mz: float = 400.0, step: float = 0.5) -> DataFrame:
    """Vectors as profile spectra: value i lies at first_mz + step * i."""
    return vectors.select("vec_id", "label", F.transform("embedding", lambda v, i: F.struct((F.lit(first_mz) + F.lit(step) * i).alias("mz"), v.cast("double").alias("intensity"))).alias("peaks"))


def base_peak(peaks: DataFrame, key: str = "spectrum_id", more: dict[str, Column] | None = None) -> DataFrame:
    """The first most intense peak above 0 (0.0 if there is none) and the summed intensity of each spectrum, and more sums
    by name."""
    top = F.max(F.when(F.col("intensity") > 0, F.struct("intensity", (-F.col("mz")).alias("m"))))
    return peaks.groupBy(key).agg(top.alias("t"), F.sum("intensity").alias("tic"), *[v.alias(k) for k, v in (more or {}).items()]).select(key, F.coalesce(-F.col("t.m"), F.lit(0.0)).alias("base_mz"), F.coalesce("t.intensity", F.lit(0.0)).alias("base_intensity"), "tic", *(more or {}))
