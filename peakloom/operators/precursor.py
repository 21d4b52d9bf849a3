"""Precursor m/z: estimators, refinement from survey scans, and calibration by known fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.functions import xmlparams
from peakloom.operators.order import row_numbers
from peakloom.operators.ranges import interpolated, stab_join

#: m/z of the y1 ions of lysine and arginine; fixed values.
Y1_K, Y1_R = 147.112804, 175.118952


def refined(spectra: DataFrame, peaks: DataFrame, rt_window: float = 5.0) -> DataFrame:
    """For each level 2 spectrum: the level 1 peaks in its isolation window within rt_window seconds, of each survey scan
    the one nearest to the precursor, and the median of those. id, n_scans, refined_mz; spectra without such peaks are
    left out. Survey peaks are few columns wide and are joined to windows by time bins."""
    ms2 = spectra.where(F.col("ms_level") == 2).select("id", ((F.col("iso_min") + F.col("iso_max")) / 2).alias("target"), "iso_min", "iso_max", (F.col("time") - rt_window).alias("from_t"), (F.col("time") + rt_window).alias("to_t"))
    ms1 = spectra.where(F.col("ms_level") == 1).select(F.col("id").alias("scan"), F.col("time").alias("scan_time"))
    near_scans = stab_join(ms1, "scan_time", ms2, "from_t", "to_t", 2 * rt_window).select("id", "target", "iso_min", "iso_max", "scan")
    hits = near_scans.join(peaks.select(F.col("spectrum_id").alias("__s"), "mz"), (F.col("scan") == F.col("__s")) & F.col("mz").between(F.col("iso_min"), F.col("iso_max")))
    best = hits.groupBy("id", "scan").agg(F.min(F.struct(F.abs(F.col("mz") - F.col("target")).alias("d"), "mz")).alias("b"))
    return best.groupBy("id").agg(F.count("*").alias("n_scans"), F.median("b.mz").alias("refined_mz"))


def main_precursor(spectra: DataFrame) -> DataFrame:
    """The header's value."""
    return spectra.where(F.col("ms_level") > 1).select("id", ((F.col("iso_min") + F.col("iso_max")) / 2).alias("precursor_mz"))


def selected_ion(spectra: DataFrame) -> DataFrame:
    """The first selected ion of the precursor list (an XML column, precursor_list)."""
    return spectra.where(F.col("ms_level") > 1).select("id", xmlparams.precursors(F.col("precursor_list"))["selected_mz"].alias("precursor_mz"))


def vendor_monoisotopic(spectra: DataFrame, name: str = "[Thermo Trailer Extra]Monoisotopic M/Z:") -> DataFrame:
    """The value of a user param of the first scan (an XML column, scan_list); 0 counts as missing."""
    path = f"//scan[1]/userParam[@name='{name}']/@value"
    value = F.get(F.xpath(F.col("scan_list"), F.lit(path)), 0).try_cast("double")
    return spectra.where(F.col("ms_level") > 1).select("id", F.nullif(value, F.lit(0.0)).alias("precursor_mz"))


#: Estimators by name: callables (spectra, peaks) that give (id, precursor_mz). Own ones can be added.
ESTIMATORS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "main": lambda spectra, peaks: main_precursor(spectra),
    "selected_ion": lambda spectra, peaks: selected_ion(spectra),
    "vendor": lambda spectra, peaks: vendor_monoisotopic(spectra),
    "refined": lambda spectra, peaks: refined(spectra, peaks).select("id", F.col("refined_mz").alias("precursor_mz")),
}


def estimated(spectra: DataFrame, peaks: DataFrame, name: str = "main") -> DataFrame:
    """The named estimator's m/z, the header's where it has none, 0.0 where that is null too."""
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator {name}; one of {', '.join(ESTIMATORS)}")
    own = ESTIMATORS[name](spectra, peaks).toDF("id", "__mz")
    return main_precursor(spectra).join(own, "id", "left").select("id", F.coalesce("__mz", "precursor_mz", F.lit(0.0)).alias("precursor_mz"))


def fragment_errors(peaks: DataFrame, spectra: DataFrame, ppm: float = 50.0) -> DataFrame:
    """For each level 2 spectrum with one of the y1 ions: id, time, intensity and ppm error of the more intense of the
    two (R wins a tie), each being the peak nearest to its m/z within ppm."""
    parts = []
    for rank, mz in ((0, Y1_K), (1, Y1_R)):
        tolerance = mz * ppm / 1e6
        own = peaks.where(F.col("mz").between(mz - tolerance, mz + tolerance)).withColumn("d", F.abs(F.col("mz") - mz)).where(F.col("d") <= tolerance)
        best = own.groupBy("spectrum_id").agg(F.min(F.struct("d", "mz", "intensity")).alias("b"))
        parts.append(best.select("spectrum_id", F.struct("b.intensity", F.lit(rank).alias("rank"), ((F.col("b.mz") - mz) * 1e6 / mz).alias("error")).alias("ion")))
    both = parts[0].unionByName(parts[1]).groupBy("spectrum_id").agg(F.max("ion").alias("ion"))
    ms2 = spectra.where(F.col("ms_level") == 2).select("id", "time")
    return both.join(ms2, F.col("spectrum_id") == F.col("id")).select("id", "time", "ion.intensity", "ion.error")


def calibration_points(errors: DataFrame, every: int = 100, slots: int = 201, top: int = 100, least: int = 5) -> DataFrame:
    """Each `every` spectra (in time order) the last `slots` are looked at: of the `top` most intense, those within one
    and a half interquartile ranges of the quartiles (strictly), and of these the middle one by error. checkpoint,
    time, error. Spectra are copied to the checkpoints they belong to, at most slots / every + 1 of them."""
    numbered = row_numbers(errors, ["time", "id"], "ordinal")
    first = F.ceil(F.col("ordinal") / every)
    member = numbered.withColumn("checkpoint", F.explode(F.sequence(first, F.floor((F.col("ordinal") + slots - 1) / every)))).where(F.col("ordinal") > F.col("checkpoint") * every - slots)
    member = member.where(F.col("checkpoint") <= errors.count() // every)
    by = lambda *c: Window.partitionBy("checkpoint").orderBy(*c)
    best = member.withColumn("__r", F.row_number().over(by(F.desc("intensity"), "ordinal"))).where(F.col("__r") <= top)
    n = F.count("*").over(Window.partitionBy("checkpoint"))
    best = best.withColumns({"__e": F.row_number().over(by("error", "ordinal")) - 1, "__n": n})
    whole = Window.partitionBy("checkpoint")
    quarter = lambda k: F.max(F.when(F.col("__e") == F.floor(k * F.col("__n") / 4), F.col("error"))).over(whole)
    best = best.withColumns({"__q1": quarter(1), "__q3": quarter(3)})
    reach = 1.5 * (F.col("__q3") - F.col("__q1"))
    kept = best.where((F.col("__n") >= least) & (F.col("error") > F.col("__q1") - reach) & (F.col("error") < F.col("__q3") + reach))
    kept = kept.withColumns({"__k": F.row_number().over(by("error", "ordinal")) - 1, "__m": F.count("*").over(whole)})
    return kept.where(F.col("__k") == F.floor(F.col("__m") / 2)).select("checkpoint", "time", "error")


def trimmed(points: DataFrame) -> DataFrame:
    """Without the first and the last point, if there are more than ten (one row a checkpoint: a small window)."""
    n = F.count("*").over(Window.partitionBy())
    own = points.withColumns({"__n": n, "__k": F.row_number().over(Window.orderBy("checkpoint"))})
    return own.where((F.col("__n") <= 10) | ((F.col("__k") > 1) & (F.col("__k") < F.col("__n")))).drop("__n", "__k")


def calibrated(precursors: DataFrame, points: DataFrame, least: int = 10) -> DataFrame:
    """precursors (id, time, mz) with calibrated_mz: the ppm error at their time, from the line through the points (time,
    error), taken off; unchanged with fewer than least points."""
    known = interpolated(precursors, "time", points, "time", "error", "__ppm")
    if points.count() < least:
        return precursors.withColumn("calibrated_mz", F.col("mz"))
    return known.select(*precursors.columns, (F.col("mz") - F.col("mz") * F.col("__ppm") / 1e6).alias("calibrated_mz"))


def precursor_rule(mono: Column, average: Column) -> Column:
    """The monoisotopic m/z where it is known, else the average one."""
    return F.coalesce(mono, average)
