"""Metadata of one vendor's ion mobility runs: tables of a SQLite file, columns by name.

Peaks come from the vendor's own library, which isn't part of this engine; the contract for them is a frame of
(frame_id, first_scan, last_scan, mz array, intensity array), which operators.ingest turns into spectra.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.functions.dates import offset_time
from peakloom.operators import ingest
from peakloom.sources import sqlite
from peakloom.sources.store import RunInfo


@dataclass(frozen=True)
class ReaderConfig:
    """How frames become spectra: survey scans only, clustering tolerance, and the fewest peaks a spectrum needs."""

    ms1_only: bool = False
    mz_tol_ppm: float = 10.0
    min_data_points: int = 1


def _named(column: str, names: dict[int, str]):
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, F.col(column).cast("int")), F.lit("UNKNOWN"))


def frames(spark: SparkSession, path: str) -> DataFrame:
    """The frame table with the names of its scan mode and kind."""
    return sqlite.table(spark, path, "Frames").withColumns({"scan_mode": _named("ScanMode", ingest.SCAN_MODES), "msms_type": _named("MsMsType", ingest.MSMS_TYPES)})


def precursors(spark: SparkSession, path: str) -> DataFrame:
    return sqlite.table(spark, path, "Precursors")


def msms_frames(spark: SparkSession, path: str) -> DataFrame:
    return sqlite.table(spark, path, "FrameMsMsInfo")


def pasef_windows(spark: SparkSession, path: str) -> DataFrame:
    return sqlite.table(spark, path, "PasefFrameMsMsInfo")


def spectra(spark: SparkSession, path: str, raw: DataFrame, config: ReaderConfig = ReaderConfig()) -> DataFrame:
    """Headers of a run joined to its raw peaks: survey frames are clustered, spectra with too few peaks dropped. Windows
    without a frame or the other way round don't match and are left out."""
    heads = ingest.frame_headers(frames(spark, path), pasef_windows(spark, path), precursors(spark, path))
    heads = heads.where("ms_level = 1") if config.ms1_only else heads
    own = raw.select(F.col("frame_id").alias("__f"), F.col("first_scan").alias("__s"), "mz", "intensity")
    joined = heads.join(own, (F.col("frame_id") == F.col("__f")) & ((F.col("ms_level") == 1) | (F.col("first_scan") == F.col("__s")))).drop("__f", "__s")
    joined = joined.withColumn("spectrum_id", F.xxhash64("frame_id", "first_scan"))
    done = ingest.clustered(joined.where("ms_level = 1"), config.mz_tol_ppm).select(F.col("spectrum_id").alias("__id"), F.col("mz").alias("__mz"), F.col("intensity").alias("__i"))
    both = joined.join(done, F.col("spectrum_id") == F.col("__id"), "left")
    out = both.withColumns({"mz": F.coalesce("__mz", "mz"), "intensity": F.coalesce("__i", "intensity")}).drop("__id", "__mz", "__i", "spectrum_id")
    return out.where(F.size("mz") >= max(1, config.min_data_points))


def run_info(spark: SparkSession, path: str, name: str = "run", converter: tuple[str, str] = ("peakloom", "1")) -> RunInfo:
    """What a store of the run says about it (sources.store.write): the vendor's software and the converter, the sample, the
    instrument, the start; plain values for what the file lacks. The mode is SWATH where frames of that kind exist."""
    row = run_metadata(spark, path).first()
    modes = {r[0] for r in frames(spark, path).select("msms_type").distinct().collect()}
    software = ((row["software"] or "acquisition", row["software_version"] or ""), converter)
    start = row["start"].strftime("%Y-%m-%dT%H:%M:%SZ") if row["start"] else None
    mode = "SWATH" if "DIA" in modes else "DDA" if "PASEF" in modes else "UNKNOWN"
    return RunInfo(name, start, mode, row["sample"] or "sample", row["instrument"] or "instrument", software, (path.rpartition("/")[2], path.rpartition("/")[0]), ("acquisition", "conversion"))


def run_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row on the run from the key and value table: instrument, software, sample, start (null if it can't be read)."""
    kv = sqlite.key_values(sqlite.table(spark, path, "GlobalMetadata"))
    row = [(kv.get("InstrumentName"), kv.get("AcquisitionSoftware"), kv.get("AcquisitionSoftwareVersion"), kv.get("SampleName"), kv.get("AcquisitionDateTime"))]
    df = spark.createDataFrame(row, "instrument string, software string, software_version string, sample string, start string")
    return df.withColumn("start", offset_time(F.col("start")))
