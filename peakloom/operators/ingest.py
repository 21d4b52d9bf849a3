"""From raw frames to spectra: peak clustering, headers of frames, overrides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cluster(mz: np.ndarray, intensity: np.ndarray, ppm: float = 10.0, exclusive: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Greedy clusters of one spectrum, m/z ascending. By falling intensity (lower index first of ties) each peak not
    used so far is an apex; it takes neighbours to the right, then to the left, while they are within ppm of it. Peaks
    that another cluster has used count again, unless exclusive. A cluster is its intensity-weighted mean m/z and its
    highest intensity; the result is by m/z."""
    used = np.zeros(len(mz), bool)
    out = []
    for apex in np.argsort(-intensity, kind="stable"):
        if used[apex]:
            continue
        reach = mz[apex] * ppm / 1e6
        low = high = apex
        while high + 1 < len(mz) and mz[high + 1] - mz[apex] <= reach and not (exclusive and used[high + 1]):
            high += 1
        while low > 0 and mz[apex] - mz[low - 1] <= reach and not (exclusive and used[low - 1]):
            low -= 1
        used[low : high + 1] = True
        w = intensity[low : high + 1]
        total = w.sum()
        out.append(((mz[low : high + 1] * w).sum() / total if total > 0 else mz[apex], intensity[apex]))
    out.sort()
    return np.array([x[0] for x in out]), np.array([x[1] for x in out])


def clustered(spectra: DataFrame, ppm: float = 10.0, exclusive: bool = False) -> DataFrame:
    """Rows (spectrum_id, mz array, intensity array) with each spectrum's peaks clustered; whole spectra are rows, so
    no shuffle is needed. Null arrays count as empty ones."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = [cluster(np.asarray([] if m is None else m, float), np.asarray([] if i is None else i, float), ppm, exclusive) for m, i in zip(f["mz"], f["intensity"], strict=True)]
            yield pd.DataFrame({"spectrum_id": f["spectrum_id"], "mz": [d[0].tolist() for d in done], "intensity": [d[1].tolist() for d in done]})

    return spectra.select("spectrum_id", "mz", "intensity").mapInPandas(run, "spectrum_id long, mz array<double>, intensity array<double>")


def drop_empty(spectra: DataFrame) -> DataFrame:
    """Without spectra that have no peak."""
    return spectra.where(F.size("mz") > 0)


#: Scan modes and kinds of frames of the vendor's tables; fixed values.
SCAN_MODES = {0: "MS", 1: "AUTO_MSMS", 2: "MRM", 3: "IN_SOURCE_CID", 4: "BROADBAND_CID", 8: "PASEF", 9: "DIA", 20: "MALDI"}
MSMS_TYPES = {0: "MS", 2: "MSMS_FRAGMENT", 8: "PASEF", 9: "DIA"}


def frame_headers(frames: DataFrame, windows: DataFrame, precursors: DataFrame) -> DataFrame:
    """Spectra of frames: a survey frame (MsMsType 0) is a level 1 spectrum; each fragment window (Frame, ScanNumBegin,
    ScanNumEnd, Precursor) of a PASEF frame (8) is a level 2 spectrum a ten-thousandth of a second later for each
    scan; its precursor m/z is the monoisotopic one, else the average. Other kinds are left out."""
    ms1 = frames.where("MsMsType = 0").select(F.concat(F.lit("Frame="), F.col("Id").cast("string")).alias("title"), F.col("Id").alias("frame_id"), F.lit(None).cast("int").alias("first_scan"), F.col("Time").alias("time"), F.lit(1).alias("ms_level"), F.lit(None).cast("double").alias("precursor_mz"), F.lit(None).cast("int").alias("precursor_charge"))
    p = precursors.select(F.col("Id").alias("__p"), F.coalesce("MonoisotopicMz", "AverageMz").alias("precursor_mz"), F.col("Charge").cast("int").alias("precursor_charge"))
    w = windows.join(frames.where("MsMsType = 8").select(F.col("Id").alias("__f"), "Time"), F.col("Frame") == F.col("__f")).join(p, F.col("Precursor") == F.col("__p"), "left")
    title = F.format_string("Frame=%d scans %d-%d", F.col("Frame").cast("long"), F.col("ScanNumBegin").cast("long"), F.col("ScanNumEnd").cast("long"))
    ms2 = w.select(title.alias("title"), F.col("Frame").alias("frame_id"), F.col("ScanNumBegin").cast("int").alias("first_scan"), (F.col("Time") + F.col("ScanNumBegin") / 10_000).alias("time"), F.lit(2).alias("ms_level"), "precursor_mz", "precursor_charge")
    return ms1.unionByName(ms2)


def overridden(survey: DataFrame, own: DataFrame, frame: str = "frame_id") -> DataFrame:
    """Survey spectra (frame_id, time) and, in place of their fragment spectra, those of a peak list (frame_id, rt, ...):
    in the order of rt within a frame, each a thousandth of a second later. frame_id, time, ms_level, rank."""
    place = F.row_number().over(Window.partitionBy(frame).orderBy("rt", "title")) - 1
    parents = survey.select(F.col(frame).alias("__f"), F.col("time").alias("__t"))
    ms2 = own.withColumn("rank", place).join(parents, F.col(frame) == F.col("__f")).select(frame, (F.col("__t") + (F.col("rank") + 1) / 1000).alias("time"), F.lit(2).alias("ms_level"), (F.col("rank") + 1).cast("int").alias("rank"))
    return survey.select(frame, "time", F.lit(1).alias("ms_level"), F.lit(0).alias("rank")).unionByName(ms2)


def faims_voltage(filter_string: Column) -> Column:
    """The compensation voltage of a filter string: the value after = of its first token that starts with cv."""
    return F.regexp_extract(filter_string, r"(?:^|\s)cv=([^\s]+)", 1)


def write_by_voltage(spectra: DataFrame, path: str, filter_col: str = "filter") -> None:
    """One folder a compensation voltage (suffix CV and the whole negative voltage); spectra without one go to none."""
    voltage = F.try_to_number(faims_voltage(F.col(filter_col)), F.lit("S999.99")).cast("double")
    spectra.withColumn("faims", F.coalesce(F.concat(F.lit("CV"), (-voltage).cast("int").cast("string")), F.lit("none"))).write.partitionBy("faims").parquet(path)
