"""mzML: spectra by Spark's XML reader, metadata on the driver."""

from __future__ import annotations

import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakloom.functions import cv
from peakloom.operators.order import running_sums

_CV = "cvParam array<struct<_accession:string,_name:string,_value:string,_unitAccession:string>>"
_C = _CV.replace(" ", ":", 1)
SPECTRUM = (
    f"_index long, _id string, {_CV}, scanList struct<scan:array<struct<{_C}>>>, "
    f"precursorList struct<precursor:array<struct<isolationWindow:struct<{_C}>,selectedIonList:struct<selectedIon:array<struct<{_C}>>>,activation:struct<{_C}>>>>, "
    f"binaryDataArrayList struct<binaryDataArray:array<struct<{_C},binary:string>>>"
)


def _value(params, accession: str):
    return F.get(F.filter(params, lambda p: p["_accession"] == accession), 0)["_value"]


def spectra(spark: SparkSession, path: str) -> DataFrame:
    """Spectra of mzML files, every one of them: index, native_id, ms_level, time (seconds), precursor_mz, charge, mz and
    intensity arrays. Arrays of 32 and 64 bits, plain or zlib compressed, are unpacked."""
    raw = spark.read.format("xml").option("rowTag", "spectrum").schema(SPECTRUM).load(path)
    scan = F.get("scanList.scan", 0)["cvParam"]
    start = F.get(F.filter(scan, lambda p: p["_accession"] == cv.SCAN_START_TIME), 0)
    ion = F.get(F.get("precursorList.precursor", 0)["selectedIonList"]["selectedIon"], 0)["cvParam"]
    rows = raw.select(
        F.col("_index").alias("index"),
        F.col("_id").alias("native_id"),
        F.coalesce(_value(F.col("cvParam"), cv.MS_LEVEL).try_cast("int"), F.when(ion.isNotNull(), 2).otherwise(1)).alias("ms_level"),
        (start["_value"].try_cast("double") * F.when(start["_unitAccession"] == cv.MINUTES, 60.0).otherwise(1.0)).alias("time"),
        _value(ion, cv.SELECTED_ION_MZ).try_cast("double").alias("precursor_mz"),
        _value(ion, cv.CHARGE_STATE).try_cast("int").alias("charge"),
        F.transform("binaryDataArrayList.binaryDataArray", lambda a: F.struct(F.transform(a["cvParam"], lambda p: p["_accession"]).alias("kinds"), F.unbase64(F.regexp_replace(a["binary"], r"\s", "")).alias("data"))).alias("arrays"),
    )

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = {cv.MZ_ARRAY: [], cv.INTENSITY_ARRAY: []}
            for arrays in f["arrays"]:
                own = {k: [] for k in out}
                for a in [] if arrays is None else arrays:
                    kinds, data = set(a["kinds"]), a["data"] or b""
                    data = zlib.decompress(data) if cv.ZLIB in kinds and data else bytes(data)
                    for k in out:
                        if k in kinds:
                            own[k] = np.frombuffer(data, "<f4" if cv.BITS_32 in kinds else "<f8").astype(float).tolist()
                for k, v in out.items():
                    v.append(own[k])
            yield f.drop(columns="arrays").assign(mz=out[cv.MZ_ARRAY], intensity=out[cv.INTENSITY_ARRAY])

    head = rows.drop("arrays").schema.simpleString()[7:-1].replace(",", ", ").replace(":", " ")
    return rows.mapInPandas(unpack, f"{head}, mz array<double>, intensity array<double>")


def with_cycles(rows: DataFrame, file_col: str | None = None) -> DataFrame:
    """Adds the cycle: how many level 1 spectra came so far in a file, whose headers are a group. Without a file column
    the rows are one run, counted in bins."""
    survey = F.when(F.col("ms_level") == 1, 1).otherwise(0)
    if file_col is None:
        return running_sums(rows, ["index"], {"cycle": survey})
    return rows.withColumn("cycle", F.sum(survey).over(Window.partitionBy(file_col).orderBy("index").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


@dataclass
class Metadata:
    """Lists of records of a file's header; references between them are numbers from 1."""

    samples: list[dict] = field(default_factory=list)
    source_files: list[dict] = field(default_factory=list)
    software: list[dict] = field(default_factory=list)
    instruments: list[dict] = field(default_factory=list)
    processing: list[dict] = field(default_factory=list)
    run: dict = field(default_factory=dict)

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The lists that aren't empty, as small tables."""
        named = {"sample": self.samples, "source_file": self.source_files, "software": self.software, "instrument": self.instruments, "processing_method": self.processing, "run": [self.run] if self.run else []}
        return {k: spark.createDataFrame(pd.DataFrame(v)) for k, v in named.items() if v}


def metadata(text: str) -> Metadata:
    """The header of an mzML document (with or without its spectra, the closing tags may be missing)."""
    out, numbers, stack = Metadata(), {}, []
    parser = ET.XMLPullParser(("start", "end"))
    parser.feed(text)
    plain = lambda e: e.tag.rpartition("}")[2]
    ref = lambda kind, key: numbers.get((kind, key))
    for event, e in parser.read_events():
        tag = plain(e)
        if event == "end":
            stack.pop()
            continue
        stack.append(tag)
        a = e.attrib
        if tag == "spectrumList":
            break
        if tag in ("sample", "software", "sourceFile", "instrumentConfiguration", "dataProcessing"):
            kept = {"sample": out.samples, "software": out.software, "sourceFile": out.source_files, "instrumentConfiguration": out.instruments}.get(tag)
            numbers[tag, a.get("id")] = n = sum(1 for k in numbers if k[0] == tag) + 1
            if kept is not None:
                kept.append({"id": n, "key": a.get("id"), "name": a.get("name") or a.get("id"), **({"version": a.get("version"), "location": a.get("location")} if tag in ("software", "sourceFile") else {})})
        elif tag == "cvParam" and len(stack) > 1 and stack[-2] == "sample" and a.get("accession") in (cv.SAMPLE_NUMBER, cv.SAMPLE_NAME):
            s = out.samples[-1]
            if a["accession"] == cv.SAMPLE_NUMBER or "_number" not in s:
                s["name"] = a.get("value") or s["name"]
        elif tag == "softwareRef" and out.instruments:
            out.instruments[-1]["software_id"] = ref("software", a.get("ref"))
        elif tag == "processingMethod":
            out.processing.append({"number": int(a.get("order", 0)), "data_processing_id": sum(1 for k in numbers if k[0] == "dataProcessing"), "software_id": ref("software", a.get("softwareRef"))})
        elif tag == "run":
            out.run = {"id": 1, "name": a.get("id"), "start": a.get("startTimeStamp"), "instrument_id": ref("instrumentConfiguration", a.get("defaultInstrumentConfigurationRef")), "sample_id": ref("sample", a.get("sampleRef")), "source_file_id": ref("sourceFile", a.get("defaultSourceFileRef"))}
    return out
