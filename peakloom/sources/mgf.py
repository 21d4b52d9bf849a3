"""MGF peak lists: text to rows and back, by column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("TITLE", "PEPMASS", "CHARGE", "ION_MOBILITY", "RTINSECONDS", "RAWSCANS", "SCANS")


def parsed(block: Column) -> Column:
    """One block of text (from BEGIN IONS on) as a struct: fields (map of name to value; a value keeps further =), peaks
    (array of mz, intensity). Comments (#) and empty lines are skipped; unknown fields are kept; of a name that comes
    twice the last counts."""
    own = F.regexp_extract(block, r"(?s)BEGIN IONS[ \t]*\r?\n(.*)", 1)
    lines = F.filter(F.transform(F.split(own, r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#") & (x != "END IONS"))
    named = F.filter(lines, lambda x: x.contains("="))
    pairs = F.transform(named, lambda x: F.struct(F.upper(F.substring_index(x, "=", 1)).alias("key"), F.regexp_extract(x, r"^[^=]*=(.*)$", 1).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    peaks = F.transform(F.filter(lines, lambda x: ~x.contains("=")), lambda x: F.split(x, r"\s+"))
    numbers = F.transform(peaks, lambda p: F.struct(p[0].try_cast("double").alias("mz"), F.get(p, 1).try_cast("double").alias("intensity")))
    return F.struct(F.map_from_entries(last).alias("fields"), F.filter(numbers, lambda p: p["mz"].isNotNull()).alias("peaks"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Spectra of MGF files: fields (map), peaks. Records are split at END IONS by the text reader, so large files are
    read by many tasks; lines outside of blocks are ignored."""
    blocks = spark.read.option("lineSep", "END IONS").text(path).where(F.col("value").contains("BEGIN IONS"))
    return blocks.select(parsed(F.col("value")).alias("s")).select("s.*")


def parent_scan(rawscans: Column) -> Column:
    """The leading number of a RAWSCANS value."""
    return F.regexp_extract(rawscans, r"^\s*(\d+)", 1).try_cast("long")


def pepmass(value: Column) -> Column:
    """The m/z of a PEPMASS value: its first word."""
    return F.regexp_extract(value, r"^\s*(\S+)", 1).try_cast("double")


def charge(value: Column) -> Column:
    """The digits before the + of a CHARGE value."""
    return F.regexp_extract(value, r"(\d+)\+", 1).try_cast("int")


def fixed(value: Column, decimals: int) -> Column:
    """A number of 0 or more rounded half up, with so many decimals, made of whole numbers."""
    whole = F.floor(value * 10**decimals + 0.5).cast("long")
    if decimals == 0:
        return whole.cast("string")
    return F.concat(F.floor(whole / 10**decimals).cast("string"), F.lit("."), F.lpad((whole % 10**decimals).cast("string"), decimals, "0"))


def short(value: Column, decimals: int) -> Column:
    """As fixed(), zeros at the end dropped but for one decimal."""
    return F.regexp_replace(fixed(value, decimals), r"(\.\d+?)0+$", "$1")


def title(first_cycle: Column, first_scan: Column, time: Column, raw_file: Column) -> Column:
    """The title that identification software reads cycle, scan and time (minutes) from."""
    minutes = fixed(time / 60, 4)
    parts = (("first_cycle", first_cycle), ("last_cycle", first_cycle), ("first_scan", first_scan), ("last_scan", first_scan), ("first_time", minutes), ("last_time", minutes), ("raw_file_identifier", raw_file))
    return F.concat(*[x for k, v in parts for x in (F.lit(f"{k}:"), v.cast("string"), F.lit(";"))])


def records(spectra: DataFrame, mz_decimals: int = 3, cutoff: float | None = None) -> DataFrame:
    """Rows (id, title, time, precursor_mz, charge, peaks) as MGF text (id, value). No charge line without a charge; a
    time has 2 decimals with one and 3 without; peaks below cutoff are left out."""
    peaks = F.col("peaks") if cutoff is None else F.filter("peaks", lambda p: p["intensity"] >= cutoff)
    lines = F.array_join(F.transform(peaks, lambda p: F.concat(short(p["mz"], mz_decimals), F.lit(" "), fixed(p["intensity"], 0))), "\n")
    has = F.coalesce(F.col("charge"), F.lit(0)) > 0
    seconds = F.when(has, fixed(F.col("time"), 2)).otherwise(fixed(F.col("time"), 3))
    head = F.concat_ws("\n", F.lit("BEGIN IONS"), F.concat(F.lit("TITLE="), "title"), F.concat(F.lit("PEPMASS="), fixed(F.col("precursor_mz"), 4)), F.when(has, F.concat(F.lit("CHARGE="), F.col("charge").cast("string"), F.lit("+"))), F.concat(F.lit("RTINSECONDS="), seconds), F.concat(F.lit("SCANS="), F.col("id").cast("string")))
    return spectra.select("id", F.concat_ws("\n", head, F.when(lines != "", lines), F.lit("END IONS")).alias("value"))


def write(spectra: DataFrame, path: str, **options) -> None:
    """MGF text files, spectra in the order of ids across files: ranges of ids, each sorted."""
    records(spectra, **options).repartitionByRange("id").sortWithinPartitions("id").select("value").write.text(path, lineSep="\n\n")
