"""Scan filter strings and spectrum XML of one vendor's instruments, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scan_filter(text: Column) -> Column:
    """analyzer (first word), level (digit after "ms", 1 without one), targets (m/z, activation, energy; null if none)
    and the m/z range (0 where it isn't given). Null for null."""
    analyzer = F.regexp_extract(text, r"^\s*(\S+)", 1)
    level = F.coalesce(F.regexp_extract(text, r"\bms(\d+)\b", 1).try_cast("int"), F.lit(1))
    pattern = r"(\d+(?:\.\d+)?)@([a-zA-Z]+)(\d+(?:\.\d+)?)"
    parts = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    zipped = F.arrays_zip(parts(1).alias("mz"), parts(2).alias("activation"), parts(3).alias("energy"))
    targets = F.transform(zipped, lambda t: F.struct(t["mz"].cast("double").alias("mz"), t["activation"].alias("activation"), t["energy"].cast("double").alias("energy")))
    end = lambda k: F.coalesce(F.regexp_extract(text, r"\[(\d+(?:\.\d+)?)-(\d+(?:\.\d+)?)", k).try_cast("double"), F.lit(0.0))
    return F.when(
        text.isNotNull(),
        F.struct(analyzer.alias("analyzer"), level.alias("level"), F.when(F.size(targets) > 0, targets).alias("targets"), end(1).alias("min_mz"), end(2).alias("max_mz")),
    )


def spectrum_parts(xml: Column) -> Column:
    """A spectrum element as title (its first quoted value), params (the elements before its lists), scan_list and
    precursor (the list's wrapper removed)."""
    part = lambda p: F.when(F.regexp_extract(xml, p, 0) != "", F.regexp_extract(xml, p, 1))
    return F.struct(
        F.regexp_extract(xml, r'"([^"]*)"', 1).alias("title"),
        F.regexp_extract(xml, r"(?s)^\s*<spectrum[^>]*>(.*?)(?:<scanList|<precursorList|</spectrum>)", 1).alias("params"),
        part(r"(?s)(<scanList.*?</scanList>)").alias("scan_list"),
        part(r"(?s)<precursorList[^>]*>(.*?)</precursorList>").alias("precursor"),
    )
