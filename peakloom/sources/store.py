"""Tile stores in SQLite: read as headers and peaks, written from them, and what their parameter trees say.

A store holds spectra headers, encodings, run slices and tiles (blobs of the peaks of consecutive spectra in one run
slice). Reading decodes tiles in tasks. One SQLite file takes one writer, so a run is written in parts by tasks, each
a store of some time rows; the readers take a store in one file and one in parts alike. write() puts the parts together
to one file on the driver, which is meant for a run to hand over, while analyses stay on parts or Parquet.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
import tempfile
import uuid
from contextlib import closing
from dataclasses import dataclass
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.functions import cv, xmlparams
from peakloom.operators import tiling
from peakloom.operators.order import bin_by, cuts, running_sums
from peakloom.operators.spectra import base_peak
from peakloom.session import local_folder, shared_folder
from peakloom.sources import sqlite, storeschema, tiles
from peakloom.sources.codec import Encoding, encode_tiles

HEADER_TABLE = "header"


@dataclass(frozen=True)
class RunInfo:
    """What a store says about its run. software: (name, version); processing: names of its steps, each by the software of
    the same place, or the first one."""

    name: str = "run"
    start: str | None = None
    acquisition_mode: str = "UNKNOWN"
    sample: str = "sample"
    instrument: str = "instrument"
    software: tuple[tuple[str, str], ...] = (("peakloom", "1"),)
    source_file: tuple[str, str] = ("", "")
    processing: tuple[str, ...] = ("conversion",)
    components: str = "<componentList/>"
    lossless: bool = True


def headers(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The spectrum table, or some of its columns. A precursor that is NULL stays null."""
    return table(spark, path, "spectrum", columns)


def peaks(spark: SparkSession, path: str, min_mz: float = -1, max_mz: float = -1) -> DataFrame:
    """All peaks of a store: spectrum_id, mz, intensity, lhwhm, rhwhm; in the m/z range if one is given. Each spectrum is
    decoded by its own encoding. Tasks read tiles by ranges of their number, and the encodings where the tiles are."""
    spark.dataSource.register(tiles.TileSource)
    return sqlite.load(spark, "tiles", files(path), "bounding_box").option("min_mz", repr(float(min_mz))).option("max_mz", repr(float(max_mz))).load()


def placed_rows(kept: DataFrame, sizes: tiling.TileSizes, dia: bool) -> DataFrame:
    """id, ms_level, iso_lo, iso_hi and row_start of spectra: the time row that each is in. Level 1 is cut by its own width,
    other levels by theirs; with dia, each isolation window of level 2 has rows of its own. Rows are anchored at their first
    spectrum."""
    first, window = F.col("ms_level") == 1, (F.col("ms_level") == 2) & F.lit(dia)
    own = kept.select("id", "time", "ms_level", F.when(window, F.col("iso_min")).cast("double").alias("iso_lo"), F.when(window, F.col("iso_max")).cast("double").alias("iso_hi"))
    parts = [tiling.anchored_rows(own.where(which), width, ["ms_level", "iso_lo", "iso_hi"]) for which, width in ((first, sizes.time_ms1), (~first, sizes.time_msn))]
    return parts[0].unionByName(parts[1])


def _headers_of(heads: DataFrame) -> DataFrame:
    """The columns of the spectrum table but the last, and the row's; what the run's headers lack gets its plain value."""
    has = lambda name, other, kind: (F.coalesce(F.col(name).cast(kind), other) if name in heads.columns else other).cast(kind)
    null, one = F.lit(None), F.lit(1)
    middle = F.when(F.col("ms_level") > 1, (F.col("iso_min") + F.col("iso_max")) / 2)
    values = {
        "id": F.col("id").cast("long"), "initial_id": has("initial_id", F.col("id"), "long"), "title": has("title", F.concat(F.lit("scan="), F.col("id").cast("string")), "string"), "cycle": F.col("cycle").cast("long"),
        "time": F.col("time").cast("double"), "ms_level": F.col("ms_level").cast("int"), "activation_type": has("activation_type", null, "string"), "tic": F.col("__tic").cast("double"),
        "base_peak_mz": F.col("__base_mz").cast("double"), "base_peak_intensity": F.col("__base_intensity").cast("double"), "main_precursor_mz": has("precursor_mz", middle, "double"), "main_precursor_charge": has("precursor_charge", null, "int"),
        "data_points_count": F.col("__n"), "param_tree": has("param_tree", F.lit("<params/>"), "string"), "scan_list": has("scan_list", null, "string"), "precursor_list": has("precursor_list", null, "string"), "product_list": has("product_list", null, "string"),
        "shared_param_tree_id": one, "instrument_configuration_id": one, "source_file_id": one, "run_id": one, "data_processing_id": one, "data_encoding_id": one,
    }
    return heads.select(*[v.alias(k) for k, v in values.items()], "iso_lo", "iso_hi", "row_start")


def _metadata(db: sqlite3.Connection, info: RunInfo, header_table: str, encoding: Encoding, sizes: tiling.TileSizes) -> None:
    user = lambda name, value, kind: f'<userParam name="{name}" value={quoteattr(str(value))} type="{kind}"/>'
    params = [user(name, getattr(sizes, field), "xsd:float") for field, name in storeschema.SIZE_PARAMS.items()] + [user(storeschema.LOSS_PARAM, str(info.lossless).lower(), "xsd:boolean")]
    db.execute(f'INSERT INTO "{header_table}" VALUES (?, ?, ?, ?, ?)', ("0.7", info.start or "", "<fileContent/>", "", "<params><userParams>" + "".join(params) + "</userParams></params>"))
    db.execute("INSERT INTO data_encoding VALUES (1, ?, 'none', ?, ?, ?, NULL)", ("fitted" if encoding.fitted else "centroid", "big_endian" if encoding.big_endian else "little_endian", encoding.mz_bits, encoding.intensity_bits))
    db.executemany("INSERT INTO software VALUES (NULL, ?, ?, '<params/>', NULL)", info.software)
    names = list(dict.fromkeys(info.processing))
    db.executemany("INSERT INTO data_processing VALUES (NULL, ?)", [(n,) for n in names])
    db.executemany("INSERT INTO processing_method VALUES (NULL, ?, '<params/>', NULL, ?, ?)", [(k, names.index(n) + 1, min(k, len(info.software))) for k, n in enumerate(info.processing, 1)])
    db.execute("INSERT INTO shared_param_tree VALUES (1, '<params/>', 'CommonInstrumentParams')")
    db.execute("INSERT INTO instrument_configuration VALUES (1, ?, NULL, ?, NULL, 1)", (info.instrument, info.components))
    db.execute("INSERT INTO sample VALUES (1, ?, NULL, NULL)", (info.sample,))
    db.execute("INSERT INTO source_file VALUES (1, ?, ?, '<params/>', NULL)", info.source_file)
    mode = f'<params><cvParams><cvParam cvRef="MS" accession="{cv.ACQUISITION_PARAMETER}" name="acquisition parameter" value="{info.acquisition_mode} acquisition"/></cvParams></params>'
    db.execute("INSERT INTO run VALUES (1, ?, ?, ?, NULL, 1, 1, 1, 1, 1)", (info.name, info.start, mode))


#: Peaks of a part: what a task sorts and encodes at once.
PART_PEAKS = 200_000


def write_parts(spectra: DataFrame, own_peaks: DataFrame, folder: str, encoding: Encoding = Encoding(64, 64), sizes: tiling.TileSizes = tiling.TileSizes(), info: RunInfo = RunInfo(), header_table: str = HEADER_TABLE, part_peaks: int = PART_PEAKS) -> list[str]:
    """A new store in parts: files in a folder that all machines have mounted, each a store of the time rows that begin in
    its span, written by a task of its own; numbers of tiles and slices are those of the whole run. Gives the files in
    order. Headers and peaks are as in write(). A folder that holds something raises."""
    if os.path.isdir(folder) and os.listdir(folder):
        raise FileExistsError(folder)
    os.makedirs(folder, exist_ok=True)
    dia = info.acquisition_mode == "SWATH"
    spark = spectra.sparkSession
    keep = lambda df, name: _kept(df, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}/{name}")
    if "cycle" not in spectra.columns:
        # of those with peaks
        ids = own_peaks.select("spectrum_id").distinct()
        spectra = running_sums(spectra.join(ids, F.col("id") == F.col("spectrum_id"), "left_semi"), ["id"], {"cycle": F.when(F.col("ms_level") == 1, 1).otherwise(0)})
    sums = base_peak(own_peaks, more={"__n": F.count("*")}).withColumnsRenamed({"spectrum_id": "__s", "tic": "__tic", "base_mz": "__base_mz", "base_intensity": "__base_intensity"})
    kept = keep(spectra.join(sums, F.col("id") == F.col("__s")).drop("__s"), "spectra")
    rows = keep(placed_rows(kept, sizes, dia).withColumnRenamed("id", "__id").drop("time"), "rows")
    width = F.when(F.col("__level") == 1, sizes.mz_ms1).otherwise(sizes.mz_msn)
    wide = [F.col(c).cast("double").alias(c) if c in own_peaks.columns else F.lit(0.0).alias(c) for c in ("lhwhm", "rhwhm")]
    placed = own_peaks.select(F.col("spectrum_id").cast("long").alias("spectrum_id"), F.col("mz").cast("double").alias("mz"), F.col("intensity").cast("double").alias("intensity"), *wide)
    placed = placed.join(rows.select("__id", F.col("ms_level").alias("__level"), "row_start"), F.col("spectrum_id") == F.col("__id"))
    placed = keep(placed.select("spectrum_id", "mz", "intensity", "lhwhm", "rhwhm", F.col("__level").cast("int").alias("ms_level"), "row_start", F.floor(F.col("mz") / width).cast("long").alias("mz_bin")).where("mz_bin is not null"), "peaks")
    # rows whose peaks would fill a part are one
    part = bin_by(F.col("row_start"), sorted(set(cuts(placed, F.col("row_start"), part_peaks))))
    before, numbers = 0, {}
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        numbers[r.part], before = before, before + r["count"]
    slices = [(k, r.ms_level, r.mz_bin) for k, r in enumerate(placed.select("ms_level", "mz_bin").distinct().orderBy("ms_level", "mz_bin").collect(), 1)]
    heads = _headers_of(kept.join(rows.drop("ms_level"), F.col("id") == F.col("__id")))

    def write_one(key: tuple, heads: pa.Table, peaks: pa.Table) -> pa.Table:
        k = key[0].as_py()
        name = f"part-{k:06d}.sqlite"
        with tempfile.TemporaryDirectory() as own:
            _write_file(f"{own}/{name}", heads, peaks, slices, encoding, sizes, info, header_table, dia, numbers.get(k, 0))
            # a task that is run twice puts the same rows in place
            copy = f"{folder}/.{name}-{uuid.uuid4().hex}"
            shutil.copyfile(f"{own}/{name}", copy)
            os.replace(copy, f"{folder}/{name}")
        return pa.table({"part": pa.array([k], pa.int64())})

    done = heads.groupBy(part.alias("part")).cogroup(placed.groupBy(part.alias("part"))).applyInArrow(write_one, "part long").collect()
    if not done:
        _write_file(f"{folder}/part-000000.sqlite", heads.limit(0).toArrow(), placed.limit(0).toArrow(), [], encoding, sizes, info, header_table, dia, 0)
    return files(folder)


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write_file(path: str, heads: pa.Table, peaks: pa.Table, slices: list[tuple[int, int, int]], encoding: Encoding, sizes: tiling.TileSizes, info: RunInfo, header_table: str, dia: bool, before: int) -> None:
    """A store of whole time rows: a tile has a slice of every spectrum of its row, empty ones too. Tiles are numbered after
    before, in the order of their first peak's time, level, window and slice."""
    sizes_of = {1: sizes.mz_ms1}
    width = lambda level: sizes_of.get(level, sizes.mz_msn)
    columns = [c for c in heads.column_names if c not in ("iso_lo", "iso_hi", "row_start", "part")]
    heads = heads.append_column("__row", pa.array(heads.select(["ms_level", "iso_lo", "iso_hi", "row_start"]).to_pandas().groupby(["ms_level", "iso_lo", "iso_hi", "row_start"], dropna=False).ngroup().to_numpy(np.int64)))
    heads = heads.sort_by([("__row", "ascending"), ("id", "ascending")])
    row, ids = heads["__row"].to_numpy(), heads["id"].to_numpy()
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    lengths = np.diff(starts, append=len(row))
    level, times = heads["ms_level"].to_numpy(), heads["time"].to_numpy()
    iso = [heads[c].to_numpy(zero_copy_only=False).astype(float) for c in ("iso_lo", "iso_hi")]
    db = sqlite3.connect(path, isolation_level=None)
    with closing(db):
        db.executescript("PRAGMA journal_mode = OFF; PRAGMA synchronous = OFF; PRAGMA locking_mode = EXCLUSIVE; PRAGMA cache_size = -65536;")
        db.executescript(storeschema.ddl(header_table))
        db.execute("BEGIN")
        _metadata(db, info, header_table, encoding, sizes)
        db.executemany("INSERT INTO run_slice VALUES (?, ?, ?, ?, ?, NULL, 1)", ((n, of, n, float(b * width(of)), float((b + 1) * width(of))) for n, of, b in slices))
        by_id = np.argsort(ids)
        for k in range(0, len(ids), 20_000):
            some = by_id[k : k + 20_000]
            own = heads.select(columns).take(pa.array(some))
            db.executemany(f"INSERT INTO spectrum VALUES ({', '.join('?' * 24)})", zip(*[c.to_pylist() for c in own.columns], ids[starts][row[some]].tolist(), strict=True))
        if len(peaks):
            number = {(of, b): n for n, of, b in slices}
            bins = peaks["mz_bin"].to_numpy()
            low, span = int(bins.min()), int(bins.max()) - int(bins.min()) + 1
            own_level, at_level = np.unique(peaks["ms_level"].to_numpy(), return_inverse=True)
            keys, slice_of = np.unique(at_level * span + (bins - low), return_inverse=True)
            slice_of = np.array([number[(int(own_level[x // span]), x % span + low)] for x in keys.tolist()], np.int64)[slice_of]
            values = np.empty(len(peaks), encoding.peak)
            for c in values.dtype.names:
                values[c] = peaks[c].to_numpy()
            place = by_id[np.searchsorted(ids, peaks["spectrum_id"].to_numpy(), sorter=by_id)]
            tile_keys, tile = np.unique(slice_of * len(starts) + row[place], return_inverse=True)
            tile_slice, tile_row = tile_keys // len(starts), tile_keys % len(starts)
            blobs = encode_tiles(tile, place - starts[row[place]], values, tile_row, starts, lengths, ids, encoding)
            t0, t1 = np.full(len(tile_keys), np.inf), np.full(len(tile_keys), -np.inf)
            np.minimum.at(t0, tile, times[place])
            np.maximum.at(t1, tile, times[place])
            at = starts[tile_row]
            order = np.lexsort((tile_slice, np.nan_to_num(iso[0][at], nan=-np.inf), level[at], t0))
            numbers = np.empty(len(order), np.int64)
            numbers[order] = np.arange(before + 1, before + 1 + len(order))
            firsts, lasts = ids[at], ids[at + lengths[tile_row] - 1]
            rows = lambda where, *more: zip(*[x[where].tolist() for x in (numbers, *more)], strict=True)
            db.executemany("INSERT INTO bounding_box VALUES (?, ?, ?, ?, ?)", zip(numbers[order].tolist(), [blobs[k] for k in order.tolist()], tile_slice[order].tolist(), firsts[order].tolist(), lasts[order].tolist(), strict=True))
            lows = np.array([0.0, *(b * width(of) for _, of, b in slices)])
            highs = np.array([0.0, *((b + 1) * width(of) for _, of, b in slices)])
            lo, hi = lows[tile_slice], highs[tile_slice]
            one = order[level[at][order] == 1]
            db.executemany("INSERT INTO bounding_box_rtree VALUES (?, ?, ?, ?, ?)", rows(one, lo, hi, t0, t1))
            windows = order[(level[at][order] != 1) & ~np.isnan(iso[0][at][order])]
            db.executemany("INSERT INTO bounding_box_msn_rtree VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?)", rows(windows, level[at], level[at], iso[0][at], iso[1][at], lo, hi, t0, t1))
        db.execute("COMMIT")
        db.executescript(storeschema.index_ddl())


def write(spectra: DataFrame, own_peaks: DataFrame, path: str, encoding: Encoding = Encoding(64, 64), sizes: tiling.TileSizes = tiling.TileSizes(), info: RunInfo = RunInfo(), header_table: str = HEADER_TABLE) -> None:
    """A new store of a run: headers (id, time, ms_level, iso_min, iso_max, and any of title, cycle, activation_type,
    precursor_mz, precursor_charge, param_tree, scan_list, precursor_list, product_list) and peaks (spectrum_id, mz, intensity,
    and half widths for a fitted encoding). Tiles of level 1 are indexed by m/z and time, those of level 2 of a
    SWATH run by their isolation window too, others not at all. An existing file raises. The file is put together from
    parts in the shared folder, table by table inside SQLite."""
    with closing(sqlite3.connect(f"file:{path}?mode=rwc", uri=True, isolation_level=None)) as db:
        db.executescript(storeschema.ddl(header_table))
        folder = local_folder(spectra.sparkSession)
        parts = write_parts(spectra, own_peaks, folder, encoding, sizes, info, header_table)
        db.execute("PRAGMA synchronous = OFF")
        for k, part in enumerate(parts):
            db.execute("ATTACH ? AS part", (part,))
            db.execute("BEGIN")
            for name in storeschema.RUN_TABLES if k else (*storeschema.TABLES, header_table):
                db.execute(f'INSERT INTO main."{name}" SELECT * FROM part."{name}"')
            for name in storeschema.RTREES:
                db.execute(f"INSERT INTO main.{name} SELECT * FROM part.{name} ORDER BY id")
            db.execute("COMMIT")
            db.execute("DETACH part")
        db.executescript(storeschema.index_ddl())
    shutil.rmtree(folder)


def files(path: str) -> list[str]:
    """The files of a store: itself, or the parts in its folder."""
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.startswith("part-") and f.endswith(".sqlite")) if os.path.isdir(path) else [path]


def table(spark: SparkSession, path: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A table of a store, or some of its columns: of a store in parts, all rows of those that hold the run's spectra and
    tiles; the others are the same in each part."""
    own = files(path)
    return sqlite.table(spark, own if name in storeschema.RUN_TABLES else own[:1], name, columns=columns)


def tile(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The row of one tile, none if there isn't such a tile."""
    return table(spark, path, "bounding_box").where(F.col("id") == number)


def tile_first_spectrum(spark: SparkSession, path: str, spectrum: int) -> DataFrame:
    """The first spectrum of the tiles that hold a spectrum (bb_first_spectrum_id), none without that spectrum."""
    return headers(spark, path, ["id", "bb_first_spectrum_id"]).where(F.col("id") == spectrum).select("bb_first_spectrum_id")


XML_COLUMNS = ("param_tree", "scan_list", "precursor_list", "product_list")


def spectrum_xml(spark: SparkSession, path: str) -> DataFrame:
    """id and the XML columns of all spectra, as text."""
    return headers(spark, path, ["id", *XML_COLUMNS])


def spectrum_params(spark: SparkSession, path: str) -> DataFrame:
    """id and the parsed XML columns: params, scan and precursor. Only columns that are used are read and parsed."""
    rows = spectrum_xml(spark, path)
    return rows.select("id", xmlparams.param_tree(F.col("param_tree")).alias("params"), xmlparams.scans(F.col("scan_list")).alias("scan"), xmlparams.precursors(F.col("precursor_list")).alias("precursor"))


def run_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The run with what it refers to: run, start, mode, sample, instrument, components, source_file, location, software (all
    of it, as names and versions) and processing (the steps' names in order)."""
    t = lambda name: table(spark, path, name)
    run = t("run").select(F.col("name").alias("run"), F.col("start_timestamp").alias("start"), acquisition_mode(xmlparams.param_tree(F.col("param_tree"))).alias("mode"), "sample_id", "default_instrument_config_id", "default_source_file_id")
    sample = t("sample").select(F.col("id").alias("__a"), F.col("name").alias("sample"))
    instrument = t("instrument_configuration").select(F.col("id").alias("__b"), F.col("name").alias("instrument"), xmlparams.components(F.col("component_list")).alias("components"))
    source = t("source_file").select(F.col("id").alias("__c"), F.col("name").alias("source_file"), "location")
    steps = t("processing_method").join(t("data_processing").select(F.col("id").alias("__d"), "name"), F.col("data_processing_id") == F.col("__d"))
    lists = [t("software").agg(F.sort_array(F.collect_list(F.struct("id", "name", "version"))).alias("software")), steps.agg(F.sort_array(F.collect_list(F.struct("number", "name"))).alias("processing"))]
    out = run.join(sample, F.col("sample_id") == F.col("__a"), "left").join(instrument, F.col("default_instrument_config_id") == F.col("__b"), "left").join(source, F.col("default_source_file_id") == F.col("__c"), "left")
    out = out.withColumn("__k", F.lit(1))
    for one in lists:
        out = out.join(one.withColumn("__k", F.lit(1)), "__k", "left")  # one row each
    return out.select("run", "start", "mode", "sample", "instrument", "components", "source_file", "location", "software", "processing")


def software_version(spark: SparkSession, path: str, ending: str) -> str | None:
    """The version of the first software whose name ends so, in any case: a converter is found by its name."""
    row = table(spark, path, "software").where(F.lower(F.col("name")).endswith(ending.lower())).orderBy("id").select("version").first()
    return row[0] if row else None


def header_table(path: str) -> str:
    """The table that holds a store's version and parameter tree; its name differs between writers, its columns don't."""
    for name in sqlite.tables(files(path)[0]):
        if {"version", "creation_timestamp", "param_tree"} <= set(sqlite.columns(files(path)[0], name)):
            return name
    raise ValueError("no header table")


def header(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, header_table(path))


def model_version(spark: SparkSession, path: str) -> str | None:
    row = header(spark, path).select("version").first()
    return row[0] if row else None


def tile_sizes(tree: Column) -> Column:
    """A header's tile sizes (struct of mz_ms1, mz_msn, time_ms1, time_msn), each by its own name, null where it lacks."""
    return F.struct(*[xmlparams.user_param(tree, v).try_cast("double").alias(k) for k, v in storeschema.SIZE_PARAMS.items()])


def lossless(tree: Column) -> Column:
    """Whether a header says that no peak was left out or fitted: unless one of its params for that is "false"."""
    value = F.coalesce(*[xmlparams.user_param(tree, name) for name in (storeschema.LOSS_PARAM, "is_no_loss")])
    return F.coalesce(value != "false", F.lit(True))


def acquisition_mode(tree: Column) -> Column:
    """A run's acquisition mode: the value of its param if it is a known one, else UNKNOWN."""
    value = xmlparams.cv_param(tree, cv.ACQUISITION_PARAMETER)
    short = F.upper(F.regexp_extract(value, r"^(\w+)", 1))
    return F.when(short.isin(*cv.ACQUISITION_MODES), short).otherwise("UNKNOWN")
