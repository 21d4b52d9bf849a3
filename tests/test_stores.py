"""Whole runs: stores written and read back, instrument metadata, SQL views."""

from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from peakloom.functions import cv, dates, xmlparams
from peakloom.operators import precursor, tiling, xic
from peakloom.plans import adapters, sql
from peakloom.sources import sqlite, store, storeschema, tdf
from peakloom.sources.codec import Encoding


@pytest.mark.parametrize("encoding", [Encoding(64, 64), Encoding(64, 32, big_endian=True)])
def test_store_round_trip(spark, sf, tmp_path, encoding):
    spectra = adapters.spectra(spark, sf).where("id < 80")
    peaks = adapters.peaks(spark, sf).where("spectrum_id < 80")
    path = str(tmp_path / "run.sqlite")
    store.write(spectra, peaks, path, encoding)
    rows = lambda df: sorted((r.spectrum_id, r.mz, r.intensity) for r in df.collect())
    assert rows(store.peaks(spark, path)) == rows(peaks)
    assert rows(store.peaks(spark, path, 100.0, 500.0)) == rows(peaks.where("mz between 100 and 500"))
    assert store.headers(spark, path).count() == peaks.select("spectrum_id").distinct().count()
    assert store.headers(spark, path).where("ms_level = 1 and main_precursor_mz is not null").count() == 0
    assert store.model_version(spark, path) == "0.7"
    tree = store.header(spark, path).select(store.tile_sizes(xmlparams.param_tree(F.col("param_tree"))).alias("s")).first().s
    assert tuple(tree) == (5.0, 10_000.0, 15.0, 0.0)
    with sqlite3.connect(path) as db:
        levels = "SELECT count(*) FROM bounding_box b JOIN run_slice s ON b.run_slice_id = s.id WHERE s.ms_level = "
        assert db.execute("SELECT count(*) FROM bounding_box_rtree").fetchone() == db.execute(levels + "1").fetchone() > (0,)
        assert db.execute("SELECT count(*) FROM bounding_box_rtree r JOIN bounding_box b ON b.id = r.id JOIN run_slice s ON b.run_slice_id = s.id WHERE s.ms_level <> 1").fetchone() == (0,)
        assert db.execute("SELECT count(*) FROM bounding_box_msn_rtree").fetchone() == (0,) < db.execute(levels + "2").fetchone()
    with pytest.raises(sqlite3.OperationalError):
        store.write(spectra, peaks, path, encoding)


def test_dia_store(spark, sf, tmp_path):
    """Sizes by level, windows, half widths, cycles, first spectra, metadata and XML columns, all read back."""
    spectra = adapters.with_cycle(adapters.spectra(spark, sf)).where("id < 400")
    scan = f'<scanList><scan><cvParam accession="{cv.SCAN_START_TIME}" value="2.5" unitAccession="{cv.MINUTES}"/></scan></scanList>'
    spectra = spectra.withColumns({"scan_list": F.lit(scan), "param_tree": F.lit(f'<params><cvParams><cvParam accession="{cv.MS_LEVEL}" value="2"/></cvParams></params>'), "title": F.concat(F.lit("t"), F.col("id"))})
    peaks = adapters.peaks(spark, sf).where("spectrum_id < 400")
    path, info = str(tmp_path / "dia.sqlite"), store.RunInfo("r<1>", "2020-01-02T03:04:05Z", "SWATH", "s & co", "i", (("aa", "1.0"), ("Own2MzTest", "0.9")), ("f.raw", "/x"), ("a", "b", "a"))
    store.write(spectra, peaks, path, Encoding(64, 64, fitted=True), info=info, header_table="anyname")
    near = lambda df: sorted((r.spectrum_id, r.mz, round(r.lhwhm, 5), round(r.rhwhm, 5)) for r in df.collect())
    assert near(store.peaks(spark, path)) == near(peaks)
    kept = peaks.select("spectrum_id").distinct().count()
    with sqlite3.connect(path) as db:
        one = lambda q: db.execute(q).fetchone()
        assert one("SELECT count(*), max(end_mz - begin_mz) FROM run_slice WHERE ms_level = 1")[1] == 5.0
        assert one("SELECT min(begin_mz), max(end_mz), count(*) FROM run_slice WHERE ms_level = 2") == (0.0, 10_000.0, 1)
        n1, n2 = (one(f"SELECT count(*) FROM bounding_box b JOIN run_slice s ON b.run_slice_id = s.id WHERE s.ms_level = {k}")[0] for k in (1, 2))
        assert one("SELECT count(*) FROM bounding_box_rtree") == (n1,) and one("SELECT count(*), min(min_ms_level), max(max_ms_level) FROM bounding_box_msn_rtree") == (n2, 2.0, 2.0)
        assert one("SELECT max(max_time - min_time) FROM bounding_box_rtree")[0] <= 15.0
        assert one("SELECT count(*) FROM spectrum s JOIN bounding_box b ON s.bb_first_spectrum_id = b.first_spectrum_id WHERE s.id BETWEEN b.first_spectrum_id AND b.last_spectrum_id")[0] >= kept
        assert one("SELECT count(*) FROM spectrum WHERE bb_first_spectrum_id IS NULL OR cycle IS NULL") == (0,)
        assert len(db.execute("SELECT name FROM sqlite_master WHERE type = 'index' AND name LIKE '%_idx'").fetchall()) == len(storeschema.INDEXES)
    heads = store.headers(spark, path)
    want = spectra.join(peaks.select(F.col("spectrum_id").alias("id")).distinct(), "id")
    assert {(r.id, r.cycle, r.time, r.ms_level, r.title) for r in heads.collect()} == {(r.id, r.cycle, r.time, r.ms_level, r.title) for r in want.collect()}
    tic = {r.spectrum_id: r.t for r in peaks.groupBy("spectrum_id").agg(F.sum("intensity").alias("t")).collect()}
    assert {r.id: r.tic for r in heads.collect()} == tic
    params = store.spectrum_params(spark, path).first()
    assert params.scan.time == 150.0 and params.params.cv[0]["_value"] == "2" and params.precursor is None
    assert store.spectrum_xml(spark, path).columns == ["id", *store.XML_COLUMNS]
    run = store.run_metadata(spark, path).first()
    assert (run.run, run.start, run["mode"], run["sample"], run.instrument, run.source_file, run.location) == ("r<1>", info.start, "SWATH", "s & co", "i", "f.raw", "/x")
    assert [x["version"] for x in run.software] == ["1.0", "0.9"] and [x["name"] for x in run.processing] == ["a", "b", "a"]
    assert store.software_version(spark, path, "mztest") == "0.9" and store.software_version(spark, path, "none") is None
    assert store.model_version(spark, path) == "0.7" and store.header(spark, path).select(store.lossless(xmlparams.param_tree(F.col("param_tree")))).first()[0] is True
    assert store.tile(spark, path, 1).count() == 1 and store.tile(spark, path, 10**6).count() == 0
    assert store.tile_first_spectrum(spark, path, 5).first()[0] <= 5
    # the results of a store are those of the tables it was written from
    a = xic.xic(store.peaks(spark, path), want, 500.0, 100.0)
    b = xic.xic(peaks, spectra, 500.0, 100.0)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_lossless_flag(spark):
    xml = lambda name, v: f'<params><userParams><userParam name="{name}" value="{v}"/></userParams></params>'
    rows = spark.createDataFrame([(xml("is_lossless", "false"),), (xml("is_no_loss", "false"),), (xml("is_lossless", "true"),), (xml("x", "y"),)], "x string")
    assert [r[0] for r in rows.select(store.lossless(xmlparams.param_tree(F.col("x")))).collect()] == [False, False, True, True]


def test_mixed_encodings(spark, tmp_path):
    path = str(tmp_path / "x.sqlite")
    from peakloom.sources.codec import encode

    import numpy as np

    a, b = Encoding(64, 32), Encoding(32, 32, fitted=True)
    one, two = np.zeros(1, a.peak), np.zeros(2, b.peak)
    one["mz"], two["mz"], two["lhwhm"] = 1.5, [2.5, 3.5], 0.25
    with sqlite3.connect(path) as db:
        db.executescript(storeschema.ddl("header"))
        db.executemany("INSERT INTO data_encoding VALUES (?, ?, 'none', 'little_endian', ?, ?, NULL)", [(1, "centroid", 64, 32), (2, "fitted", 32, 32)])
        db.executescript("DROP TABLE spectrum; CREATE TABLE spectrum (id INTEGER PRIMARY KEY, data_encoding_id INTEGER)")
        db.executemany("INSERT INTO spectrum (id, data_encoding_id) VALUES (?, ?)", [(1, 1), (2, 2), (3, 1)])
        db.execute("INSERT INTO bounding_box VALUES (1, ?, 1, 1, 3)", (encode([(1, one), (2, two), (3, one[:0])], {1: a, 2: b, 3: a}),))
    assert sorted((r.spectrum_id, r.mz, r.lhwhm) for r in store.peaks(spark, path).collect()) == [(1, 1.5, 0.0), (2, 2.5, 0.25), (2, 3.5, 0.25)]


def test_acquisition_mode(spark):
    xml = lambda v: f'<params><cvParams><cvParam accession="{cv.ACQUISITION_PARAMETER}" value="{v}"/></cvParams></params>'
    rows = spark.createDataFrame([(xml("DDA acquisition"),), (xml("odd"),), ("<params/>",), (None,)], "x string")
    assert [r[0] for r in rows.select(store.acquisition_mode(xmlparams.param_tree(F.col("x")))).collect()] == ["DDA", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


def test_tdf(spark, tmp_path):
    path = str(tmp_path / "analysis.tdf")
    with sqlite3.connect(path) as db:
        db.executescript(
            """CREATE TABLE Frames (Id INTEGER, Time REAL, ScanMode INTEGER, MsMsType INTEGER, NumPeaks INTEGER, MaxIntensity INTEGER);
            INSERT INTO Frames VALUES (1, 1.0, 8, 0, 2, 7), (2, 2.0, 8, 8, 2, 9), (3, 3.0, 9, 9, 1, 1);
            CREATE TABLE Precursors (Id INTEGER, MonoisotopicMz REAL, AverageMz REAL, Charge INTEGER); INSERT INTO Precursors VALUES (5, NULL, 500.5, NULL), (6, 600.1, 600.5, 2);
            CREATE TABLE PasefFrameMsMsInfo (Frame INTEGER, ScanNumBegin INTEGER, ScanNumEnd INTEGER, Precursor INTEGER); INSERT INTO PasefFrameMsMsInfo VALUES (2, 10, 20, 5), (2, 30, 40, 6);
            CREATE TABLE FrameMsMsInfo (Frame INTEGER, Parent INTEGER);
            CREATE TABLE GlobalMetadata (Key TEXT, Value TEXT); INSERT INTO GlobalMetadata VALUES ('InstrumentName', 'i'), ('AcquisitionDateTime', '2020-01-02T03:04:05.678+01:00');"""
        )
    assert [(r.Id, r.scan_mode, r.msms_type) for r in tdf.frames(spark, path).orderBy("Id").collect()] == [(1, "PASEF", "MS"), (2, "PASEF", "PASEF"), (3, "DIA", "DIA")]
    raw = spark.createDataFrame([(1, 0, 0, [100.0, 100.0005], [1.0, 3.0]), (2, 10, 20, [50.0], [1.0]), (2, 30, 40, [], [])], "frame_id long, first_scan int, last_scan int, mz array<double>, intensity array<double>")
    got = tdf.spectra(spark, path, raw).orderBy("time").collect()
    assert [(r.title, r.ms_level, r.precursor_mz, len(r.mz)) for r in got] == [("Frame=1", 1, None, 1), ("Frame=2 scans 10-20", 2, 500.5, 1)] and abs(got[1].time - 2.001) < 1e-9
    assert tdf.spectra(spark, path, raw, tdf.ReaderConfig(ms1_only=True)).count() == 1
    meta = tdf.run_metadata(spark, path).first()
    assert meta.instrument == "i" and meta.start is not None and meta["sample"] is None
    info = tdf.run_info(spark, path, "r")
    assert (info.name, info.start, info.acquisition_mode, info.sample, info.instrument, len(info.software)) == ("r", "2020-01-02T02:04:05Z", "SWATH", "sample", "i", 2)


def test_dates(spark):
    row = spark.createDataFrame([("2015-02-05T19:30:47Z", "bad")], "a string, b string").select(dates.utc_text(dates.utc_time(F.col("a"))), dates.utc_time(F.col("b")), dates.offset_time(F.col("b"))).first()
    assert tuple(row) == ("2015-02-05T19:30:47Z", None, None)


def test_xml_estimators(spark):
    ion = f'<precursorList><precursor><selectedIonList><selectedIon><cvParam accession="{cv.SELECTED_ION_MZ}" value="445.5"/></selectedIon></selectedIonList></precursor></precursorList>'
    scan = '<scanList><scan><userParam name="[Thermo Trailer Extra]Monoisotopic M/Z:" value="445.25"/></scan></scanList>'
    rows = spark.createDataFrame([(1, 1.0, 2, 400.0, 500.0, ion, scan), (2, 2.0, 2, 400.0, 500.0, None, scan.replace("445.25", "0"))], "id long, time double, ms_level int, iso_min double, iso_max double, precursor_list string, scan_list string")
    got = lambda name: [r.precursor_mz for r in precursor.estimated(rows, rows, name).orderBy("id").collect()]
    assert got("selected_ion") == [445.5, 450.0] and got("vendor") == [445.25, 450.0]


def test_histogram_file(spark, sf, tmp_path):
    h = tiling.dia_histogram(adapters.peaks(spark, sf), adapters.spectra(spark, sf), 50.0)
    tiling.write_histogram(h, str(tmp_path / "h"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "h")).count() == h.count()


def test_run_layout_prunes(spark, sf, tmp_path):
    tiling.write_run(tiling.tiled(adapters.peaks(spark, sf), adapters.spectra(spark, sf)), str(tmp_path / "run"))
    back = spark.read.parquet(str(tmp_path / "run"))
    assert back.count() == adapters.peaks(spark, sf).count()
    plan = back.where("ms_level = 1 and mz_bin between 10 and 20")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ms_level" in plan and "GreaterThanOrEqual(mz_bin" in plan


def test_xic_on_a_laid_out_run(spark, sf, tmp_path):
    peaks, spectra = adapters.peaks(spark, sf), adapters.spectra(spark, sf)
    tiling.write_run(tiling.tiled(peaks, spectra), str(tmp_path / "run"))
    laid = spark.read.parquet(str(tmp_path / "run"))
    for window in ((450.0, 550.0, 20.0, 200.0), (450.0, 550.0, None, 0.0)):
        want = xic.peaks_in_range(peaks, spectra, *window).select("spectrum_id", "time", "mz", "intensity").collect()
        got = xic.peaks_in_range(laid, spectra, *window)
        assert sorted(map(tuple, got.select("spectrum_id", "time", "mz", "intensity").collect())) == sorted(map(tuple, want)) and want
    plan = xic.xic(laid, spectra, 500.0, 50.0)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(mz_bin,110)" in plan and "PartitionFilters: [isnotnull(ms_level" in plan and "lhwhm" not in plan


def test_sql_views(spark, sf):
    sql.register(spark, sf)
    n = sql.query(spark, "SELECT count(*) FROM v_spectrum WHERE ms_level = :level AND time <= :until", level=1, until=100.0)
    assert sql.single(n) == 101 and sql.single(sql.query(spark, "SELECT id FROM v_spectrum WHERE id < 0")) is None


def test_store_in_parts(spark, sf, tmp_path):
    """Parts are stores of whole time rows that read as the one file does, tile for tile."""
    spectra, peaks = adapters.spectra(spark, sf).where("id < 400"), adapters.peaks(spark, sf).where("spectrum_id < 400")
    info, one, many = store.RunInfo("own", acquisition_mode="SWATH"), str(tmp_path / "one.sqlite"), str(tmp_path / "parts")
    store.write(spectra, peaks, one, Encoding(64, 64, fitted=True), info=info)
    assert len(store.write_parts(spectra, peaks, many, Encoding(64, 64, fitted=True), info=info, part_peaks=200)) > 3
    for name in ("spectrum", "run_slice", "software"):
        assert sorted(map(tuple, store.table(spark, many, name).collect())) == sorted(map(tuple, store.table(spark, one, name).collect()))
    tiles = lambda path: store.table(spark, path, "bounding_box").collect()
    own, whole = tiles(many), tiles(one)
    assert sorted((bytes(t.data), *t[2:]) for t in own) == sorted((bytes(t.data), *t[2:]) for t in whole) and len({t.id for t in own}) == len(own)
    for a, b in ((-1, -1), (100.0, 500.0), (300.0, -1)):
        assert sorted(map(tuple, store.peaks(spark, many, a, b).collect())) == sorted(map(tuple, store.peaks(spark, one, a, b).collect()))
    assert sorted(map(tuple, store.peaks(spark, many).collect())) == sorted(map(tuple, peaks.select("spectrum_id", "mz", "intensity", F.col("lhwhm").cast("float").cast("double"), F.col("rhwhm").cast("float").cast("double")).collect()))
    assert store.run_metadata(spark, many).first().run == "own" and store.tile(spark, many, own[-1].id).count() == 1
    with pytest.raises(FileExistsError):
        store.write_parts(spectra, peaks, many)
    empty = store.write_parts(spectra, peaks.where("false"), str(tmp_path / "empty"))
    assert len(empty) == 1 and store.peaks(spark, str(tmp_path / "empty")).count() == store.headers(spark, empty[0]).count() == 0


@pytest.mark.parametrize("encoding", [Encoding(64, 32), Encoding(32, 32, fitted=True, big_endian=True)])
def test_tiles_at_once(encoding):
    import numpy as np

    from peakloom.sources.codec import decode, decode_tiles_at_once, encode, encode_tiles

    ids, starts, lengths = np.array([5, 7, 9, 4]), np.array([0, 3]), np.array([3, 1])
    tile, place = np.array([1, 0, 0, 0, 2]), np.array([1, 2, 0, 2, 0])
    peaks = np.zeros(5, encoding.peak)
    peaks["mz"], peaks["intensity"] = [3.0, 2.5, 1.0, 1.5, 8.0], [1, 2, 3, 4, 5]
    own = encode_tiles(tile, place, peaks, np.array([0, 0, 1]), starts, lengths, ids, encoding)
    none = peaks[:0]
    assert [bytes(b) for b in own] == [encode(x, encoding) for x in ([(5, peaks[2:3]), (7, none), (9, peaks[[3, 1]])], [(5, none), (7, peaks[:1]), (9, none)], [(4, peaks[4:])])]
    for limits in ((-1, -1), (1.5, 3.0), (2.0, -1)):
        want = [(i, tuple(p)) for b in own for i, ps in decode(bytes(b), encoding, *limits) for p in ps]
        got_ids, got = decode_tiles_at_once([bytes(b) for b in own], encoding, *limits)
        assert sorted(zip(got_ids.tolist(), map(tuple, got), strict=True)) == sorted(want)
    with pytest.raises(ValueError):
        decode_tiles_at_once([bytes(own[0])[:-4]], encoding)
