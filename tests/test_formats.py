"""Formats: round trips, hand-made files and odd cases."""

from __future__ import annotations

import base64
import sqlite3
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom import cli
from peakloom.functions import cv, thermo, xmlparams
from peakloom.sources import codec, mgf, mzml, sqlite
from peakloom.streaming.resequence import held, resequenced, time_rows


def test_blob_bytes():
    peaks = np.array([(100.0, 5.0)], codec.Encoding().peak)
    assert codec.encode([(7, peaks)], codec.Encoding()).hex() == "07000000010000000000000000005940" + "0000a040"


@pytest.mark.parametrize("encoding", [codec.Encoding(), codec.Encoding(32, 32), codec.Encoding(64, 64, fitted=True), codec.Encoding(big_endian=True)])
def test_blob_round_trip(encoding):
    peaks = np.zeros(3, encoding.peak)
    peaks["mz"], peaks["intensity"] = [100, 200, 300], [1, 2, 3]
    data = codec.encode([(5, peaks), (6, peaks[:0])], encoding)
    back = list(codec.decode(data, encoding))
    assert [i for i, _ in back] == [5, 6] and (back[0][1] == peaks).all() and len(back[1][1]) == 0
    assert [p["mz"].tolist() for _, p in codec.decode(data, encoding, 200, 300)] == [[200, 300], []]
    assert [p["mz"].tolist() for _, p in codec.decode(data, encoding, 200, -1)][0] == [200, 300]


def test_mixed_byte_orders():
    a, b = codec.Encoding(), codec.Encoding(big_endian=True)
    data = codec.encode([(5, np.ones(1, a.peak)), (6, np.ones(2, b.peak))], {5: a, 6: b})
    assert [(i, len(p)) for i, p in codec.decode(data, {5: a, 6: b})] == [(5, 1), (6, 2)]
    with pytest.raises(ValueError):
        list(codec.decode(data[:-1], {5: a, 6: b}))


MGF = "# made\nCOM=x\nBEGIN IONS\nTITLE=a=b\nPEPMASS=719.28728\t41572\nCHARGE=2+\nRTINSECONDS=0.999451\nRAWSCANS=1-6,8\nODD=1\n100.5 10 1+\n\n200.25\t20\nEND IONS\n\nBEGIN IONS\nTITLE=second\nEND IONS\n"


def test_mgf_reader(spark, tmp_path):
    (tmp_path / "x.mgf").write_text(MGF)
    rows = {r.fields["TITLE"]: r for r in mgf.read(spark, str(tmp_path / "x.mgf")).collect()}
    assert set(rows) == {"a=b", "second"}
    first = rows["a=b"]
    assert [(p.mz, p.intensity) for p in first.peaks] == [(100.5, 10.0), (200.25, 20.0)] and first.fields["ODD"] == "1" and rows["second"].peaks == []
    got = mgf.read(spark, str(tmp_path / "x.mgf")).where("fields['TITLE'] = 'a=b'").select(mgf.pepmass(F.col("fields")["PEPMASS"]), mgf.charge(F.col("fields")["CHARGE"]), mgf.parent_scan(F.col("fields")["RAWSCANS"])).first()
    assert tuple(got) == (719.28728, 2, 1)


def test_mgf_numbers(spark):
    x = F.col("x")
    got = spark.createDataFrame([(1.0,), (2.0005,), (0.25,)], "x double").select(mgf.fixed(x, 4), mgf.short(x, 3), mgf.fixed(x, 0)).collect()
    assert [tuple(r) for r in got] == [("1.0000", "1.0", "1"), ("2.0005", "2.001", "2"), ("0.2500", "0.25", "0")]


def test_command_line(spark, tmp_path):
    spark.createDataFrame([(1, 100.0, 5.0), (1, 50.0, 1.0), (2, 410.0, 9.0)], "spectrum_id long, mz double, intensity double").write.parquet(str(tmp_path / "in/peaks.parquet"))
    spark.createDataFrame([(1, 60.0, 2, 400.0, 425.0, "t1", 2), (2, 59.0, 1, 0.0, 0.0, "t2", None)], "id long, time double, ms_level int, iso_min double, iso_max double, title string, charge int").write.parquet(str(tmp_path / "in/spectra.parquet"))
    cli.main(["parquet2mgf", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "mgf"), "--precursor", "refined", "--cutoff", "2"], spark)
    text = "".join(p.read_text() for p in (tmp_path / "mgf").glob("part-*"))
    assert text.strip() == "BEGIN IONS\nTITLE=t1\nPEPMASS=410.0000\nCHARGE=2+\nRTINSECONDS=60.00\nSCANS=1\n100.0 5\nEND IONS"
    cli.main(["xic", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "xic"), "--mz", "410", "--tolerance", "1"], spark)
    assert spark.read.parquet(str(tmp_path / "xic")).first().intensity == 9.0


def test_sqlite_tables(spark, tmp_path):
    path = str(tmp_path / "run.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE spectrum (id INTEGER PRIMARY KEY, time REAL, title TEXT, data BLOB)")
        db.executemany("INSERT INTO spectrum VALUES (?, ?, ?, ?)", [(i, i / 2, f"t{i}", bytes([i])) for i in range(1, 21)] + [(21, None, None, None)])
        db.execute("CREATE TABLE empty (id INTEGER, x TEXT)")
        db.execute("CREATE VIRTUAL TABLE box_rtree USING rtree(id, a, b)")
        db.execute("CREATE TABLE GlobalMetadata (Key TEXT, Value TEXT)")
        db.execute("INSERT INTO GlobalMetadata VALUES ('a', 'b')")
    assert sqlite.tables(path) == ["GlobalMetadata", "empty", "spectrum"]
    rows = sqlite.table(spark, path, "spectrum", 4).orderBy("id").collect()
    assert len(rows) == 21 and tuple(rows[2]) == (3, 1.5, "t3", bytearray([3])) and rows[20].title is None
    assert sqlite.table(spark, path, "empty").count() == 0
    assert sqlite.key_values(sqlite.table(spark, path, "GlobalMetadata")) == {"a": "b"}
    cli.main(["store2parquet", "-i", path, "-o", str(tmp_path / "out")], spark)
    assert spark.read.parquet(str(tmp_path / "out/spectrum")).count() == 21


def _array(values, kind, compress=False, bits=64):
    data = struct.pack(f"<{len(values)}{'d' if bits == 64 else 'f'}", *values)
    data = zlib.compress(data) if compress else data
    packed = f'<cvParam accession="{cv.ZLIB}" name="zlib"/>' if compress else ""
    return f'<binaryDataArray><cvParam accession="{cv.BITS_64 if bits == 64 else cv.BITS_32}" name="bits"/>{packed}<cvParam accession="{kind}" name="array"/><binary>{base64.b64encode(data).decode()}</binary></binaryDataArray>'


def test_mzml(spark, tmp_path):
    ion = f'<precursorList count="1"><precursor><selectedIonList count="1"><selectedIon><cvParam accession="{cv.SELECTED_ION_MZ}" value="445.5"/><cvParam accession="{cv.CHARGE_STATE}" value="2"/></selectedIon></selectedIonList></precursor></precursorList>'
    scan = f'<scanList count="1"><scan><cvParam accession="{cv.SCAN_START_TIME}" value="1.5" unitAccession="{cv.MINUTES}"/></scan></scanList>'
    body = [
        f'<spectrum index="0" id="scan=1"><cvParam accession="{cv.MS_LEVEL}" value="1"/>{scan}<binaryDataArrayList count="2">{_array([1.0, 2.0], cv.MZ_ARRAY)}{_array([3.0, 4.0], cv.INTENSITY_ARRAY, bits=32)}</binaryDataArrayList></spectrum>',
        f'<spectrum index="1" id="scan=2">{scan}{ion}<binaryDataArrayList count="2">{_array([5.0], cv.MZ_ARRAY, True)}{_array([6.0], cv.INTENSITY_ARRAY, True)}</binaryDataArrayList></spectrum>',
    ]
    (tmp_path / "x.mzML").write_text(f'<mzML><run id="r"><spectrumList count="2">{chr(10).join(body)}</spectrumList></run></mzML>')
    a, b = mzml.with_cycles(mzml.spectra(spark, str(tmp_path / "x.mzML"))).orderBy("index").collect()
    assert (a.ms_level, a.time, a.mz, a.intensity, a.cycle) == (1, 90.0, [1.0, 2.0], [3.0, 4.0], 1)
    assert (b.ms_level, b.precursor_mz, b.charge, b.mz, b.intensity, b.cycle) == (2, 445.5, 2, [5.0], [6.0], 1)


def test_mzml_metadata(spark):
    text = f"""<mzML xmlns="urn:x"><fileDescription><sourceFileList><sourceFile id="RAW1" name="a.raw" location="file:///d"/></sourceFileList></fileDescription>
    <sampleList><sample id="s1" name="one"><cvParam accession="{cv.SAMPLE_NAME}" value="name"/></sample></sampleList>
    <softwareList><software id="A" version="1"/><software id="B" version="2"/></softwareList>
    <instrumentConfigurationList><instrumentConfiguration id="IC1"><softwareRef ref="B"/></instrumentConfiguration><instrumentConfiguration id="IC2"/></instrumentConfigurationList>
    <dataProcessingList><dataProcessing id="d"><processingMethod order="0" softwareRef="A"/></dataProcessing></dataProcessingList>
    <run id="r" startTimeStamp="2015-02-05T19:30:47Z" defaultInstrumentConfigurationRef="IC2" sampleRef="s1" defaultSourceFileRef="RAW1"><spectrumList>"""
    m = mzml.metadata(text)
    assert m.run == {"id": 1, "name": "r", "start": "2015-02-05T19:30:47Z", "instrument_id": 2, "sample_id": 1, "source_file_id": 1}
    assert m.samples[0]["name"] == "name" and m.instruments[0]["software_id"] == 2 and m.processing[0]["software_id"] == 1
    assert set(m.frames(spark)) == {"sample", "source_file", "software", "instrument", "processing_method", "run"}


def test_param_trees(spark):
    value = F.lit('a<b & "c"')
    xml = xmlparams.tree_xml([xmlparams.cv_element(cv.MS_LEVEL, "level", F.lit(2)), xmlparams.cv_element(cv.TIC, "tic", value)], [xmlparams.user_element("u", value)])
    tree = xmlparams.param_tree(F.col("x"))
    row = spark.range(1).select(xml.alias("x")).select(xmlparams.cv_param(tree, cv.TIC).alias("a"), xmlparams.user_param(tree, "u").alias("b"), xmlparams.cv_param(tree, "none").alias("c"), F.size(xmlparams.cv_params(tree, [cv.TIC, cv.MS_LEVEL])).alias("d")).first()
    assert tuple(row) == ('a<b & "c"', 'a<b & "c"', None, 2)
    assert spark.createDataFrame([(None,)], "x string").select(xmlparams.param_tree(F.col("x"))).first()[0] is None


def test_scan_and_component_lists(spark):
    scan = f'<scanList count="1"><scan><cvParam accession="{cv.SCAN_START_TIME}" value="2" unitAccession="{cv.MINUTES}"/><cvParam accession="{cv.FILTER_STRING}" value="F ms"/><scanWindowList><scanWindow><cvParam accession="MS:1000501" value="100"/><cvParam accession="MS:1000500" value="900"/></scanWindow></scanWindowList></scan></scanList>'
    parts = '<componentList><source order="1"><cvParam name="esi"/></source><analyzer order="2"><cvParam name="trap"/></analyzer></componentList>'
    row = spark.createDataFrame([(scan, parts)], "s string, c string").select(xmlparams.scans(F.col("s")).alias("s"), xmlparams.components(F.col("c")).alias("c")).first()
    assert tuple(row.s) == (1, 120.0, "F ms", 100.0, 900.0)
    assert [tuple(x) for x in row.c] == [("source", 1, "esi"), ("analyzer", 2, "trap")]


def test_filter_strings(spark):
    rows = [("ITMS + c NSI d Full ms2 476.20@cid30.00 [120.00-1440.00]",), ("FTMS + p NSI sps d Full ms3 707.8472@cid35.00 463.3669@hcd45.00 [115.0000-140.0000]",), ("FTMS + p NSI Full ms [350.00-1500.00]",), ("odd",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "f string").select(thermo.scan_filter(F.col("f"))).collect()]
    assert (got[0].analyzer, got[0].level, [tuple(t) for t in got[0].targets], got[0].min_mz, got[0].max_mz) == ("ITMS", 2, [(476.2, "cid", 30.0)], 120.0, 1440.0)
    assert (got[1].level, len(got[1].targets), got[1].max_mz) == (3, 2, 140.0)
    assert (got[2].level, got[2].targets) == (1, None) and got[3].max_mz == 0.0 and got[4] is None


def test_spectrum_parts(spark):
    xml = '<spectrum id="scan=1"><cvParam accession="x"/><scanList><scan/></scanList><precursorList count="1"><precursor a="1"/></precursorList></spectrum>'
    got = spark.createDataFrame([(xml,)], "x string").select(thermo.spectrum_parts(F.col("x"))).first()[0]
    assert tuple(got) == ("scan=1", '<cvParam accession="x"/>', "<scanList><scan/></scanList>", '<precursor a="1"/>')


def test_clean_characters(spark):
    got = spark.createDataFrame([("a\x01b\tc\U0001f600",), (None,)], "x string").select(xmlparams.clean_characters(F.col("x"))).collect()
    assert got[0][0] == "a�b\tc\U0001f600" and got[1][0] is None


def _run(spark, tmp_path, make, files):
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, "run_id string, id long, time double, ms_level int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("run_id string, id long, time double, ms_level int").parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_stream_equals_batch(spark, tmp_path):
    files = [[("r", 3, 3.0, 2), ("r", 1, 1.0, 1), ("r", 2, 2.0, 2)], [("r", 5, 5.0, 1), ("r", 4, 4.0, 2)]]
    out = _run(spark, tmp_path, lambda s: resequenced(s, "run_id", 2), files)
    assert [(r.id, r.new_id, r.new_cycle) for r in out.orderBy("new_id").collect()] == [(1, 1, 1), (2, 2, 1), (3, 3, 1)]
    assert [(r.id, r.new_id, r.new_cycle) for r in held(spark, str(tmp_path / "state")).orderBy("new_id").collect()] == [(4, 4, 1), (5, 5, 2)]


def test_stream_time_rows(spark, tmp_path):
    files = [[("r", i, float(t), 1) for i, t in enumerate([0, 10, 15])], [("r", i + 3, float(t), 1) for i, t in enumerate([16, 31, 32])]]
    out = _run(spark, tmp_path, lambda s: time_rows(s, 15.0, ["run_id"]), files)
    assert [(r.row_start, r.first_id, r.last_id, r.n) for r in out.orderBy("row_start").collect()] == [(0.0, 0, 2, 3), (16.0, 3, 4, 2)]


def test_precursor_roots(spark):
    inner = f'<isolationWindow><cvParam accession="{cv.ISOLATION_TARGET}" value="500"/><cvParam accession="{cv.ISOLATION_LOWER}" value="1"/></isolationWindow><activation><cvParam accession="MS:1000422"/><cvParam accession="MS:1000045" value="35"/></activation>'
    rows = [(f"<precursorList><precursor>{inner}</precursor><precursor/></precursorList>",), (f"<precursor>{inner}</precursor>",), ("<precursorList/>",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(xmlparams.precursors(F.col("x"))).collect()]
    assert [tuple(g) for g in got[:2]] == [(500.0, 499.0, None, None, None, "HCD", 35.0)] * 2 and set(got[2]) == {None} and got[3] is None
