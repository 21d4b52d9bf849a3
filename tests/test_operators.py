"""Operators against brute force, hand-made cases and the decisions on edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peakloom.operators import ingest, order, precursor, ranges, spectra, stats, tiling, xic

PEAKS = [(1, 100.0, 10.0), (1, 200.0, 40.0), (1, 300.0, 20.0), (1, 400.0, 30.0)]


@pytest.fixture(scope="module")
def peaks(spark):
    return spark.createDataFrame(PEAKS, "spectrum_id long, mz double, intensity double")


@pytest.fixture(scope="module")
def headers(spark):
    return spark.createDataFrame([(1, 5.0, 1, 0.0, 0.0), (2, 6.0, 2, 400.0, 425.0)], "id long, time double, ms_level int, iso_min double, iso_max double")


def _one(df):
    rows = df.collect()
    return rows[0] if rows else None


def test_xic_methods(peaks, headers):
    top = _one(xic.xic(peaks, headers, 500.0, 500.0))
    assert (top.mz, top.intensity) == (200.0, 40.0)
    near = _one(xic.xic(peaks, headers, 310.0, 20.0, method="NEAREST"))
    assert (near.mz, near.intensity) == (300.0, 20.0)
    total = _one(xic.xic(peaks, headers, 500.0, 500.0, method="SUM"))
    assert (total.mz, total.intensity) == (400.0, 100.0)
    assert xic.xic(peaks, headers, 50.0, 1.0).count() == 0
    with pytest.raises(ValueError):
        xic.xic(peaks, headers, 1.0, 1.0, method="MEAN")
    with pytest.raises(ValueError):
        xic.peaks_in_range(peaks, headers, 1, 2, parent_mz=410.0)


def test_time_window_defaults(peaks, headers):
    assert xic.xic(peaks, headers, 200.0, 1.0, -5.0, 0.0).count() == 1
    assert xic.xic(peaks, headers, 200.0, 1.0, 5.1, None).count() == 0


def test_range_ends_are_inclusive(peaks, headers):
    assert [r.mz for r in xic.peaks_in_range(peaks, headers, 200.0, 400.0).orderBy("mz").collect()] == [200.0, 300.0, 400.0]


@pytest.fixture(scope="module")
def arrays(spark):
    return spark.createDataFrame([([(m, i) for _, m, i in PEAKS],), ([],)], "peaks array<struct<mz:double,intensity:double>>")


@pytest.mark.parametrize(("low", "high", "want"), [(100, 400, [100, 200, 300]), (150, 350, [200, 300]), (401, 500, None), (10, 50, None)])
def test_mz_range_filter(arrays, low, high, want):
    got = [r[0] for r in arrays.select(spectra.mz_range_filter(F.col("peaks"), low, high)).collect()]
    assert got[1] is None and (got[0] and [p.mz for p in got[0]]) == want


def test_nearest_in_arrays(arrays):
    p = F.col("peaks")
    row = arrays.select(
        spectra.nearest_peak(p, F.lit(250.0), 200_000)["mz"].alias("a"), spectra.nearest_peak(p, F.lit(99.0), 5_000)["mz"].alias("b"), spectra.nearest_peak_index(p, F.lit(250.0)).alias("c"),
        spectra.peak_index(p, F.lit(250.0), 200_000).alias("d"), spectra.peak_index(p, F.lit(250.0), 200_001).alias("e"),
    ).collect()
    assert tuple(row[0]) == (200.0, None, 1, -1, 1)
    assert tuple(row[1]) == (None, None, None, -1, -1)


def test_merged_parts(spark):
    parts = spark.createDataFrame([(1, [(300.0, 1.0), (400.0, 1.0)]), (1, [(100.0, 1.0), (200.0, 1.0)]), (1, [])], "spectrum_id long, peaks array<struct<mz:double,intensity:double>>")
    assert [p.mz for p in spectra.merged(parts).first().peaks] == [100.0, 200.0, 300.0, 400.0]


def test_base_peak_starts_at_the_first(spark):
    rows = [(1, 1.0, 0.0), (1, 2.0, 5.0), (1, 3.0, 5.0), (2, 1.0, 9.0), (2, 2.0, 5.0), (3, 1.0, 0.0)]
    got = {r.spectrum_id: r.base_mz for r in spectra.base_peak(spark.createDataFrame(rows, "spectrum_id long, mz double, intensity double")).collect()}
    assert got == {1: 2.0, 2: 1.0, 3: 0.0}


@pytest.mark.parametrize("rows_per_bin", [1, 3, 1000])
def test_numbers_and_running_sums(spark, rows_per_bin):
    r = random.Random(3)
    rows = [(i, r.choice([0.0, 1.0, 2.5, 7.0, None]), r.randrange(3)) for i in range(40)]
    got = order.running_sums(spark.createDataFrame(rows, "id long, t double, v long"), ["t", "id"], {"n": F.lit(1), "s": F.col("v")}, rows_per_bin).collect()
    want = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[0]))
    assert [x.id for x in sorted(got, key=lambda x: x.n)] == [x[0] for x in want]
    assert [x.s for x in sorted(got, key=lambda x: x.n)] == list(np.cumsum([x[2] for x in want]))
    assert order.row_numbers(spark.createDataFrame([], "id long"), ["id"]).count() == 0


_numbers = st.lists(st.floats(0, 50).map(lambda x: round(x, 1)), min_size=1, max_size=12)


@settings(max_examples=8, deadline=None)
@given(_numbers, st.lists(st.tuples(st.floats(0, 50).map(lambda x: round(x, 1)), st.floats(0, 9).map(lambda x: round(x, 1))), min_size=1, max_size=12), st.sampled_from([0.7, 5.0, 100.0]))
def test_range_joins(spark, points, intervals, width):
    p = spark.createDataFrame(list(enumerate(points)), "pid long, x double")
    i = spark.createDataFrame([(k, a, a + w) for k, (a, w) in enumerate(intervals)], "iid long, lo double, hi double")
    got = sorted((r.pid, r.iid) for r in ranges.stab_join(p, "x", i, "lo", "hi", width).collect())
    assert got == sorted((a, k) for a, x in enumerate(points) for k, (lo, w) in enumerate(intervals) if lo <= x <= lo + w)
    j = i.select(F.col("iid").alias("jid"), F.col("lo").alias("l2"), F.col("hi").alias("h2"))
    both = sorted((r.iid, r.jid) for r in ranges.overlap_join(i, "lo", "hi", j, "l2", "h2", width).collect())
    assert both == sorted((a, b) for a, (x, w) in enumerate(intervals) for b, (y, v) in enumerate(intervals) if x <= y + v and y <= x + w)


@settings(max_examples=8, deadline=None)
@given(_numbers, _numbers, st.sampled_from([1, 4, 1000]))
def test_nearest_join(spark, probes, keys, rows_per_bin):
    keys = sorted(set(keys))
    p = spark.createDataFrame(list(enumerate(probes)), "pid long, t double")
    k = spark.createDataFrame([(10 + i, x) for i, x in enumerate(keys)], "id long, time double")
    got = {r.pid: r.time for r in ranges.nearest(p, "t", k, "time", ["id"], rows_per_bin).collect()}
    assert got == {i: min(keys, key=lambda x: (abs(x - t), x)) for i, t in enumerate(probes)}


def test_interpolation(spark):
    points = spark.createDataFrame([(0.0, 0.0), (10.0, 20.0)], "x double, y0 double")
    probes = spark.createDataFrame([(5.0,), (-1.0,), (11.0,), (10.0,)], "t double")
    got = {r.t: r.y for r in ranges.interpolated(probes, "t", points, "x", "y0", rows_per_bin=2).collect()}
    assert got == {5.0: 10.0, -1.0: 0.0, 11.0: 20.0, 10.0: 20.0}


def test_nearest_among_many_equal_and_clustered_probes(spark):
    """A third of the probes are one value and most others lie close together, beside one outlier."""
    rows = spark.range(3_000).select(F.col("id").alias("pid"), F.when(F.col("id") % 3 == 0, 5.0).when(F.col("id") == 1, 1e12).otherwise(F.col("id") / 1e6).alias("t"))
    keys = [-4.0, 0.0015, 0.5, 7.0]
    got = {r.pid: (r.t, r.time) for r in ranges.nearest(rows, "t", spark.createDataFrame([(i, x) for i, x in enumerate(keys)], "id long, time double"), "time", ["id"], 50).collect()}
    assert len(got) == 3_000 and all(time == min(keys, key=lambda x: (abs(x - t), x)) for t, time in got.values())
    none = ranges.nearest(spark.createDataFrame([(None,), (2.0,)], "t double"), "t", spark.createDataFrame([(1, 1.0)], "id long, time double"), "time", ["id"])
    assert sorted((str(r.t), r.time) for r in none.collect()) == [("2.0", 1.0), ("None", None)]


def test_neighbours_take_linear_time(spark):
    """All in one bin; with a frame for each row this took half a minute."""
    import time

    began = time.perf_counter()
    probes, rows = spark.range(60_000).select((F.col("id") / 7).alias("t")), spark.range(20_000).select("id", (F.col("id") / 3).alias("time"))
    assert ranges.nearest(probes, "t", rows, "time", ["id"]).where("abs(t - time) < 1").count() > 40_000 and time.perf_counter() - began < 20


@pytest.mark.parametrize("lead", ["id % 2", "case when id = 7 then 1e15 else id / 1e9 end", "case when id % 3 = 0 then 4 else id end"])
def test_bins_of_hot_and_clustered_columns(spark, lead):
    rows = spark.range(4_000).selectExpr("id", f"cast({lead} as double) as t")
    got = [(r.t, r.id, r.number) for r in order.row_numbers(rows, ["t", "id"], rows_per_bin=100).collect()]
    assert [n for *_, n in sorted(got)] == list(range(1, 4_001))
    sizes = [r["count"] for r in order._binned(rows, ["t", "id"], 100).groupBy("__bin", "__sub").count().collect()]
    assert max(sizes) <= 300 and len(sizes) >= 20


@pytest.mark.parametrize(("times", "want"), [([0, 10, 15, 16, 31, 32], [0, 0, 0, 16, 16, 32])])
def test_anchored_rows(spark, times, want):
    rows = spark.createDataFrame([(i, float(t), 1) for i, t in enumerate(times)], "id long, time double, ms_level int")
    assert [r.row_start for r in tiling.anchored_rows(rows, 15.0, ["ms_level"]).orderBy("id").collect()] == want


def test_anchored_rows_in_small_batches(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, "a", "b"]), r.randrange(3), float(r.randrange(2_000))) for i in range(3_000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {x.id: x.row_start for x in tiling.anchored_rows(spark.createDataFrame(rows, "id long, run string, ms_level int, time double"), 15.0, ["run", "ms_level"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, opened = {}, {}
    for i, run, level, t in sorted(rows, key=lambda x: (x[3], x[0])):
        if (run, level) not in opened or t - opened[run, level] > 15.0:
            opened[run, level] = t
        want[i] = opened[run, level]
    assert got == want


def test_resequenced(spark):
    rows = spark.createDataFrame([(9, 3.0, 2), (8, 1.0, 1), (7, 2.0, 2), (6, 4.0, 1)], "id long, time double, ms_level int")
    got = [(r.id, r.new_id, r.new_cycle) for r in tiling.resequenced(rows, ["time"]).orderBy("new_id").collect()]
    assert got == [(8, 1, 1), (7, 2, 1), (9, 3, 1), (6, 4, 2)]


def test_histogram(spark):
    rows = spark.createDataFrame([(float(x),) for x in range(10)], "v double")
    assert [r.n for r in stats.histogram(rows, "v", 3).orderBy("bin").collect()] == [4, 3, 3]
    assert [r.n for r in stats.histogram(spark.createDataFrame([(0.0,), (9.0,)], "v double"), "v", 3).orderBy("bin").collect()] == [1, 0, 1]
    assert stats.histogram(rows.limit(0), "v", 3).count() == 0


def test_filtered_statistics(spark):
    rows = spark.createDataFrame([(1, 0.0), (1, float("nan")), (1, 2.0), (1, 4.0), (2, 0.0), (2, float("nan"))], "k long, v double")
    got = {r.k: (r.a, r.b) for r in rows.groupBy("k").agg(stats.filtered_mean(F.col("v")).alias("a"), stats.filtered_median(F.col("v")).alias("b")).collect()}
    assert got[1] == (3.0, 3.0) and all(np.isnan(x) for x in got[2])


def test_median_object(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "v double")
    assert stats.median_object(rows, [], ["v"]).first().v == 3.0


def _cluster_slowly(mz, intensity, ppm):
    used, out = set(), []
    for a in sorted(range(len(mz)), key=lambda i: (-intensity[i], i)):
        if a in used:
            continue
        own, tol = [a], mz[a] * ppm / 1e6
        for step in (1, -1):
            k = a + step
            while 0 <= k < len(mz) and abs(mz[k] - mz[a]) <= tol:
                own.append(k)
                k += step
        used |= set(own)
        w = sum(intensity[k] for k in own)
        out.append((sum(mz[k] * intensity[k] for k in own) / w if w else mz[a], intensity[a]))
    return sorted(out)


def test_peak_clusters(spark):
    mz, i = ingest.cluster(np.array([100.0, 100.0005, 100.0020]), np.array([10.0, 30.0, 5.0]))
    np.testing.assert_allclose(mz, [100.000375, 100.0020])
    assert i.tolist() == [30.0, 5.0]
    _, i = ingest.cluster(np.array([100.0, 100.0008, 100.0016]), np.array([10.0, 5.0, 9.0]))
    assert i.tolist() == [10.0, 9.0]
    r = random.Random(5)
    for _ in range(200):
        m = np.sort(np.array([100 + r.random() / 50 for _ in range(r.randrange(12))]))
        w = np.array([float(r.randrange(4)) for _ in m])
        got = list(zip(*ingest.cluster(m, w, 30), strict=True))
        np.testing.assert_allclose(np.array(got).reshape(-1, 2), np.array(_cluster_slowly(m.tolist(), w.tolist(), 30)).reshape(-1, 2))
    rows = spark.createDataFrame([(1, [100.0, 100.0005], [1.0, 3.0]), (2, [], []), (3, None, None)], "spectrum_id long, mz array<double>, intensity array<double>")
    assert ingest.drop_empty(ingest.clustered(rows)).count() == 1


def test_calibration_needs_points(spark):
    own = spark.createDataFrame([(1, 5.0, 500.0)], "id long, time double, mz double")
    points = spark.createDataFrame([(float(t), 10.0) for t in range(10)], "time double, error double")
    assert precursor.calibrated(own, points).first().calibrated_mz == 500.0 - 500.0 * 10 / 1e6
    assert precursor.calibrated(own, points.limit(9)).first().calibrated_mz == 500.0


def test_calibration_checkpoints(spark):
    r = random.Random(2)
    rows = [(i, float(i), float(r.randrange(50)), r.gauss(0, 5)) for i in range(450)]
    got = {x.checkpoint: (x.time, x.error) for x in precursor.calibration_points(spark.createDataFrame(rows, "id long, time double, intensity double, error double")).collect()}
    for k in range(1, 5):
        seen = [(o, x) for o, x in enumerate(rows, 1) if 100 * k - 201 < o <= 100 * k]
        top = sorted(sorted(seen, key=lambda x: (-x[1][2], x[0]))[:100], key=lambda x: (x[1][3], x[0]))
        e = [x[1][3] for x in top]
        q1, q3 = e[len(e) // 4], e[3 * len(e) // 4]
        kept = [x for x in top if q1 - 1.5 * (q3 - q1) < x[1][3] < q3 + 1.5 * (q3 - q1)]
        mid = kept[len(kept) // 2][1]
        assert got[k] == (mid[1], mid[3])
    assert set(got) == {1, 2, 3, 4}


def test_estimators(spark, peaks, headers):
    assert precursor.estimated(headers, peaks, "main").first().precursor_mz == 412.5
    assert precursor.estimated(headers, peaks, "refined").first().precursor_mz == 400.0
    with pytest.raises(ValueError):
        precursor.estimated(headers, peaks, "none")


def test_faims(spark):
    rows = spark.createDataFrame([("FTMS + p NSI cv=-45.00 Full ms",), ("FTMS + p NSI Full ms",)], "f string")
    assert [r[0] for r in rows.select(ingest.faims_voltage(F.col("f"))).collect()] == ["-45.00", ""]


def test_slice_of_mz(spark):
    slices = spark.createDataFrame([(1, 400.0, 405.0), (2, 405.0, 410.0)], "number long, lo double, hi double")
    probe = spark.createDataFrame([(405.0,)], "mz double")
    assert [r.number for r in ranges.stab_join(probe, "mz", slices, "lo", "hi", 5.0, closed=False).collect()] == [2]


def test_units():
    assert abs(xic.da_to_ppm(500, 0.005) - 10) < 1e-9
    assert xic.ppm_to_da(500, 10) == 0.005
