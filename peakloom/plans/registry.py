"""All registered spectra queries: callables (spark, sf_dir) and, beside each, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.functions import cv, dates, thermo, xmlparams
from peakloom.operators import ingest, precursor, ranges, spectra, stats, tiling, xic
from peakloom.plans import adapters
from peakloom.session import local_folder, table
from peakloom.sources import codec, mgf, store

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True):
    """Registers a function under its name, with its SQL; views puts the adapter tables sp and pk in front."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = (adapters.SQL if views else "") + sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _both(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return adapters.peaks(s, d), adapters.spectra(s, d)


def _long(name: str):
    return F.col(name).cast("bigint").alias(name)


def _int(name: str):
    return F.col(name).cast("int").alias(name)


# ------------------------------------------------------------------------------------------------ chromatograms

_IN = "SELECT p.spectrum_id, s.time, p.mz, p.intensity FROM pk p JOIN sp s ON p.spectrum_id = s.id WHERE s.ms_level = {level} AND p.mz BETWEEN {lo} AND {hi} AND s.time BETWEEN {t0} AND {t1}{more}"
_MAX = ", w AS ({0}), r AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, mz DESC) AS k FROM w) SELECT spectrum_id, time, mz, intensity FROM r WHERE k = 1"
_NEAR = ", w AS ({0}), r AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY abs(mz - {1}), mz, intensity) AS k FROM w WHERE abs(mz - {1}) <= {2}) SELECT spectrum_id, time, mz, intensity FROM r WHERE k = 1"
_WIDE = _IN.format(level=1, lo="450.0", hi="550.0", t0="20.0", t1="1e9", more="")


@query(_MAX.format(_WIDE))
def xic_max(s, d):
    return xic.xic(*_both(s, d), 500.0, 50.0, 20.0, None, "MAX")


@query(_NEAR.format(_WIDE, "500.0", "50.0"))
def xic_nearest(s, d):
    return xic.xic(*_both(s, d), 500.0, 50.0, 20.0, None, "NEAREST")


@query(
    ", w AS (" + _IN.format(level=1, lo="100.0", hi="900.0", t0="20.0", t1="1e9", more="") + "), r AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity, mz) - 1 AS k, "
    "count(*) OVER (PARTITION BY spectrum_id) AS n, sum(intensity) OVER (PARTITION BY spectrum_id) AS total FROM w) SELECT spectrum_id, time, mz, total AS intensity FROM r WHERE k = n // 2"
)
def xic_sum(s, d):
    return xic.xic(*_both(s, d), 500.0, 400.0, 20.0, None, "SUM")


@query(_MAX.format(_IN.format(level=1, lo="300.0", hi="320.0", t0="0", t1="1e9", more="")))
def xic_full_rt(s, d):
    return xic.xic_in_range(*_both(s, d), 300.0, 320.0)


@query(_NEAR.format(_IN.format(level=1, lo="600.0", hi="700.0", t0="10.0", t1="2000.0", more=""), "650.0", "50.0"))
def xic_mz_rt_range(s, d):
    return xic.xic_in_range(*_both(s, d), 600.0, 700.0, 10.0, 2000.0, "NEAREST")


_PARENT = " AND 612.5 BETWEEN s.iso_min AND s.iso_max"


@query(_MAX.format(_IN.format(level=2, lo="400.0", hi="600.0", t0="0", t1="1e9", more=_PARENT)))
def msn_xic(s, d):
    return xic.xic(*_both(s, d), 500.0, 100.0, None, None, "MAX", 2, 612.5)


_SLICES = ", w AS ({0}) SELECT spectrum_id, time, count(*) AS n_peaks, sum(intensity) AS sum_intensity, min(mz) AS min_mz, max(mz) AS max_mz FROM w GROUP BY ALL"
_GOLDEN = _IN.format(level=1, lo="400.0", hi="600.0", t0="30.0", t1="2000.0", more="")
_GOLDEN_N = _IN.format(level=2, lo="300.0", hi="800.0", t0="0", t1="1e9", more=_PARENT)


@query(_SLICES.format(_GOLDEN))
def ms_slices(s, d):
    return xic.slices_in_range(*_both(s, d), 400.0, 600.0, 30.0, 2000.0)


@query(_SLICES.format(_GOLDEN_N))
def msn_slices(s, d):
    return xic.slices_in_range(*_both(s, d), 300.0, 800.0, None, None, 2, 612.5)


@query(" " + _GOLDEN)
def ms_peaks_range(s, d):
    return xic.peaks_in_range(*_both(s, d), 400.0, 600.0, 30.0, 2000.0).select("spectrum_id", "time", "mz", "intensity")


@query(" " + _GOLDEN_N)
def msn_peaks_range(s, d):
    return xic.peaks_in_range(*_both(s, d), 300.0, 800.0, None, None, 2, 612.5).select("spectrum_id", "time", "mz", "intensity")


@query("SELECT l_orderkey AS spectrum_id, l_linenumber AS line, l_extendedprice / 100.0 AS mz, l_extendedprice / 100.0 * 20.0 / 1e6 AS tolerance, (l_extendedprice / 100.0 * 20.0 / 1e6) * 1e6 / (l_extendedprice / 100.0) AS ppm FROM lineitem", views=False)
def ppm_da(s, d):
    mz = F.col("l_extendedprice") / 100.0
    da = xic.ppm_to_da(mz, F.lit(20.0))
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("spectrum_id"), F.col("l_linenumber").alias("line"), mz.alias("mz"), da.alias("tolerance"), xic.da_to_ppm(mz, da).alias("ppm"))


# ------------------------------------------------------------------------------------------- headers and scalars

_HEAD = "SELECT id, time, ms_level, cycle, tic0 AS tic, CASE WHEN ms_level > 1 THEN (iso_min + iso_max) / 2 END AS precursor_mz FROM sp"


def _headers(s, d, level=None):
    return spectra.headers(adapters.with_cycle(adapters.spectra(s, d)), level)


@query(_HEAD)
def headers_all(s, d):
    return _headers(s, d)


@query(_HEAD + " WHERE ms_level = 1")
def headers_ms1(s, d):
    return _headers(s, d, 1)


@query(_HEAD + " WHERE ms_level = 2")
def headers_ms2(s, d):
    return _headers(s, d, 2)


@query(_HEAD + " WHERE ms_level = 3")
def headers_ms3(s, d):
    return _headers(s, d, 3)


@query(_HEAD + " WHERE id = 42")
def header_by_id(s, d):
    return _headers(s, d).where("id = 42")


@query(
    ", pr AS (SELECT event_id, CAST(user_id AS DOUBLE) * 1.7 AS t FROM events), ms1 AS (SELECT id, time FROM sp WHERE ms_level = 1), "
    "a AS (SELECT pr.event_id, pr.t, ms1.id AS a_id, ms1.time AS a_t FROM pr ASOF LEFT JOIN ms1 ON pr.t >= ms1.time), "
    "b AS (SELECT a.*, ms1.id AS b_id, ms1.time AS b_t FROM a ASOF LEFT JOIN ms1 ON a.t <= ms1.time) "
    "SELECT event_id, t, CASE WHEN a_id IS NOT NULL AND (b_id IS NULL OR abs(t - a_t) <= abs(b_t - t)) THEN a_t ELSE b_t END AS time, "
    "CASE WHEN a_id IS NOT NULL AND (b_id IS NULL OR abs(t - a_t) <= abs(b_t - t)) THEN a_id ELSE b_id END AS id FROM b"
)
def header_for_time(s, d):
    probes = table(s, d, "events").select("event_id", (F.col("user_id").cast("double") * 1.7).alias("t"))
    ms1 = adapters.spectra(s, d).where("ms_level = 1").select("id", "time")
    return ranges.nearest(probes, "t", ms1, "time", ["id"])


@query(" SELECT id FROM sp WHERE ms_level = 2 AND time BETWEEN 30.0 AND 90.0")
def ids_for_time_range(s, d):
    return xic.header_window(adapters.spectra(s, d), 30.0, 90.0, 2).select("id")


@query(" SELECT id, time FROM sp")
def spectrum_times(s, d):
    return adapters.spectra(s, d).select("id", "time")


@query(" SELECT count(*) AS n FROM sp")
def spectra_count(s, d):
    return adapters.spectra(s, d).agg(F.count("*").alias("n"))


@query(" SELECT ms_level, count(*) AS n FROM sp GROUP BY ms_level")
def spectra_count_by_level(s, d):
    return adapters.spectra(s, d).groupBy("ms_level").agg(F.count("*").alias("n"))


@query(" SELECT max(cycle) AS n FROM sp")
def cycles_count(s, d):
    return adapters.spectra(s, d).agg(F.count(F.when(F.col("ms_level") == 1, 1)).alias("n"))


@query(" SELECT arg_max(time, id) AS time FROM sp")
def last_time(s, d):
    return adapters.spectra(s, d).agg(F.max_by("time", "id").alias("time"))


@query(" SELECT max(ms_level) AS ms_level FROM sp")
def max_ms_level(s, d):
    return adapters.spectra(s, d).agg(F.max("ms_level").alias("ms_level"))


# ------------------------------------------------------------------------------------------------ tiles and slices

_TILES = (
    ", t AS (SELECT p.*, s.time, s.ms_level, CASE WHEN s.ms_level = 1 THEN 0.0 ELSE s.iso_min END AS iso, CAST(floor(p.mz / 5.0) AS BIGINT) AS mz_bin, CAST(floor(s.time / 15.0) AS BIGINT) AS rt_row FROM pk p JOIN sp s ON p.spectrum_id = s.id)"
)
_BB = _TILES + ", bb AS (SELECT ms_level, iso, rt_row, mz_bin, min(time) AS first_time, max(time) AS last_time, min(spectrum_id) AS first_spectrum_id, max(spectrum_id) AS last_spectrum_id, count(*) AS n_peaks FROM t GROUP BY ms_level, iso, rt_row, mz_bin)"
_RS = _BB + ", rs AS (SELECT row_number() OVER (ORDER BY ms_level, mz_bin) AS number, ms_level, mz_bin, CAST(mz_bin * 5.0 AS DOUBLE) AS begin_mz, CAST((mz_bin + 1) * 5.0 AS DOUBLE) AS end_mz FROM (SELECT DISTINCT ms_level, mz_bin FROM t))"


def _tiles(s, d):
    return tiling.tiled(*_both(s, d))


@query(_BB + " SELECT ms_level, CAST(iso AS DOUBLE) AS iso, rt_row, mz_bin, first_time, last_time, first_spectrum_id, last_spectrum_id, n_peaks FROM bb")
def bb_tiles(s, d):
    return tiling.tile_statistics(_tiles(s, d))


@query(_RS + " SELECT number, count(*) AS n_tiles FROM bb JOIN rs USING (ms_level, mz_bin) GROUP BY number")
def bb_count_per_run_slice(s, d):
    own = _tiles(s, d)
    return tiling.tile_statistics(own).join(tiling.run_slices(own), ["ms_level", "mz_bin"]).groupBy("number").agg(F.count("*").alias("n_tiles"))


@query(_RS + " SELECT first_spectrum_id, last_spectrum_id, rs.number, rs.ms_level FROM bb JOIN rs ON bb.ms_level = rs.ms_level AND bb.mz_bin = rs.mz_bin")
def bb_ms_level(s, d):
    own = _tiles(s, d)
    return tiling.tile_statistics(own).join(tiling.run_slices(own), ["ms_level", "mz_bin"]).select("first_spectrum_id", "last_spectrum_id", "number", "ms_level")


@query(_RS + " SELECT ms_level, CAST(iso AS DOUBLE) AS iso, rt_row, mz_bin, begin_mz AS min_mz, end_mz AS max_mz, first_time AS min_time, last_time AS max_time FROM bb JOIN rs USING (ms_level, mz_bin)")
def bb_bounds(s, d):
    own = _tiles(s, d)
    joined = tiling.tile_statistics(own).join(tiling.run_slices(own), ["ms_level", "mz_bin"])
    return joined.select("ms_level", "iso", "rt_row", "mz_bin", F.col("begin_mz").alias("min_mz"), F.col("end_mz").alias("max_mz"), F.col("first_time").alias("min_time"), F.col("last_time").alias("max_time"))


@query(
    _TILES + ", c AS (SELECT ms_level, rt_row, mz_bin, count(*) AS n FROM t GROUP BY ALL) SELECT r.ms_level, r.rt_row, m.mz_bin, coalesce(c.n, 0) AS n_peaks FROM (SELECT DISTINCT ms_level, rt_row FROM c) r "
    "JOIN (SELECT DISTINCT ms_level, mz_bin FROM c) m ON r.ms_level = m.ms_level LEFT JOIN c ON c.ms_level = r.ms_level AND c.rt_row = r.rt_row AND c.mz_bin = m.mz_bin"
)
def bb_row_densify(s, d):
    return tiling.densified(_tiles(s, d))


@query(_RS + " SELECT number, ms_level, mz_bin, begin_mz, end_mz FROM rs")
def run_slices(s, d):
    return tiling.run_slices(_tiles(s, d))


@query(_RS + " SELECT ms_level, CAST(min(begin_mz) AS INT) AS min_mz, CAST(max(end_mz) AS INT) AS max_mz FROM rs GROUP BY ms_level")
def mz_range(s, d):
    return tiling.run_slices(_tiles(s, d)).groupBy("ms_level").agg(F.min("begin_mz").cast("int").alias("min_mz"), F.max("end_mz").cast("int").alias("max_mz"))


@query(_RS + " SELECT p.p_partkey, p.p_retailprice / 2.0 AS mz, rs.number FROM part p JOIN rs ON rs.begin_mz <= p.p_retailprice / 2.0 AND rs.end_mz > p.p_retailprice / 2.0 AND rs.ms_level = 1")
def run_slice_for_mz(s, d):
    probes = table(s, d, "part").select("p_partkey", (F.col("p_retailprice") / 2.0).alias("mz"))
    own = tiling.run_slices(_tiles(s, d)).where("ms_level = 1").select("number", "begin_mz", "end_mz")
    return ranges.stab_join(probes, "mz", own, "begin_mz", "end_mz", 5.0, closed=False).select("p_partkey", "mz", "number")


@query(_RS + " SELECT number FROM rs WHERE ms_level = 1 AND end_mz > 402.5 AND begin_mz <= 598.0")
def run_slices_for_range(s, d):
    own = tiling.run_slices(_tiles(s, d))
    return own.where((F.col("ms_level") == 1) & (F.col("end_mz") > 402.5) & (F.col("begin_mz") <= 598.0)).select("number")


@query(_TILES + " SELECT mz_bin, count(DISTINCT spectrum_id) AS n_spectra, count(*) AS n_peaks, sum(intensity) AS sum_intensity FROM t WHERE ms_level = 1 AND (mz_bin + 1) * 5.0 >= 300.0 AND mz_bin * 5.0 <= 700.0 GROUP BY mz_bin")
def run_slice_iter(s, d):
    own = _tiles(s, d).where("ms_level = 1").where(((F.col("mz_bin") + 1) * 5.0 >= 300.0) & (F.col("mz_bin") * 5.0 <= 700.0))
    return own.groupBy("mz_bin").agg(F.countDistinct("spectrum_id").alias("n_spectra"), F.count("*").alias("n_peaks"), F.sum("intensity").alias("sum_intensity"))


@query(_TILES + " SELECT iso, mz_bin, count(DISTINCT spectrum_id) AS n_spectra, count(*) AS n_peaks FROM (SELECT spectrum_id, mz_bin, CAST(iso AS DOUBLE) AS iso FROM t WHERE ms_level = 2 AND iso <= 650.0 AND iso + 25.0 >= 550.0 AND mz_bin BETWEEN 60 AND 120) GROUP BY iso, mz_bin")
def msn_run_slice_iter(s, d):
    own = _tiles(s, d).where("ms_level = 2").where((F.col("iso") <= 650.0) & (F.col("iso") + 25.0 >= 550.0) & F.col("mz_bin").between(60, 120))
    return own.groupBy("iso", "mz_bin").agg(F.countDistinct("spectrum_id").alias("n_spectra"), F.count("*").alias("n_peaks"))


@query(_TILES + " SELECT spectrum_id, mz, intensity FROM t WHERE ms_level = 1 AND mz_bin = 100")
def run_slice_data(s, d):
    return _tiles(s, d).where("ms_level = 1 and mz_bin = 100").select("spectrum_id", "mz", "intensity")


@query(" SELECT mz, intensity, lhwhm, rhwhm FROM pk WHERE spectrum_id = 100")
def spectrum_peaks(s, d):
    return adapters.peaks(s, d).where("spectrum_id = 100").select("mz", "intensity", "lhwhm", "rhwhm")


@query(" SELECT spectrum_id, row_number() OVER (PARTITION BY spectrum_id ORDER BY mz, intensity) - 1 AS rank, mz, intensity FROM pk")
def merge_slices(s, d):
    whole = spectra.merged(spectra.slices(adapters.peaks(s, d)))
    return whole.select("spectrum_id", F.posexplode("peaks").alias("rank", "p")).select("spectrum_id", _long("rank"), "p.mz", "p.intensity")


@query(" SELECT spectrum_id, row_number() OVER (PARTITION BY spectrum_id ORDER BY mz, intensity, lhwhm, rhwhm) - 1 AS rank, mz, intensity, lhwhm, rhwhm FROM pk")
def peaks_explode(s, d):
    return spectra.spectrum_arrays(adapters.peaks(s, d)).select("spectrum_id", F.posexplode("peaks").alias("rank", "p")).select("spectrum_id", _long("rank"), "p.*")


@query(" SELECT sp.id, coalesce(min(mz), 0.0) AS min_mz, coalesce(max(mz), 0.0) AS max_mz, count(mz) AS n_peaks FROM sp LEFT JOIN pk ON sp.id = pk.spectrum_id GROUP BY sp.id")
def min_max_mz(s, d):
    p, h = _both(s, d)
    arrays = h.select("id").join(spectra.spectrum_arrays(p), F.col("id") == F.col("spectrum_id"), "left")
    first = F.coalesce(F.try_element_at("peaks", F.lit(1))["mz"], F.lit(0.0))
    last = F.coalesce(F.try_element_at("peaks", F.lit(-1))["mz"], F.lit(0.0))
    return arrays.select("id", first.alias("min_mz"), last.alias("max_mz"), F.coalesce(F.size("peaks"), F.lit(0)).cast("bigint").alias("n_peaks"))


@query(_TILES + " SELECT id, time FROM sp WHERE id IN (SELECT spectrum_id FROM t WHERE mz_bin BETWEEN 100 AND 102 AND rt_row BETWEEN 1 AND 40)")
def semi_join_tiles(s, d):
    wanted = _tiles(s, d).where(F.col("mz_bin").between(100, 102) & F.col("rt_row").between(1, 40)).select("spectrum_id")
    return adapters.spectra(s, d).join(wanted, F.col("id") == F.col("spectrum_id"), "left_semi").select("id", "time")


# ---------------------------------------------------------------------------------------------- windows and dims


@query(" SELECT DISTINCT iso_min, iso_max, (iso_min + iso_max) / 2 AS target FROM sp WHERE ms_level = 2")
def dia_windows(s, d):
    return adapters.spectra(s, d).where("ms_level = 2").select("iso_min", "iso_max", ((F.col("iso_min") + F.col("iso_max")) / 2).alias("target")).distinct()


@query(" SELECT iso_min, CAST(trunc(mz / 1.0) AS BIGINT) AS bin, sum(intensity) AS intensity FROM pk JOIN sp ON pk.spectrum_id = sp.id WHERE ms_level = 2 GROUP BY ALL")
def dia_histogram(s, d):
    return tiling.dia_histogram(*_both(s, d))


@query(" SELECT id, e.* FROM sp JOIN (VALUES ('F', 1, 'fitted', 64, 32), ('O', 2, 'centroid', 64, 32), ('P', 3, 'profile', 32, 32)) e(code, encoding_id, mode, mz_bits, intensity_bits) ON sp.encoding = e.code")
def data_encoding_of_spectrum(s, d):
    known = s.createDataFrame([("F", 1, "fitted", 64, 32), ("O", 2, "centroid", 64, 32), ("P", 3, "profile", 32, 32)], "code string, encoding_id int, mode string, mz_bits int, intensity_bits int")
    return adapters.spectra(s, d).select("id", "encoding").join(F.broadcast(known), F.col("encoding") == F.col("code")).drop("encoding")  # three rows


@query(" SELECT encoding, activation, row_number() OVER (ORDER BY first) AS encoding_id FROM (SELECT encoding, activation, min(id) AS first FROM sp GROUP BY ALL)")
def encoding_registry(s, d):
    from pyspark.sql import Window

    own = adapters.spectra(s, d).groupBy("encoding", "activation").agg(F.min("id").alias("first"))
    return own.select("encoding", "activation", F.row_number().over(Window.orderBy("first")).cast("bigint").alias("encoding_id"))


@query("SELECT r_name AS instrument, n_name AS run, count(s_suppkey) AS n_samples, min(s_name) AS first_sample FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY ALL", views=False)
def metadata_join(s, d):
    r, n, u = (table(s, d, t) for t in ("region", "nation", "supplier"))
    joined = n.join(r, n["n_regionkey"] == r["r_regionkey"]).join(u, n["n_nationkey"] == u["s_nationkey"], "left")
    return joined.groupBy(F.col("r_name").alias("instrument"), F.col("n_name").alias("run")).agg(F.count("s_suppkey").alias("n_samples"), F.min("s_name").alias("first_sample"))


@query("SELECT o_orderkey AS id, 'controllerType=0 scan=' || CAST(o_orderkey AS VARCHAR) AS title FROM orders WHERE o_orderkey % 4 <> 0", views=False)
def title_map(s, d):
    own = adapters.spectra(s, d).where("ms_level = 2")
    return own.select("id", F.concat(F.lit("controllerType=0 scan="), F.col("id").cast("string")).alias("title"))


# ------------------------------------------------------------------------------------------------ base peaks, dense


@query(
    ", r AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, mz) AS k, sum(intensity) OVER (PARTITION BY spectrum_id) AS tic FROM pk) "
    "SELECT spectrum_id, CASE WHEN intensity > 0 THEN mz ELSE 0.0 END AS base_mz, CASE WHEN intensity > 0 THEN intensity ELSE 0.0 END AS base_intensity, tic FROM r WHERE k = 1"
)
def base_peak_tic(s, d):
    return spectra.base_peak(adapters.peaks(s, d))


_DENSE = "WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), f AS (SELECT vec_id, label, 400.0 + 0.5 * i AS mz, v AS intensity, i FROM e) "


def _dense(s, d):
    return spectra.dense(table(s, d, "embeddings"))


@query(_DENSE + ", r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY intensity DESC, mz) AS k FROM f) SELECT vec_id, CAST(CASE WHEN intensity > 0 THEN mz ELSE 0.0 END AS DOUBLE) AS base_mz, CASE WHEN intensity > 0 THEN intensity ELSE 0.0 END AS base_intensity FROM r WHERE k = 1", views=False)
def base_peak_dense(s, d):
    rows = _dense(s, d).select("vec_id", F.inline("peaks"))
    return spectra.base_peak(rows, "vec_id").drop("tic").select("vec_id", F.col("base_mz").cast("double").alias("base_mz"), "base_intensity")


@query(_DENSE + "SELECT vec_id, count(*) AS n, CAST(min(mz) AS DOUBLE) AS first_mz, CAST(max(mz) AS DOUBLE) AS last_mz, CAST(arg_min(intensity, mz) AS DOUBLE) AS first_intensity FROM f WHERE mz >= 410.0 AND mz < 420.0 GROUP BY vec_id", views=False)
def dense_mz_range_filter(s, d):
    own = _dense(s, d).withColumn("p", spectra.mz_range_filter(F.col("peaks"), 410.0, 420.0)).where("p is not null")
    return own.select("vec_id", F.size("p").cast("bigint").alias("n"), F.col("p")[0]["mz"].cast("double").alias("first_mz"), F.element_at("p", -1)["mz"].cast("double").alias("last_mz"), F.col("p")[0]["intensity"].alias("first_intensity"))


@query(_DENSE + ", r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(mz - (401.25 + label * 1.6)), i) AS k FROM f) SELECT vec_id, CAST(i AS BIGINT) AS i FROM r WHERE k = 1", views=False)
def nearest_peak_index(s, d):
    return _dense(s, d).select("vec_id", spectra.nearest_peak_index(F.col("peaks"), F.lit(401.25) + F.col("label") * 1.6).cast("bigint").alias("i"))


@query(_DENSE + ", r AS (SELECT *, 401.0 + label * 1.6 AS x, row_number() OVER (PARTITION BY vec_id ORDER BY abs(mz - (401.0 + label * 1.6)), i) AS k FROM f) SELECT vec_id, CASE WHEN 1e6 * abs(CAST(mz AS DOUBLE) - CAST(x AS DOUBLE)) / CAST(x AS DOUBLE) < 400.0 THEN CAST(i AS BIGINT) ELSE -1 END AS i FROM r WHERE k = 1", views=False)
def peak_index_ppm(s, d):
    return _dense(s, d).select("vec_id", spectra.peak_index(F.col("peaks"), F.lit(401.0) + F.col("label") * 1.6, 400.0).cast("bigint").alias("i"))


# ------------------------------------------------------------------------------------------- sequences and numbering


@query(" SELECT id, row_number() OVER (ORDER BY acq, id) AS new_id, CAST(sum(CASE WHEN ms_level = 1 THEN 1 ELSE 0 END) OVER (ORDER BY acq, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS new_cycle FROM sp")
def resequence(s, d):
    return tiling.resequenced(adapters.spectra(s, d), ["acq", "id"]).select("id", "new_id", "new_cycle")


@query(" SELECT id, row_number() OVER (ORDER BY id) AS new_id FROM sp WHERE id IN (SELECT spectrum_id FROM pk)")
def renumber_nonempty(s, d):
    p, h = _both(s, d)
    return tiling.renumbered(h, p).select("id", "new_id")


@query(" SELECT ms_level, CAST(floor(time / 15.0) AS BIGINT) AS rt_row, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM sp GROUP BY ALL")
def rt_rows_fixed(s, d):
    own = adapters.spectra(s, d).groupBy("ms_level", ranges.bin_of(F.col("time"), 15.0).alias("rt_row"))
    return own.agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(
    ", g AS (SELECT id, time, ms_level, CASE WHEN ms_level = 1 THEN CAST(0.0 AS DOUBLE) ELSE iso_min END AS iso FROM sp), a AS (WITH RECURSIVE r AS (SELECT ms_level, iso, min(time) AS t FROM g GROUP BY ms_level, iso UNION ALL "
    "SELECT r.ms_level, r.iso, (SELECT min(g.time) FROM g WHERE g.ms_level = r.ms_level AND g.iso = r.iso AND g.time - r.t > 15.0) AS t FROM r WHERE r.t IS NOT NULL) SELECT * FROM r WHERE t IS NOT NULL) "
    "SELECT g.ms_level, g.iso, g.id, g.time, max(a.t) AS row_start FROM g JOIN a ON g.ms_level = a.ms_level AND g.iso = a.iso AND a.t <= g.time GROUP BY g.ms_level, g.iso, g.id, g.time"
)
def rt_rows_anchored(s, d):
    own = adapters.spectra(s, d).withColumn("iso", F.when(F.col("ms_level") == 1, F.lit(0.0)).otherwise(F.col("iso_min")))
    return tiling.anchored_rows(own, 15.0, ["ms_level", "iso"])


# ---------------------------------------------------------------------------------------------------- statistics


@query(
    ", e AS (SELECT min(tic0) AS low, max(tic0) AS high, (max(tic0) - min(tic0)) / 20 + 1e-10 AS width FROM sp), c AS (SELECT CAST(least(floor((tic0 - low) / width), 19) AS INT) AS bin, count(*) AS n FROM sp, e GROUP BY 1) "
    "SELECT CAST(g.bin AS INT) AS bin, low + g.bin * width AS lower, low + g.bin * width + width / 2 AS centre, low + g.bin * width + width AS upper, coalesce(c.n, 0) AS n FROM range(20) g(bin) CROSS JOIN e LEFT JOIN c ON c.bin = g.bin"
)
def histogram_bins(s, d):
    return stats.histogram(adapters.spectra(s, d), "tic0", 20)


_ZERO = "SELECT l_suppkey, {0} AS value FROM (SELECT l_suppkey, l_quantity - 25.0 AS x FROM lineitem) WHERE x <> 0 GROUP BY l_suppkey"


@query(_ZERO.format("avg(x)"), views=False)
def filtered_mean(s, d):
    return table(s, d, "lineitem").groupBy("l_suppkey").agg(stats.filtered_mean(F.col("l_quantity") - 25.0).alias("value"))


@query(_ZERO.format("median(x)"), views=False)
def filtered_median(s, d):
    return table(s, d, "lineitem").groupBy("l_suppkey").agg(stats.filtered_median(F.col("l_quantity") - 25.0).alias("value"))


@query(", r AS (SELECT spectrum_id, mz, intensity, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity, mz) - 1 AS k, count(*) OVER (PARTITION BY spectrum_id) AS n FROM pk) SELECT spectrum_id, mz, intensity FROM r WHERE k = n // 2")
def median_object(s, d):
    return stats.median_object(adapters.peaks(s, d).select("spectrum_id", "mz", "intensity"), ["spectrum_id"], ["intensity", "mz"])


@query(" SELECT spectrum_id, median(intensity) AS median_intensity FROM pk GROUP BY spectrum_id")
def median_peak(s, d):
    return adapters.peaks(s, d).groupBy("spectrum_id").agg(F.median("intensity").alias("median_intensity"))


@query("SELECT a.n_regionkey, a.n_nationkey AS first, a.n_name AS first_name, b.n_nationkey AS second, b.n_name AS second_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", views=False)
def combinations2(s, d):
    return stats.combinations(table(s, d, "nation"), "n_nationkey", "n_name", "n_regionkey")


_LINE = (
    "a AS (SELECT pr.*, q.x AS x0, q.y AS y0 FROM pr ASOF LEFT JOIN pts q ON pr.t >= q.x), b AS (SELECT a.*, q.x AS x1, q.y AS y1 FROM a ASOF LEFT JOIN pts q ON a.t <= q.x), "
    "v AS (SELECT *, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * (t - x0) / (x1 - x0) END AS y FROM b) "
)


@query(", pr AS (SELECT event_id, value AS t FROM events), pts AS (SELECT time AS x, tic0 AS y FROM sp WHERE ms_level = 1), " + _LINE + "SELECT event_id, t, round(y, 4) AS y FROM v")
def interpolate(s, d):
    probes = table(s, d, "events").select("event_id", F.col("value").alias("t"))
    points = adapters.spectra(s, d).where("ms_level = 1").select(F.col("time").alias("x"), F.col("tic0").alias("y0"))
    return ranges.interpolated(probes, "t", points, "x", "y0").select("event_id", "t", F.round("y", 4).alias("y"))


# ------------------------------------------------------------------------------------- precursors and calibration

_ERRORS = (
    ", hit AS (SELECT spectrum_id, mz, intensity, CASE WHEN mz < 160 THEN 0 ELSE 1 END AS rank, CASE WHEN mz < 160 THEN 147.112804 ELSE 175.118952 END::DOUBLE AS y1 FROM pk WHERE mz BETWEEN 147.112804 - 147.112804 * 0.02 AND 147.112804 + 147.112804 * 0.02 OR mz BETWEEN 175.118952 - 175.118952 * 0.02 AND 175.118952 + 175.118952 * 0.02), "
    "near AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id, rank ORDER BY abs(mz - y1), mz, intensity) AS k FROM hit), "
    "ion AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, rank DESC) AS j FROM near WHERE k = 1), "
    "err AS (SELECT id, time, intensity, (mz - y1) * 1e6 / y1 AS error, row_number() OVER (ORDER BY time, id) AS o FROM ion JOIN sp ON id = spectrum_id WHERE j = 1 AND ms_level = 2)"
)


@query(_ERRORS + " SELECT id, time, intensity, round(error, 3) AS error FROM err")
def fragment_errors(s, d):
    p, h = _both(s, d)
    return precursor.fragment_errors(p, h, 20_000.0).select("id", "time", "intensity", F.round("error", 3).alias("error"))


@query(
    _ERRORS + ", m AS (SELECT c.c, err.*, row_number() OVER (PARTITION BY c.c ORDER BY intensity DESC, o) AS r FROM range(1, 1000000) c(c) JOIN err ON o > c.c * 40 - 81 AND o <= c.c * 40 WHERE c.c <= (SELECT max(o) // 40 FROM err)), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY error, o) - 1 AS e, count(*) OVER (PARTITION BY c) AS n FROM m WHERE r <= 40), q AS (SELECT c, max(CASE WHEN e = n // 4 THEN error END) AS q1, max(CASE WHEN e = 3 * n // 4 THEN error END) AS q3 FROM b GROUP BY c), "
    "k AS (SELECT b.*, row_number() OVER (PARTITION BY b.c ORDER BY error, o) - 1 AS i, count(*) OVER (PARTITION BY b.c) AS kept FROM b JOIN q ON b.c = q.c WHERE n >= 5 AND error > q1 - 1.5 * (q3 - q1) AND error < q3 + 1.5 * (q3 - q1)) "
    "SELECT CAST(c AS BIGINT) AS checkpoint, time, round(error, 3) AS error FROM k WHERE i = kept // 2"
)
def calibration_points(s, d):
    p, h = _both(s, d)
    found = precursor.calibration_points(precursor.fragment_errors(p, h, 20_000.0), every=40, slots=81, top=40)
    return found.select(F.col("checkpoint").cast("bigint").alias("checkpoint"), "time", F.round("error", 3).alias("error"))


@query(", pr AS (SELECT id, time AS t, (iso_min + iso_max) / 2 AS mz FROM sp WHERE ms_level = 2), pts AS (SELECT CAST(r_regionkey AS DOUBLE) * 750.0 AS x, CAST(r_regionkey AS DOUBLE) * 2.5 - 3.0 AS y FROM region), " + _LINE + "SELECT id, t AS time, mz, round(mz - mz * y / 1e6, 6) AS calibrated_mz FROM v")
def calibrated_precursor(s, d):
    own = adapters.spectra(s, d).where("ms_level = 2").select("id", "time", ((F.col("iso_min") + F.col("iso_max")) / 2).alias("mz"))
    key = F.col("r_regionkey").cast("double")
    points = table(s, d, "region").select((key * 750.0).alias("time"), (key * 2.5 - 3.0).alias("error"))
    return precursor.calibrated(own, points, least=5).withColumn("calibrated_mz", F.round("calibrated_mz", 6))


@query(
    ", h AS (SELECT m.id, p.spectrum_id AS scan, p.mz, row_number() OVER (PARTITION BY m.id, p.spectrum_id ORDER BY abs(p.mz - (m.iso_min + m.iso_max) / 2), p.mz) AS k FROM sp m JOIN sp s1 ON s1.ms_level = 1 AND s1.time BETWEEN m.time - 5.0 AND m.time + 5.0 "
    "JOIN pk p ON p.spectrum_id = s1.id AND p.mz BETWEEN m.iso_min AND m.iso_max WHERE m.ms_level = 2) SELECT id, count(*) AS n_scans, round(median(mz), 6) AS refined_mz FROM h WHERE k = 1 GROUP BY id"
)
def refined_precursor(s, d):
    p, h = _both(s, d)
    return precursor.refined(h, p).select("id", "n_scans", F.round("refined_mz", 6).alias("refined_mz"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, CAST(c_nationkey AS DOUBLE)) AS mz FROM customer", views=False)
def precursor_coalesce(s, d):
    own = table(s, d, "customer")
    return own.select("c_custkey", precursor.precursor_rule(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), F.col("c_nationkey").cast("double")).alias("mz"))


# ------------------------------------------------------------------------------------------------------- formats


def _mgf_input(s, d):
    p, h = _both(s, d)
    arrays = p.groupBy("spectrum_id").agg(F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("peaks"))
    own = h.where("ms_level = 2").join(arrays, F.col("id") == F.col("spectrum_id"))
    return own.select("id", F.concat(F.lit("scan="), F.col("id").cast("string")).alias("title"), "time", ((F.col("iso_min") + F.col("iso_max")) / 2).alias("precursor_mz"), (F.col("id") % 3).cast("int").alias("charge"), "peaks")


_FIXED = "CAST(CAST(floor({0} * 1{1} + 0.5) AS BIGINT) // 1{1} AS VARCHAR) || '.' || lpad(CAST(CAST(floor({0} * 1{1} + 0.5) AS BIGINT) % 1{1} AS VARCHAR), {2}, '0')"
_SHORT = "regexp_replace(" + _FIXED.format("mz", "000", 3) + r", '(\.\d+?)0+$', '\1')"


@query(
    ", x AS (SELECT spectrum_id, string_agg(" + _SHORT + " || ' ' || CAST(CAST(floor(intensity + 0.5) AS BIGINT) AS VARCHAR), chr(10) ORDER BY mz, intensity) AS lines FROM pk GROUP BY spectrum_id) "
    "SELECT id, 'BEGIN IONS' || chr(10) || 'TITLE=scan=' || CAST(id AS VARCHAR) || chr(10) || 'PEPMASS=' || " + _FIXED.format("((iso_min + iso_max) / 2)", "0000", 4) + " || chr(10) || CASE WHEN id % 3 > 0 THEN 'CHARGE=' || CAST(id % 3 AS VARCHAR) || '+' || chr(10) ELSE '' END || 'RTINSECONDS=' || "
    "CASE WHEN id % 3 > 0 THEN " + _FIXED.format("time", "00", 2) + " ELSE " + _FIXED.format("time", "000", 3) + " END || chr(10) || 'SCANS=' || CAST(id AS VARCHAR) || chr(10) || lines || chr(10) || 'END IONS' AS value FROM sp JOIN x ON id = spectrum_id WHERE ms_level = 2"
)
def mgf_records(s, d):
    return mgf.records(_mgf_input(s, d))


@query(
    " SELECT id, 'scan=' || CAST(id AS VARCHAR) AS title, (iso_min + iso_max) / 2 AS precursor_mz, CASE WHEN id % 3 > 0 THEN CAST(id % 3 AS INT) END AS charge, count(*) AS n_peaks, CAST(sum(CAST(floor(mz * 1000 + 0.5) AS BIGINT)) AS BIGINT) AS sum_mz, CAST(sum(CAST(floor(intensity + 0.5) AS BIGINT)) AS BIGINT) AS sum_intensity "
    "FROM sp JOIN pk ON id = spectrum_id WHERE ms_level = 2 GROUP BY ALL"
)
def mgf_round_trip(s, d):
    back = mgf.records(_mgf_input(s, d)).select(mgf.parsed(F.col("value")).alias("s"))
    f = F.col("s.fields")
    total = lambda k, scale: F.aggregate("s.peaks", F.lit(0).cast("bigint"), lambda a, p: a + F.floor(p[k] * scale + 0.5).cast("bigint"))
    return back.select(
        f["SCANS"].cast("bigint").alias("id"), f["TITLE"].alias("title"), mgf.pepmass(f["PEPMASS"]).alias("precursor_mz"), mgf.charge(F.try_element_at(f, F.lit("CHARGE"))).alias("charge"), F.size("s.peaks").cast("bigint").alias("n_peaks"), total("mz", 1000).alias("sum_mz"), total("intensity", 1).alias("sum_intensity")
    )


@query(" SELECT e.event_id, sp.id AS frame_id, sp.time FROM (SELECT event_id, user_id * 4 AS parent FROM events) e JOIN sp ON sp.id = e.parent WHERE sp.ms_level = 1")
def rawscans_parent(s, d):
    text = F.concat((F.col("user_id") * 4).cast("string"), F.lit("-"), (F.col("user_id") * 4 + 3).cast("string"), F.lit(",7"))
    own = table(s, d, "events").select("event_id", mgf.parent_scan(text).alias("parent"))
    frames = adapters.spectra(s, d).where("ms_level = 1").select(F.col("id").alias("frame_id"), "time")
    return own.join(frames, F.col("parent") == F.col("frame_id")).select("event_id", "frame_id", "time")


@query("SELECT p_partkey, CAST(p_partkey AS DOUBLE) + 0.25 AS mz, CAST(p_size % 4 + 1 AS INT) AS charge FROM part", views=False)
def pepmass_charge(s, d):
    own = table(s, d, "part")
    mass = F.concat((F.col("p_partkey").cast("string")), F.lit(".25\t4157"))
    text = F.concat((F.col("p_size") % 4 + 1).cast("string"), F.lit("+"))
    return own.select("p_partkey", mgf.pepmass(mass).alias("mz"), mgf.charge(text).alias("charge"))


@query("SELECT p_partkey, p_name AS name, p_brand AS brand, CAST(p_size AS INT) AS level FROM part", views=False)
def cv_param_lookup(s, d):
    xml = xmlparams.tree_xml([xmlparams.cv_element(cv.MS_LEVEL, "ms level", F.col("p_size")), xmlparams.cv_element(cv.SAMPLE_NAME, "sample name", F.col("p_name"))], [xmlparams.user_element("brand", F.col("p_brand"))])
    own = table(s, d, "part").select("p_partkey", xmlparams.param_tree(xml).alias("t"))
    t = F.col("t")
    return own.select("p_partkey", xmlparams.cv_param(t, cv.SAMPLE_NAME).alias("name"), xmlparams.user_param(t, "brand").alias("brand"), xmlparams.ms_level(t, F.lit(False)).alias("level"))


@query(" SELECT id, (iso_min + iso_max) / 2 AS target_mz, iso_min AS min_mz, iso_max AS max_mz, iso_min + 10.0 AS selected_mz, CAST(id % 3 + 1 AS INT) AS charge, 'HCD' AS activation FROM sp WHERE ms_level = 2")
def precursor_xml(s, d):
    own = adapters.spectra(s, d).where("ms_level = 2")
    e = xmlparams.cv_element
    half = (F.col("iso_max") - F.col("iso_min")) / 2
    xml = F.concat(
        F.lit("<precursorList count=\"1\"><precursor><isolationWindow>"), e(cv.ISOLATION_TARGET, "target", (F.col("iso_min") + F.col("iso_max")) / 2), e(cv.ISOLATION_LOWER, "lower", half), e(cv.ISOLATION_UPPER, "upper", half),
        F.lit("</isolationWindow><selectedIonList count=\"1\"><selectedIon>"), e(cv.SELECTED_ION_MZ, "mz", F.col("iso_min") + 10.0), e(cv.CHARGE_STATE, "charge", F.col("id") % 3 + 1),
        F.lit("</selectedIon></selectedIonList><activation>"), e("MS:1000422", "hcd", F.lit("")), F.lit("</activation></precursor></precursorList>"),
    )
    return own.select("id", xmlparams.precursors(xml).alias("p")).select("id", "p.target_mz", "p.min_mz", "p.max_mz", "p.selected_mz", "p.charge", "p.activation")


@query("SELECT o_orderkey AS id, 'FTMS' AS analyzer, CAST(2 AS INT) AS level, CAST(o_custkey AS DOUBLE) AS target_mz, 'hcd' AS activation, 35.0::DOUBLE AS energy, 120.0::DOUBLE AS min_mz, CAST(o_custkey AS DOUBLE) + 1000.0 AS max_mz FROM orders", views=False)
def thermo_filter(s, d):
    text = F.concat(F.lit("FTMS + c NSI d Full ms2 "), F.col("o_custkey").cast("string"), F.lit(".00@hcd35.00 [120.00-"), (F.col("o_custkey") + 1000).cast("string"), F.lit(".00]"))
    own = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), thermo.scan_filter(text).alias("f"))
    t = F.get("f.targets", 0)
    return own.select("id", "f.analyzer", "f.level", t["mz"].alias("target_mz"), t["activation"].alias("activation"), t["energy"].alias("energy"), "f.min_mz", "f.max_mz")


@query("SELECT CAST(-(o_custkey % 3) * 15 AS INT) AS cv, count(*) AS n FROM orders GROUP BY 1", views=False)
def faims_cv(s, d):
    text = F.concat(F.lit("FTMS + p NSI cv="), (-(F.col("o_custkey") % 3) * 15).cast("string"), F.lit(".00 Full ms [350-1500]"))
    value = ingest.faims_voltage(text).cast("double").cast("int")
    return table(s, d, "orders").groupBy(value.alias("cv")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name || chr(65533) || p_brand AS text FROM part", views=False)
def clean_xml_chars(s, d):
    return table(s, d, "part").select("p_partkey", xmlparams.clean_characters(F.concat("p_name", F.lit("\x02"), "p_brand")).alias("text"))


# ------------------------------------------------------------------------------------------------------- frames


@query(
    " SELECT sp.id AS frame_id, l.l_linenumber AS first_scan, sp.time + l.l_linenumber / 10000.0 AS time, coalesce(CASE WHEN p.p_size > 25 THEN p.p_retailprice END, CAST(p.p_size AS DOUBLE)) AS precursor_mz FROM lineitem l JOIN sp ON l.l_orderkey = sp.id JOIN part p ON l.l_partkey = p.p_partkey WHERE sp.ms_level = 2"
)
def pasef_join(s, d):
    frames = adapters.spectra(s, d).select(F.col("id").alias("Id"), F.col("time").alias("Time"), F.when(F.col("ms_level") == 2, 8).otherwise(99).alias("MsMsType"))
    windows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("Frame"), F.col("l_linenumber").alias("ScanNumBegin"), (F.col("l_linenumber") + 10).alias("ScanNumEnd"), F.col("l_partkey").alias("Precursor"))
    parts = table(s, d, "part")
    own = parts.select(F.col("p_partkey").alias("Id"), F.when(F.col("p_size") > 25, F.col("p_retailprice")).alias("MonoisotopicMz"), F.col("p_size").cast("double").alias("AverageMz"), F.lit(2).alias("Charge"))
    return ingest.frame_headers(frames, windows, own).select("frame_id", "first_scan", "time", "precursor_mz")


@query(
    ", own AS (SELECT l_orderkey AS frame_id, l_linenumber AS title, l_extendedprice AS rt FROM lineitem), s1 AS (SELECT id, time FROM sp WHERE ms_level = 1) SELECT id AS frame_id, time, 1 AS ms_level, 0 AS rank FROM s1 UNION ALL "
    "SELECT frame_id, time + k / 1000, 2, CAST(k AS INT) FROM (SELECT frame_id, s1.time, row_number() OVER (PARTITION BY frame_id ORDER BY rt, title) AS k FROM own JOIN s1 ON own.frame_id = s1.id)"
)
def mgf_override_union(s, d):
    survey = adapters.spectra(s, d).where("ms_level = 1").select(F.col("id").alias("frame_id"), "time")
    own = table(s, d, "lineitem").select(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("title"), F.col("l_extendedprice").alias("rt"))
    return ingest.overridden(survey, own)


def _array_rows(s, d):
    own = adapters.peaks(s, d).groupBy("spectrum_id").agg(F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("p"))
    return own.select("spectrum_id", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"))


@query(
    ", p AS (SELECT spectrum_id, mz, intensity, row_number() OVER (PARTITION BY spectrum_id ORDER BY mz, intensity) AS i FROM pk), o AS (SELECT *, mz * 20000.0 / 1e6 AS reach, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, i) AS k FROM p), "
    "x AS (WITH RECURSIVE r AS (SELECT spectrum_id, k, [{'mz': mz, 'reach': reach, 'intensity': intensity, 'i': i}] AS tops FROM o WHERE k = 1 UNION ALL SELECT o.spectrum_id, o.k, CASE WHEN len([1 FOR t IN r.tops IF abs(o.mz - t.mz) <= t.reach]) > 0 THEN r.tops "
    "ELSE list_append(r.tops, {'mz': o.mz, 'reach': o.reach, 'intensity': o.intensity, 'i': o.i}) END FROM r JOIN o ON o.spectrum_id = r.spectrum_id AND o.k = r.k + 1) SELECT spectrum_id, unnest(arg_max(tops, k)) AS t FROM r GROUP BY spectrum_id) "
    "SELECT x.spectrum_id, round(sum(p.mz * p.intensity) / sum(p.intensity), 10) AS mz, x.t.intensity AS intensity FROM x JOIN p ON p.spectrum_id = x.spectrum_id AND abs(p.mz - x.t.mz) <= x.t.reach GROUP BY x.spectrum_id, x.t"
)
def peak_clusters(s, d):
    own = ingest.clustered(_array_rows(s, d), 20_000.0)
    return own.select("spectrum_id", F.inline(F.arrays_zip("mz", "intensity"))).select("spectrum_id", F.round("mz", 10).alias("mz"), "intensity")


@query(" SELECT * FROM pk")
def blob_round_trip(s, d):
    back = codec.decode_tiles(codec.encode_spectra(spectra.spectrum_arrays(adapters.peaks(s, d))))
    return back.select("spectrum_id", "mz", "intensity", *[F.round(c, 4).alias(c) for c in ("lhwhm", "rhwhm")])  # 32 bits in the blob


_STREAM = "WITH e AS (SELECT event_type AS run_id, event_id AS id, epoch_us(ts) / 1e6 AS time, CAST(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 2 END AS INT) AS ms_level FROM events) "


@query(_STREAM + "SELECT *, row_number() OVER w AS new_id, CAST(sum(CASE WHEN ms_level = 1 THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS new_cycle FROM e WINDOW w AS (PARTITION BY run_id ORDER BY time, id)", views=False)
def stream_resequence(s, d):
    """The events as a stream of spectra, put in order with bounded lateness; read as far as it has come (availableNow)
    into a table in the shared folder. The table is one file and so one batch, which is why its order is the whole one."""
    from peakloom.plans.streams import resequenced_events

    return resequenced_events(s, d)


@query(
    _STREAM + ", a AS (WITH RECURSIVE r AS (SELECT run_id, ms_level, min(time) AS t FROM e GROUP BY run_id, ms_level UNION ALL SELECT r.run_id, r.ms_level, (SELECT min(e.time) FROM e WHERE e.run_id = r.run_id AND e.ms_level = r.ms_level AND e.time - r.t > 6000.0) AS t FROM r WHERE r.t IS NOT NULL) "
    "SELECT *, lead(t) OVER (PARTITION BY run_id, ms_level ORDER BY t) AS until FROM r WHERE t IS NOT NULL) "
    "SELECT e.run_id, e.ms_level, a.t AS row_start, arg_min(e.id, (e.time, e.id)) AS first_id, arg_max(e.id, (e.time, e.id)) AS last_id, count(*) AS n FROM a JOIN e ON e.run_id = a.run_id AND e.ms_level = a.ms_level AND e.time >= a.t AND e.time < a.until WHERE a.until IS NOT NULL GROUP BY e.run_id, e.ms_level, a.t",
    views=False,
)
def stream_time_rows(s, d):
    """The time rows that a stream of events has closed when all of it is read; each group's last one is still open."""
    from peakloom.plans.streams import time_rows_of_events

    return time_rows_of_events(s, d, 6_000.0)


# ------------------------------------------------------------------------------------- single operators, one query each


@query(_DENSE + ", r AS (SELECT *, 401.0 + label * 1.6 AS x, row_number() OVER (PARTITION BY vec_id ORDER BY abs(mz - (401.0 + label * 1.6)), i) AS k FROM f) SELECT vec_id, CAST(mz AS DOUBLE) AS mz, intensity FROM r WHERE k = 1 AND abs(CAST(mz AS DOUBLE) - CAST(x AS DOUBLE)) <= CAST(x AS DOUBLE) * 400.0 / 1e6", views=False)
def nearest_peak(s, d):
    own = _dense(s, d).select("vec_id", spectra.nearest_peak(F.col("peaks"), F.lit(401.0) + F.col("label") * 1.6, 400.0).alias("p"))
    return own.where("p is not null").select("vec_id", F.col("p.mz").cast("double").alias("mz"), "p.intensity")


@query(", w AS (SELECT DISTINCT iso_min, iso_max FROM sp WHERE ms_level = 2) SELECT c.c_custkey, w.iso_min, w.iso_max FROM (SELECT c_custkey, abs(c_acctbal) / 10 AS lo, abs(c_acctbal) / 10 + 30.0 AS hi FROM customer) c JOIN w ON c.lo <= w.iso_max AND w.iso_min <= c.hi")
def window_overlaps(s, d):
    own = table(s, d, "customer").select("c_custkey", (F.abs("c_acctbal") / 10).alias("lo")).withColumn("hi", F.col("lo") + 30.0)
    windows = adapters.spectra(s, d).where("ms_level = 2").select("iso_min", "iso_max").distinct()
    return ranges.overlap_join(own, "lo", "hi", windows, "iso_min", "iso_max", 25.0).select("c_custkey", "iso_min", "iso_max")


@query(" SELECT spectrum_id, mz, intensity FROM pk WHERE mz BETWEEN 200.0 AND 600.0")
def tile_peaks_in_range(s, d):
    tiles = codec.encode_spectra(spectra.spectrum_arrays(adapters.peaks(s, d)))
    return codec.decode_tiles(tiles, min_mz=200.0, max_mz=600.0).select("spectrum_id", "mz", "intensity")


@query(" SELECT id, (iso_min + iso_max) / 2 AS precursor_mz FROM sp WHERE ms_level = 2")
def precursor_main(s, d):
    return precursor.main_precursor(adapters.spectra(s, d))


def _with_xml(s, d):
    """Level 2 headers with a scan list, of which every third has no value, and a precursor list."""
    e, u = xmlparams.cv_element, xmlparams.user_element
    mono = F.when(F.col("id") % 3 > 0, F.col("iso_min") + 5.0).otherwise(F.lit(0.0))
    scan = F.concat(F.lit('<scanList count="1"><scan>'), e(cv.SCAN_START_TIME, "scan start time", F.col("time")), e(cv.FILTER_STRING, "filter string", F.concat(F.lit("FTMS ms2 "), F.col("id").cast("string"))), u("[Thermo Trailer Extra]Monoisotopic M/Z:", mono), F.lit("<scanWindowList><scanWindow>"), e("MS:1000501", "lower", F.lit(100.0)), e("MS:1000500", "upper", F.col("iso_max") + 900.0), F.lit("</scanWindow></scanWindowList></scan></scanList>"))
    return adapters.spectra(s, d).where("ms_level = 2").withColumn("scan_list", scan)


@query(" SELECT id, CASE WHEN id % 3 > 0 THEN iso_min + 5.0 ELSE (iso_min + iso_max) / 2 END AS precursor_mz FROM sp WHERE ms_level = 2")
def precursor_vendor(s, d):
    own = _with_xml(s, d)
    return precursor.estimated(own, adapters.peaks(s, d), "vendor")


@query(
    ", h AS (SELECT m.id, p.spectrum_id AS scan, p.mz, row_number() OVER (PARTITION BY m.id, p.spectrum_id ORDER BY abs(p.mz - (m.iso_min + m.iso_max) / 2), p.mz) AS k FROM sp m JOIN sp s1 ON s1.ms_level = 1 AND s1.time BETWEEN m.time - 5.0 AND m.time + 5.0 "
    "JOIN pk p ON p.spectrum_id = s1.id AND p.mz BETWEEN m.iso_min AND m.iso_max WHERE m.ms_level = 2), r AS (SELECT id, median(mz) AS mz FROM h WHERE k = 1 GROUP BY id) "
    "SELECT sp.id, round(coalesce(r.mz, (iso_min + iso_max) / 2), 6) AS precursor_mz FROM sp LEFT JOIN r ON r.id = sp.id WHERE ms_level = 2"
)
def precursor_estimated(s, d):
    p, h = _both(s, d)
    return precursor.estimated(h, p, "refined").select("id", F.round("precursor_mz", 6).alias("precursor_mz"))


@query(" SELECT id, 1 AS n, time, 'FTMS ms2 ' || CAST(id AS VARCHAR) AS filter, CAST(100.0 AS DOUBLE) AS min_mz, iso_max + 900.0 AS max_mz FROM sp WHERE ms_level = 2")
def scan_list_xml(s, d):
    own = _with_xml(s, d).select("id", F.explode(F.array(xmlparams.scans(F.col("scan_list")))).alias("x"))
    return own.select("id", "x.n", "x.time", "x.filter", "x.min_mz", "x.max_mz")


@query("SELECT s_suppkey, k.kind, k.place, CASE k.kind WHEN 'source' THEN s_name WHEN 'analyzer' THEN 'orbitrap' ELSE 'multiplier' END AS name FROM supplier, (VALUES ('source', 1), ('analyzer', 2), ('detector', 3)) k(kind, place)", views=False)
def component_list_xml(s, d):
    xml = xmlparams.component_list([("source", 1, F.col("s_name")), ("analyzer", 2, F.lit("orbitrap")), ("detector", 3, F.lit("multiplier"))])
    own = table(s, d, "supplier").select("s_suppkey", F.explode(xmlparams.components(xml)).alias("c"))
    return own.select("s_suppkey", "c.kind", F.col("c.order").alias("place"), "c.name")


@query("SELECT o_orderkey AS id, 'scan=' || CAST(o_orderkey AS VARCHAR) AS title, '<cvParam name=\"a\"/>' AS params, '<scanList><scan/></scanList>' AS scan_list, CASE WHEN o_orderkey % 4 <> 0 THEN '<precursor spectrumRef=\"' || CAST(o_custkey AS VARCHAR) || '\"/>' END AS precursor FROM orders", views=False)
def spectrum_xml_parts(s, d):
    n = F.col("o_orderkey").cast("string")
    precursors = F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit('<precursorList count="1"><precursor spectrumRef="'), F.col("o_custkey").cast("string"), F.lit('"/></precursorList>'))).otherwise(F.lit(""))
    xml = F.concat(F.lit('<spectrum id="scan='), n, F.lit('"><cvParam name="a"/><scanList><scan/></scanList>'), precursors, F.lit("</spectrum>"))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), thermo.spectrum_parts(xml).alias("x")).select("id", "x.*")


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS utc, CAST(epoch(o_orderdate) AS BIGINT) AS seconds, CAST(epoch(o_orderdate) AS BIGINT) - 7200 AS shifted FROM orders", views=False)
def date_formats(s, d):
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    utc, shifted = dates.utc_time(F.concat(text, F.lit("Z"))), dates.offset_time(F.concat(text, F.lit(".000+02:00")))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), dates.utc_text(utc).alias("utc"), F.unix_seconds(utc).alias("seconds"), F.unix_seconds(shifted).alias("shifted"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS mz_ms1, CAST(p_size * 100 AS DOUBLE) AS mz_msn, 15.0::DOUBLE AS time_ms1, CASE WHEN p_size % 2 = 0 THEN 0.0::DOUBLE END AS time_msn, p_size % 3 <> 0 AS lossless, CASE WHEN p_size % 4 = 0 THEN 'DDA' WHEN p_size % 4 = 1 THEN 'SWATH' ELSE 'UNKNOWN' END AS mode FROM part", views=False)
def store_header_params(s, d):
    """What parameter trees say about a store: its tiles' sizes by their own names, whether peaks were left out, the mode."""
    u, size = xmlparams.user_element, F.col("p_size")
    odd = F.when(size % 2 == 0, u("msn_bb_time_width", F.lit("0"))).otherwise(F.lit(""))
    mode = F.when(size % 4 == 0, F.lit("DDA acquisition")).when(size % 4 == 1, F.lit("SWATH acquisition")).otherwise(F.lit("other"))
    xml = xmlparams.tree_xml([xmlparams.cv_element(cv.ACQUISITION_PARAMETER, "acquisition parameter", mode)], [u("ms1_bb_mz_width", size), u("msn_bb_mz_width", size * 100), u("ms1_bb_time_width", F.lit("15")), odd, u("is_lossless", (size % 3 != 0).cast("string"))])
    own = table(s, d, "part").select("p_partkey", xmlparams.param_tree(xml).alias("t"))
    return own.select("p_partkey", store.tile_sizes(F.col("t")).alias("s"), store.lossless(F.col("t")).alias("lossless"), store.acquisition_mode(F.col("t")).alias("mode")).select("p_partkey", "s.*", "lossless", "mode")


# ------------------------------------------------------------------------------------------------ through a tile store


def _stored_run(s, d) -> str:
    """The path of a store, in parts, of all spectra and peaks, written for the query that asks for it."""
    path = local_folder(s)
    p, h = _both(s, d)
    store.write_parts(adapters.with_cycle(h), p, path, codec.Encoding(64, 64, fitted=True), info=store.RunInfo("own run", "2020-01-02T03:04:05Z", "SWATH", "own sample", "own instrument", (("reader", "1"), ("own converter", "2"))))
    return path


_FULL = "(SELECT * FROM sp WHERE id IN (SELECT spectrum_id FROM pk))"


@query(" SELECT id, time, ms_level, cycle, CASE WHEN ms_level = 2 THEN (iso_min + iso_max) / 2 END AS main_precursor_mz, n AS data_points_count, t AS tic FROM " + _FULL + " f JOIN (SELECT spectrum_id, count(*) AS n, sum(intensity) AS t FROM pk GROUP BY spectrum_id) c ON c.spectrum_id = f.id")
def store_headers(s, d):
    own = store.headers(s, _stored_run(s, d), ["id", "time", "ms_level", "cycle", "main_precursor_mz", "data_points_count", "tic"])
    return own.select("id", "time", _int("ms_level"), "cycle", "main_precursor_mz", "data_points_count", "tic")


@query(" SELECT spectrum_id, mz, intensity FROM pk")
def store_peaks(s, d):
    return store.peaks(s, _stored_run(s, d)).select("spectrum_id", "mz", "intensity")


@query(
    ", g AS (SELECT id, time, ms_level, CASE WHEN ms_level = 2 THEN iso_min END AS iso FROM " + _FULL + "), a AS (WITH RECURSIVE r AS (SELECT ms_level, iso, min(time) AS t FROM g GROUP BY ms_level, iso UNION ALL "
    "SELECT r.ms_level, r.iso, (SELECT min(g.time) FROM g WHERE g.ms_level = r.ms_level AND g.iso IS NOT DISTINCT FROM r.iso AND g.time - r.t > CASE WHEN r.ms_level = 1 THEN 15.0 ELSE 0.0 END) AS t FROM r WHERE r.t IS NOT NULL) SELECT * FROM r WHERE t IS NOT NULL), "
    "q AS (SELECT g.*, (SELECT max(a.t) FROM a WHERE a.ms_level = g.ms_level AND a.iso IS NOT DISTINCT FROM g.iso AND a.t <= g.time) AS row_start FROM g), w AS (SELECT *, min(id) OVER v AS first_id, max(id) OVER v AS last_id FROM q WINDOW v AS (PARTITION BY ms_level, iso, row_start)), "
    "b AS (SELECT w.ms_level, w.iso, w.row_start, CAST(floor(p.mz / CASE WHEN w.ms_level = 1 THEN 5.0 ELSE 10000.0 END) AS BIGINT) AS bin, min(first_id) AS first_spectrum_id, max(last_id) AS last_spectrum_id FROM pk p JOIN w ON w.id = p.spectrum_id GROUP BY ALL) "
    "SELECT CAST(ms_level AS BIGINT) AS ms_level, CAST(bin * CASE WHEN ms_level = 1 THEN 5 ELSE 10000 END AS DOUBLE) AS begin_mz, first_spectrum_id, last_spectrum_id, count(*) AS n FROM b GROUP BY ALL"
)
def store_tiles(s, d):
    """Tiles by their run slice and spectra: cut by the sizes of their level, in rows anchored at their first spectrum."""
    path = _stored_run(s, d)
    slices = store.table(s, path, "run_slice").select(F.col("id").alias("slice"), "ms_level", "begin_mz")
    own = store.table(s, path, "bounding_box", ["run_slice_id", "first_spectrum_id", "last_spectrum_id"]).join(slices, F.col("run_slice_id") == F.col("slice"))
    return own.groupBy("ms_level", "begin_mz", "first_spectrum_id", "last_spectrum_id").agg(F.count("*").alias("n"))


@query("SELECT 'own run' AS run, '2020-01-02T03:04:05Z' AS start, 'SWATH' AS mode, 'own sample' AS sample, 'own instrument' AS instrument, '2' AS converter_version, '0.7' AS model_version, CAST(1 AS BIGINT) AS steps", views=False)
def store_metadata(s, d):
    path = _stored_run(s, d)
    own = store.run_metadata(s, path)
    return own.select("run", "start", "mode", "sample", "instrument", F.lit(store.software_version(s, path, "CONVERTER")).alias("converter_version"), F.lit(store.model_version(s, path)).alias("model_version"), F.size("processing").cast("bigint").alias("steps"))
