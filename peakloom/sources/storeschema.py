"""The tables of a tile store. Fixed values of the file format: names of tables, columns and indexes, as they must be for
other readers. The name of the header table differs between writers and is a parameter."""

from __future__ import annotations

#: Tables other than the header, by name: their columns.
TABLES = {
    "data_processing": "id INTEGER PRIMARY KEY AUTOINCREMENT, name TEXT NOT NULL",
    "scan_settings": "id INTEGER PRIMARY KEY AUTOINCREMENT, param_tree, shared_param_tree_id INTEGER",
    "data_encoding": "id INTEGER PRIMARY KEY AUTOINCREMENT, mode TEXT(10) NOT NULL, compression TEXT, byte_order TEXT(13) NOT NULL, mz_precision INTEGER NOT NULL, intensity_precision INTEGER NOT NULL, param_tree TEXT",
    "software": "id INTEGER PRIMARY KEY AUTOINCREMENT, name TEXT NOT NULL, version TEXT NOT NULL, param_tree TEXT NOT NULL, shared_param_tree_id INTEGER",
    "processing_method": "id INTEGER PRIMARY KEY AUTOINCREMENT, number INTEGER NOT NULL, param_tree TEXT NOT NULL, shared_param_tree_id INTEGER, data_processing_id INTEGER NOT NULL, software_id INTEGER NOT NULL",
    "sample": "id INTEGER PRIMARY KEY AUTOINCREMENT, name TEXT NOT NULL, param_tree TEXT, shared_param_tree_id INTEGER",
    "source_file": "id INTEGER PRIMARY KEY AUTOINCREMENT, name TEXT NOT NULL, location TEXT NOT NULL, param_tree TEXT NOT NULL, shared_param_tree_id INTEGER",
    "shared_param_tree": "id INTEGER PRIMARY KEY AUTOINCREMENT, data TEXT NOT NULL, schema_name TEXT NOT NULL",
    "instrument_configuration": "id INTEGER PRIMARY KEY AUTOINCREMENT, name TEXT NOT NULL, param_tree TEXT, component_list TEXT NOT NULL, shared_param_tree_id INTEGER, software_id INTEGER NOT NULL",
    "run": "id INTEGER PRIMARY KEY AUTOINCREMENT, name TEXT NOT NULL, start_timestamp TEXT, param_tree TEXT, shared_param_tree_id INTEGER, sample_id INTEGER NOT NULL, default_instrument_config_id INTEGER NOT NULL, default_source_file_id INTEGER, default_scan_processing_id INTEGER NOT NULL, default_chrom_processing_id INTEGER NOT NULL",
    "run_slice": "id INTEGER PRIMARY KEY AUTOINCREMENT, ms_level INTEGER NOT NULL, number INTEGER NOT NULL, begin_mz REAL NOT NULL, end_mz REAL NOT NULL, param_tree TEXT, run_id INTEGER NOT NULL",
    "spectrum": "id INTEGER PRIMARY KEY AUTOINCREMENT, initial_id INTEGER NOT NULL, title TEXT NOT NULL, cycle INTEGER NOT NULL, time REAL NOT NULL, ms_level INTEGER NOT NULL, activation_type TEXT(10), tic REAL NOT NULL, base_peak_mz REAL NOT NULL, base_peak_intensity REAL NOT NULL, main_precursor_mz REAL, main_precursor_charge INTEGER, data_points_count INTEGER NOT NULL, param_tree TEXT NOT NULL, scan_list TEXT, precursor_list TEXT, product_list TEXT, shared_param_tree_id INTEGER, instrument_configuration_id INTEGER, source_file_id INTEGER, run_id INTEGER NOT NULL, data_processing_id INTEGER, data_encoding_id INTEGER NOT NULL, bb_first_spectrum_id INTEGER NOT NULL",
    "bounding_box": "id INTEGER PRIMARY KEY AUTOINCREMENT, data BLOB NOT NULL, run_slice_id INTEGER NOT NULL, first_spectrum_id INTEGER NOT NULL, last_spectrum_id INTEGER NOT NULL",
    "cv": "id TEXT(10) NOT NULL PRIMARY KEY, full_name TEXT NOT NULL, version TEXT(10), uri TEXT NOT NULL",
    "cv_term": "accession TEXT NOT NULL PRIMARY KEY, name TEXT NOT NULL, unit_accession TEXT, cv_id TEXT(10) NOT NULL",
    "cv_unit": "accession TEXT NOT NULL PRIMARY KEY, name TEXT NOT NULL, cv_id TEXT(10) NOT NULL",
    "user_term": "id INTEGER PRIMARY KEY AUTOINCREMENT, name TEXT NOT NULL, type TEXT NOT NULL, unit_accession TEXT",
}
HEADER = "version TEXT(10) NOT NULL PRIMARY KEY, creation_timestamp TEXT NOT NULL, file_content TEXT NOT NULL, contacts TEXT NOT NULL, param_tree TEXT NOT NULL"
#: The tables with rows of spectra and tiles; the others are the same in each part of a store.
RUN_TABLES = ("spectrum", "bounding_box")
#: Indexes over tiles: of level 1 by m/z and time, of fragment spectra by level and isolation window too.
RTREES = {
    "bounding_box_rtree": "id, min_mz, max_mz, min_time, max_time",
    "bounding_box_msn_rtree": "id, min_ms_level, max_ms_level, min_parent_mz, max_parent_mz, min_mz, max_mz, min_time, max_time",
}
#: Other indexes, by name: table and columns.
INDEXES = {
    "spectrum_initial_id_idx": "spectrum (initial_id, run_id)",
    "spectrum_ms_level_idx": "spectrum (ms_level, run_id)",
    "spectrum_bb_first_spectrum_id_idx": "spectrum (bb_first_spectrum_id)",
    "run_slice_mz_range_idx": "run_slice (begin_mz, end_mz, ms_level, run_id)",
    "bounding_box_run_slice_idx": "bounding_box (run_slice_id)",
    "bounding_box_first_spectrum_idx": "bounding_box (first_spectrum_id)",
}
#: Names of the user params that hold the sizes of tiles, and the one that says whether peaks were left out.
SIZE_PARAMS = {"mz_ms1": "ms1_bb_mz_width", "mz_msn": "msn_bb_mz_width", "time_ms1": "ms1_bb_time_width", "time_msn": "msn_bb_time_width"}
LOSS_PARAM = "is_lossless"


def ddl(header_table: str) -> str:
    """All tables of a new store."""
    plain = [f"CREATE TABLE {name} ({columns});" for name, columns in (TABLES | {header_table: HEADER}).items()]
    return "\n".join(plain + [f"CREATE VIRTUAL TABLE {name} USING rtree({columns});" for name, columns in RTREES.items()])


def index_ddl() -> str:
    return "\n".join(f"CREATE INDEX {name} ON {on};" for name, on in INDEXES.items())
