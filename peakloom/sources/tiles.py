"""The peaks of tile stores as a Spark data source: tiles are read by ranges of their number and decoded where they are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource

from peakloom.sources import sqlite
from peakloom.sources.codec import Encoding, decode, decode_tiles_at_once

VALUES = ("mz", "intensity", "lhwhm", "rhwhm")


class TileReader(sqlite.SQLiteReader):
    def __init__(self, options: dict, schema: T.StructType):
        super().__init__(options, schema)
        self.range = float(options.get("min_mz", -1)), float(options.get("max_mz", -1))

    def read(self, part: sqlite.RowRange) -> Iterator[pa.RecordBatch]:
        with sqlite.opened(part.path) as db:
            kinds = {i: Encoding(mz, intensity, mode == "fitted", order == "big_endian") for i, mz, intensity, mode, order in db.execute("SELECT id, mz_precision, intensity_precision, mode, byte_order FROM data_encoding")}
            used = [r[0] for r in db.execute("SELECT DISTINCT data_encoding_id FROM spectrum LIMIT 2")]
            found = db.execute("SELECT data, first_spectrum_id, last_spectrum_id FROM bounding_box WHERE rowid BETWEEN ? AND ?", (part.low, part.high))
            while rows := found.fetchmany(sqlite.BATCH_ROWS):
                if len(used) == 1 and used[0] in kinds:
                    ids, peaks = decode_tiles_at_once([r[0] for r in rows], kinds[used[0]], *self.range)
                    yield self._batch([ids], [peaks])
                else:
                    parts = [x for data, first, last in rows for x in decode(data, self._encodings(db, kinds, first, last), *self.range)]
                    yield self._batch([np.full(len(p), i, np.int64) for i, p in parts], [p for _, p in parts])

    @staticmethod
    def _encodings(db, kinds: dict[int, Encoding], first: int, last: int) -> dict[int, Encoding]:
        own = db.execute("SELECT id, data_encoding_id FROM spectrum WHERE id BETWEEN ? AND ?", (first, last))
        return {i: kinds[k] for i, k in own if k in kinds}

    @staticmethod
    def _batch(ids: list[np.ndarray], peaks: list[np.ndarray]) -> pa.RecordBatch:
        get = lambda k: np.concatenate([np.empty(0), *[p[k].astype(float) if k in p.dtype.names else np.zeros(len(p)) for p in peaks]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *ids])), *[pa.array(get(k)) for k in VALUES]], ["spectrum_id", *VALUES])


class TileSource(DataSource):
    """spark.read.format("tiles").option("path", files, a line each).option("dbtable", "bounding_box").load()"""

    @classmethod
    def name(cls) -> str:
        return "tiles"

    def schema(self) -> str:
        return "spectrum_id long, mz double, intensity double, lhwhm double, rhwhm double"

    def reader(self, schema: T.StructType) -> TileReader:
        return TileReader(self.options, schema)
