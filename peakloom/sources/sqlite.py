"""SQLite files as Spark tables: tile stores and instrument metadata.

A Python data source reads one table, of one file or of several; it is split by ranges of rowid, so that tasks read apart. SQLite needs a local
path that every executor can open; import a store once (import_store) and query the Parquet tables from then on.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_KINDS = {"INT": T.LongType(), "INTEGER": T.LongType(), "BIGINT": T.LongType(), "REAL": T.DoubleType(), "FLOAT": T.DoubleType(), "DOUBLE": T.DoubleType(), "BLOB": T.BinaryType()}


def opened(path: str) -> closing[sqlite3.Connection]:
    return closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class RowRange(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        super().__init__(None)
        self.path, self.low, self.high = path, low, high


#: Rows that a reader holds at once.
BATCH_ROWS = 4_096
_CASTS = {T.LongType(): (int, pa.int64()), T.DoubleType(): (float, pa.float64()), T.BinaryType(): (bytes, pa.binary())}


def _array(values: tuple, kind: T.DataType) -> pa.Array:
    """A column of what SQLite gave, whose values have types of their own, as one type."""
    cast, arrow = _CASTS.get(kind, (str, pa.string()))
    if not all(v is None or type(v) is cast for v in values):
        values = [None if v is None else cast(v) for v in values]
    return pa.array(values, arrow)


class SQLiteReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.paths, self.table, self.parts, self.schema = options["path"].split("\n"), options["dbtable"], int(options.get("partitions", 8)), schema

    def partitions(self) -> list[RowRange]:
        out = []
        for path in self.paths:
            with opened(path) as db:
                # apart: each is one look at an end of the table, both together would be a scan
                low, high = (db.execute(f"SELECT {f}(rowid) FROM {_quoted(self.table)}").fetchone()[0] for f in ("min", "max"))
            if low is not None:
                step = -(-(high - low + 1) // max(1, -(-self.parts // len(self.paths))))
                out += [RowRange(path, a, min(a + step - 1, high)) for a in range(low, high + 1, step)]
        return out or [RowRange(self.paths[0], 0, -1)]

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        names = ", ".join(_quoted(f.name) for f in self.schema)
        with opened(part.path) as db:
            found = db.execute(f"SELECT {names} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ?", (part.low, part.high))
            while rows := found.fetchmany(BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([_array(c, f.dataType) for c, f in zip(zip(*rows, strict=True), self.schema, strict=True)], self.schema.names)


class SQLiteSource(DataSource):
    """spark.read.format("sqlite").option("path", files, a line each).option("dbtable", name).load()"""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        with opened(self.options["path"].split("\n")[0]) as db:
            columns = db.execute(f"PRAGMA table_info({_quoted(self.options['dbtable'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['dbtable']}")
        return T.StructType([T.StructField(c[1], _KINDS.get((c[2] or "").upper().split("(")[0].strip(), T.StringType())) for c in columns])

    def reader(self, schema: T.StructType) -> SQLiteReader:
        return SQLiteReader(self.options, schema)


def load(spark: SparkSession, source: str, paths: list[str], name: str, partitions: int = 8) -> DataFrameReader:
    return spark.read.format(source).option("path", "\n".join(paths)).option("dbtable", name).option("partitions", str(partitions))


def table(spark: SparkSession, path: str | list[str], name: str, partitions: int = 8, columns: list[str] | None = None) -> DataFrame:
    """A table of a SQLite file, or of several that have the same columns; those are read by name, others than columns not
    at all if these are given. A missing file raises."""
    paths = [path] if isinstance(path, str) else path
    spark.dataSource.register(SQLiteSource)
    reader = load(spark, "sqlite", paths, name, partitions)
    if columns is not None:
        whole = SQLiteSource({"path": paths[0], "dbtable": name}).schema()
        reader = reader.schema(T.StructType([whole[c] for c in columns]))
    return reader.load()


def tables(path: str) -> list[str]:
    """The names of the tables that hold rows of their own."""
    with opened(path) as db:
        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND sql NOT LIKE 'CREATE VIRTUAL%' ORDER BY name")]
    return [n for n in names if not n.startswith("sqlite_") and "rtree" not in n]


def columns(path: str, name: str) -> list[str]:
    with opened(path) as db:
        return [c[1] for c in db.execute(f"PRAGMA table_info({_quoted(name)})")]


def import_store(spark: SparkSession, path: str, target: str) -> list[str]:
    """All tables as Parquet below target; gives their names."""
    names = tables(path)
    for n in names:
        table(spark, path, n).write.parquet(f"{target}/{n}")
    return names


def key_values(df: DataFrame, key: str = "Key", value: str = "Value") -> dict[str, str]:
    """A small key and value table as a dict."""
    return {r[0]: r[1] for r in df.select(key, value).collect()}
