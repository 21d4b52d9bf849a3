"""The streaming query: events as scans, put in the order of time with bounded lateness."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.session import shared_folder
from peakloom.streaming.resequence import held, resequenced, time_rows


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of scans; a group is an event type."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a file source takes folders or patterns; the pattern names the one table
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return raw.select(F.col("event_type").alias("run_id"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"), F.when(F.col("event_id") % 4 == 0, 1).otherwise(2).alias("ms_level"))


def time_rows_of_events(spark: SparkSession, sf_dir: str, width: float) -> DataFrame:
    """The time rows that are closed when all events are read: run_id, ms_level, row_start, first_id, last_id, n."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = time_rows(_scans(spark, sf_dir), width, ["run_id", "ms_level"])
    started = rows.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows")
    started.awaitTermination()
    return spark.read.schema("run_id string, ms_level int, row_start double, first_id long, last_id long, n long").parquet(f"{path}/rows")


def resequenced_events(spark: SparkSession, sf_dir: str, lateness: int = 100) -> DataFrame:
    """All spectra in their new order: those that left the buffer while the input was read, and those that it held at the
    end. A group here is an event type."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    scans = _scans(spark, sf_dir)
    started = resequenced(scans, "run_id", lateness).writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows")
    started.awaitTermination()
    done = spark.read.schema("run_id string, id long, time double, ms_level int, new_id long, new_cycle long").parquet(f"{path}/rows")
    return done.unionByName(held(spark, f"{path}/state"))
