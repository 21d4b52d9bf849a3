"""Session helpers shared by tests, bench and the command line."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the engine expects on a cluster (AQE on, UTC, Arrow on)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("peakloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that the whole cluster shares: the session's spark.checkpoint.dir. Where that is unset, a local master
    gets one in the temp folder (in tests); on a cluster that would be a folder of one machine, so it raises."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
    return os.path.join(tempfile.gettempdir(), f"peakloom-{os.getuid()}")


def local_folder(spark: SparkSession) -> str:
    """A new folder below the shared one for files that aren't Spark's own (SQLite): a path of a file system that all
    machines have mounted, so the shared folder must be one."""
    folder = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    if "://" in folder:
        raise RuntimeError("a SQLite file needs a shared folder that is mounted")
    path = os.path.join(folder, f"files-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def local_file(spark: SparkSession, name: str) -> str:
    """A new path for a file in such a folder."""
    return os.path.join(local_folder(spark), name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; only Spark touches the path, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bench_cores() -> int:
    return int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
