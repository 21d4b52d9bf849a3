"""Streams of spectra: re-ordering with bounded lateness, and time rows that close as time goes on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def resequenced(stream: DataFrame, group: str = "run_id", lateness: int = 100, idle_ms: int | None = None) -> DataFrame:
    """Spectra (group, id, time, ms_level) in the order of time with new ids and cycles from 1 in each group. Up to
    lateness spectra are held back; the earliest leaves when one more comes, so a spectrum that is later than that comes
    out of order but is never dropped. State: the held spectra and the last id and cycle. The rest leaves when no row
    of the group comes for idle_ms (processing time); without it, it stays in the state, where held() finds it."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last_id, cycle = state.get if state.exists else ([], 0, 0)
        held = [tuple(h) for h in held]
        if state.hasTimedOut:
            out, held = sorted(held), []
        else:
            for f in frames:
                held += list(zip(f["time"].astype(float), f["id"].astype(int), f["ms_level"].astype(int), strict=True))
            held.sort()
            n = max(0, len(held) - lateness)
            out, held = held[:n], held[n:]
        rows = []
        for time, old, level in out:
            last_id, cycle = last_id + 1, cycle + (level == 1)
            rows.append((key[0], old, time, level, last_id, cycle))
        if held:
            state.update(([tuple(h) for h in held], last_id, cycle))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        else:
            state.update(([], last_id, cycle))
        yield pd.DataFrame(rows, columns=[group, "id", "time", "ms_level", "new_id", "new_cycle"])

    kind = stream.schema[group].dataType.simpleString()
    return stream.groupBy(group).applyInPandasWithState(
        run,
        f"{group} {kind}, id long, time double, ms_level int, new_id long, new_cycle long",
        "held array<struct<time:double,id:long,ms_level:int>>, last_id long, cycle long",
        "append",
        GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout,
    )


def held(spark: SparkSession, state_path: str, group: str = "run_id") -> DataFrame:
    """The spectra that a stopped query's state still holds, with the ids and cycles that come next: what resequenced()
    would give out at the end of its input. At most its lateness a group."""
    state = spark.read.format("statestore").load(state_path)
    own = state.select(F.col("key").getField(state.schema["key"].dataType.names[0]).alias(group), "value.groupState.*")
    rows = own.select(group, F.col("last_id").alias("__i"), F.col("cycle").alias("__c"), F.posexplode(F.array_sort("held")).alias("__k", "h"))
    upto = Window.partitionBy(group).orderBy("__k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cycle = F.col("__c") + F.sum(F.when(F.col("h.ms_level") == 1, 1).otherwise(0)).over(upto)
    return rows.select(group, "h.id", "h.time", "h.ms_level", (F.col("__i") + F.col("__k") + 1).alias("new_id"), cycle.alias("new_cycle"))


def time_rows(stream: DataFrame, width: float, group: list[str], idle_ms: int | None = None) -> DataFrame:
    """Anchored time rows of a stream (id, time): a row is given out when a spectrum more than width later opens the
    next one, or when its group is idle for idle_ms, if given. row_start, first and last id and n."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, first, last, n = state.get if state.exists else (0.0, 0, 0, 0)
        rows = []
        if state.hasTimedOut:
            rows, n = ([(*key, opened, first, last, n)] if n else []), 0
            state.remove()
        else:
            whole = pd.concat(list(frames)).sort_values(["time", "id"])
            for t, i in zip(whole["time"].astype(float), whole["id"].astype(int), strict=True):
                if n and t - opened > width:
                    rows.append((*key, opened, first, last, n))
                    n = 0
                if not n:
                    opened, first = t, i
                last, n = i, n + 1
            state.update((opened, first, last, n))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=[*group, "row_start", "first_id", "last_id", "n"])

    kinds = ", ".join(f"{g} {stream.schema[g].dataType.simpleString()}" for g in group)
    return stream.groupBy(*group).applyInPandasWithState(run, f"{kinds}, row_start double, first_id long, last_id long, n long", "opened double, first_id long, last_id long, n long", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
