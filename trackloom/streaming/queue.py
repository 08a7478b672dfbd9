"""A work queue per drive as keyed streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: ``kind`` is enqueue, cancel, or how the work on a file ended: exited (with ``code``, 0 for success).
EVENTS = "drive string, seq long, kind string, file string, code int"
CHANGES = "drive string, seq long, file string, status string"


def advance(queue: list[str], stopping: bool, kind: str, file: str, code: int | None) -> tuple[bool, list[tuple[str, str]]]:
    """Apply one event to a drive's queue; returns whether the head is to be cancelled, and (file, new status). A file that is queued already is not added
    again; a waiting file's cancel takes it out silently; the head's is only noted, and when its work ends it is ``cancelled`` whatever the code, else
    ``completed`` or ``failed`` by the code. Then the next begins. Other events do nothing."""
    if kind == "enqueue" and file not in queue:
        queue.append(file)
        return stopping, [(file, "merging" if len(queue) == 1 else "waiting")]
    if kind == "cancel" and file in queue:
        if queue[0] == file:
            return True, []
        queue.remove(file)
    elif kind == "exited" and queue[:1] == [file]:
        queue.pop(0)
        outcome = "cancelled" if stopping else "completed" if code == 0 else "failed"
        return False, [(file, outcome)] + [(f, "merging") for f in queue[:1]]
    return stopping, []


def snapshot(changes: DataFrame) -> DataFrame:
    """drive, file, status: the files that are queued or at work after all changes that were told; those whose work ended are gone. A waiting file that was
    cancelled silently is known to the state alone: see ``live``."""
    last = changes.groupBy("drive", "file").agg(F.max_by("status", "seq").alias("status"))
    return last.where(F.col("status").isin("waiting", "merging"))


def finished(changes: DataFrame) -> DataFrame:
    """file, outcome of the changes (a stream or a table) that end the work on a file."""
    return changes.where(F.col("status").isin("completed", "cancelled", "failed")).select("drive", "seq", "file", F.col("status").alias("outcome"))


def live(spark: SparkSession, checkpoint: str) -> DataFrame:
    """drive, file, status of all files that wait or are at work, as the state of a ``track`` query holds them (``checkpoint``: its checkpoint folder): a drive's first file is
    at work. Files that were cancelled while they waited, of which no change tells, are not in it."""
    held = spark.read.format("statestore").load(checkpoint)
    return held.select(F.col("key.drive").alias("drive"), F.posexplode("value.groupState.queue").alias("at", "file")).select("drive", "file", F.when(F.col("at") == 0, "merging").otherwise("waiting").alias("status"))


def track(events: DataFrame) -> DataFrame:
    """Status changes of a stream of queue events (EVENTS), in order within each drive and batch. A drive's state is its queue."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        queue, stopping = (list(state.get[0]), bool(state.get[1])) if state.exists else ([], False)
        rows = []
        for e in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples():
            stopping, changes = advance(queue, stopping, e.kind, e.file, e.code)
            rows += [(key[0], e.seq, f, status) for f, status in changes]
        state.update((queue, stopping))
        yield pd.DataFrame(rows, columns=["drive", "seq", "file", "status"])

    return events.groupBy("drive").applyInPandasWithState(run, CHANGES, "queue array<string>, stopping boolean", "append", GroupStateTimeout.NoTimeout)
