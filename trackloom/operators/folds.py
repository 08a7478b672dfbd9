"""Ordered folds over the rows of a key, where a sum over a window can't say what is carried on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Nanoseconds that the search for first timestamps covers, and that a video track is looked at beyond its least one; fixed values.
PROBE_NS, VIDEO_NS = 10_000_000_000, 1_000_000_000


def ordered_fold(rows: DataFrame, key: str, order: list[str], value: str, start: Callable[[], object], step: Callable[[object, object], tuple[object, object]], name: str, kind: str = "long") -> DataFrame:
    """Rows with ``name``, which ``step`` (state, value) -> (state, output) gives for each in ``order`` within its key; the first row of a key gets a fresh state. Rows
    stream through in order and a task holds one state, so the rows of a key need not fit anywhere. Null keys are one key."""
    fields = [f for f in rows.schema if f.name != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, None, False
        for batch in batches:
            out = []
            for k, v in zip(batch.column("_key").to_pylist(), batch.column("_value").to_pylist(), strict=True):
                if not begun or k != now:
                    now, state, begun = k, start(), True
                state, x = step(state, v)
                out.append(x)
            kept = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.int64() if kind == "long" else None)], [*(f.name for f in fields), name])

    told = rows.withColumns({"_key": F.col(key), "_value": F.col(value)})
    dealt = told.repartition("_key").sortWithinPartitions("_key", *order).select(*[f.name for f in fields], "_key", "_value")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{name}` {kind}"
    return dealt.mapInArrow(run, schema)


def corrected_times(rows: DataFrame, key: str, order: list[str], at: str, delay: int, name: str = "corrected") -> DataFrame:
    """Timestamps moved by a delay that changes as it goes: where it is negative and a row would come to lie before the last one (which isn't at 0), the row takes
    the last one's time and the delay grows by what was missing. A row that is still negative is skipped: null, and it changes nothing. A null timestamp is skipped as well."""

    def step(state: tuple[int, int], time: int | None) -> tuple[tuple[int, int], int | None]:
        moved, last = state
        if time is None:
            return state, None
        now = time + moved
        if moved < 0 and last != 0 and now < last:
            moved, now = moved + last - now, last
        return ((moved, now), now) if now >= 0 else ((moved, last), None)

    return ordered_fold(rows, key, order, at, lambda: (delay, 0), step, name)


def least_times(rows: DataFrame, unit: str, track: str, order: str, at: str, video: Column, probe: int = PROBE_NS, reach: int = VIDEO_NS) -> DataFrame:
    """unit, track, least: each track's least timestamp near the start of its unit. A unit is read in ``order`` (no ties) until a row lies ``probe`` or more after its first
    row. A track that is no video ends with its first row; a video track (``video``, the same for all rows of a track) ends with the first row that lies ``reach`` or more
    after the least one so far, so rows out of order still lower it. Tracks without a row by then, null tracks and null timestamps give none.

    What ends a unit is found by sums; windows only span the rows of one track of a unit before that."""
    rows = rows.where(F.col(at).isNotNull())
    first = rows.groupBy(unit).agg(F.min_by(at, order).alias("_first"))
    far = rows.join(first, unit).where(F.col(at) - F.col("_first") >= probe).groupBy(unit).agg(F.min(order).alias("_end"))
    near = rows.join(far, unit, "left").where(F.col("_end").isNull() | (F.col(order) < F.col("_end"))).where(F.col(track).isNotNull())
    so_far = Window.partitionBy(unit, track).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    seen = near.select(unit, track, order, at, video.alias("_video")).withColumn("_least", F.min(at).over(so_far))
    ended = F.max(F.when(F.col("_video") & (F.col(at) - F.col("_least") < reach), 0).otherwise(1)).over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    return seen.where("_least IS NOT NULL").withColumn("_over", F.coalesce(ended, F.lit(0))).where("_over = 0").groupBy(unit, track).agg(F.min(at).alias("least"))
