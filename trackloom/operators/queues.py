"""Queue tables (file, drive, status, progress, cancel_requested, ord) and selections, as set-based updates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.ranks import numbered

ACTIVE, TERMINAL = ("waiting", "merging"), ("completed", "cancelled", "failed")


def reconciled(items: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Items after a snapshot (file, status, progress) of the tasks that run or wait. A task's own status wins, and an item that had ended starts anew; an unknown task is a new item; an
    active item that the snapshot lacks was cancelled if that was asked for, else it is complete at 100; items that had ended and aren't in it stay."""
    snap = snapshot.select("file", F.col("status").alias("_status"), F.col("progress").alias("_progress"))
    in_it, ended = F.col("_status").isNotNull(), F.col("status").isin(*TERMINAL)
    asked = F.coalesce("cancel_requested", F.lit(False))
    gone = F.when(ended, F.col("status")).when(asked, "cancelled").otherwise("completed")
    return items.select("file", "status", "progress", "cancel_requested").join(snap, "file", "full_outer").select(
        "file", F.when(in_it, F.col("_status")).otherwise(gone).alias("status"),
        F.when(in_it, F.col("_progress")).when(ended | asked, F.col("progress")).otherwise(100).alias("progress"),
        (asked & ~(in_it & F.coalesce(ended, F.lit(True)))).alias("cancel_requested"),
    )


def requeued(items: DataFrame, asked: DataFrame) -> DataFrame:
    """Items (file, status, progress, ord) after files are asked for (file, ord; one row a file): active ones stay, ended ones become fresh in their places, new ones follow in the order asked for."""
    new = asked.select("file", F.col("ord").alias("_ord"))
    fresh = F.col("_ord").isNotNull() & ~F.coalesce(F.col("status").isin(*ACTIVE), F.lit(False))
    both = items.select("file", "status", "progress", "ord").join(new, "file", "full_outer")
    place = F.struct(F.col("ord").isNull().alias("late"), F.coalesce("ord", "_ord").alias("ord"))
    return both.select("file", F.when(fresh, "waiting").otherwise(F.col("status")).alias("status"), F.when(fresh, 0).otherwise(F.col("progress")).alias("progress"), place.alias("place"))


def cleared(items: DataFrame, drives: DataFrame) -> DataFrame:
    """Items without those of the given drives (one column) that have ended."""
    gone = drives.select(F.col(drives.columns[0]).alias("_gone")).distinct()
    return items.join(gone, (F.col("drive") == F.col("_gone")) & F.col("status").isin(*TERMINAL), "left_anti")


def flags(items: DataFrame, key: str) -> DataFrame:
    """What a group's buttons depend on: whether some item has ended, is active or can be resumed."""
    some = {"has_completed": TERMINAL, "has_active": ACTIVE, "has_resumable": ("cancelled", "failed")}
    return items.groupBy(key).agg(*[F.bool_or(F.coalesce(F.col("status").isin(*values), F.lit(False))).alias(name) for name, values in some.items()])


def common_value(value: Column) -> Column:
    """Aggregate: the one value that all rows of a group have; null if they differ, or some has none or an empty one."""
    return F.when((F.min(value) == F.max(value)) & (F.count(value) == F.count("*")) & (F.min(value) != ""), F.min(value))


def to_resume(items: DataFrame, units: DataFrame) -> DataFrame:
    """The unit (``members``, an array) of each item that can be resumed; a file that is no unit's root (``root``) any more is a unit by itself."""
    again = items.where(F.col("status").isin("cancelled", "failed"))
    return again.join(units.select(F.col("root").alias("file"), "members"), "file", "left").withColumn("members", F.coalesce("members", F.array("file")))


def unit_inputs(members: DataFrame, picked: DataFrame, items: DataFrame) -> DataFrame:
    """Inputs to enqueue: of each unit's members (unit, file, ord) those with picked tracks (file, ...), numbered from 0 (``file_index``), and the form of the command, ``single`` for
    units of one member. Units whose item (file is the unit) is active are left out, and so are units without any input."""
    sized = members.withColumn("form", F.when(F.count("*").over(Window.partitionBy("unit")) == 1, "single").otherwise("multi"))
    kept = sized.join(picked.select("file").distinct(), "file", "left_semi")
    kept = kept.join(items.where(F.col("status").isin(*ACTIVE)).select(F.col("file").alias("unit")), "unit", "left_anti")
    return kept.withColumn("file_index", F.row_number().over(Window.partitionBy("unit").orderBy("ord")).cast("long") - 1)


def without_files(rows: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the columns names a file that is removed (``gone``, one column)."""
    gone = gone.select(F.col(gone.columns[0]).alias("_gone")).distinct()
    for c in columns:
        rows = rows.join(gone, F.col(c) == F.col("_gone"), "left_anti")
    return rows


def chosen(rows: DataFrame, picks: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are picked."""
    return rows.join(picks.select(*keys), keys, "left_semi")


def flipped(current: Column, picked: Column) -> Column:
    """A selection after each of ``picked`` (distinct) changes sides: what stays keeps its order, then what is new."""
    return F.concat(F.array_except(current, picked), F.array_except(picked, current))


def in_custom_order(rows: DataFrame, key: str, order: Column, value: str, ties: list, name: str = "place") -> DataFrame:
    """``name``: places from 0 within the key by an own list of values; values that it lacks, and all where there is no list (null), follow by ``ties``."""
    at = F.coalesce(F.array_position(order, F.col(value)), F.lit(0))
    rows = rows.withColumn("_at", F.when(at > 0, at))
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(F.col("_at").asc_nulls_last(), *ties)).cast("long") - 1).drop("_at")


def preferred_first(preferred: Column, rest: Column) -> Column:
    """The preferred values, then all others, each once."""
    return F.array_distinct(F.concat(preferred, rest))


def first_match(items: Column, test: Callable[[Column], Column]) -> Column:
    """The first element that passes, else the first one, else null."""
    return F.coalesce(F.get(F.filter(items, test), 0), F.get(items, 0))


def apart(rows: DataFrame, unit: str, order: str, checks: dict[str, Column], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All units with what ``make`` (rows of good units -> one row a unit, with column ``unit``) gives, and ``error``: a unit with a row that fails a check gives that check's text, of its first failing row
    by ``order`` the first check, and nothing else; it stops no other. A check that is null fails. A good unit that ``make`` leaves out has neither."""
    failing = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(said)) for said, ok in checks.items()]
    bad = rows.select(F.col(unit).alias("_unit"), F.col(order).alias("_order"), F.coalesce(*failing).alias("_error")).where("_error IS NOT NULL")
    errors = bad.groupBy("_unit").agg(F.min_by("_error", "_order").alias("error"))
    made = make(rows.join(errors.select("_unit"), F.col(unit) == F.col("_unit"), "left_anti"))
    names = [c for c in made.columns if c != unit]
    all_ = rows.select(unit).distinct().join(made, unit, "left").join(errors, F.col(unit) == F.col("_unit"), "left")
    return all_.select(unit, *names, "error")


def by_drive(items: DataFrame) -> DataFrame:
    """Items with ``place`` from 0 in the list of their drive, in queue order. A drive's list is numbered by ranges, so it needs not fit in a task."""
    return numbered(items, ["drive"], ["ord"])


def group_state(units: DataFrame, selected: DataFrame, items: DataFrame) -> DataFrame:
    """group, can_merge, can_copy, can_clear, has_waiting of groups of units (group, root, file: a row for each file of a unit, named by its root): there is something to merge or copy where some
    file has a selected track (``selected``: file) and, to merge or clear, no root is active (``items``: file, status)."""
    some = selected.select(F.col("file").alias("_selected")).distinct()
    status = items.select(F.col("file").alias("_root"), F.col("status").alias("_status"))
    rows = units.join(some, F.col("file") == F.col("_selected"), "left").join(status, F.col("root") == F.col("_root"), "left")
    is_ = lambda *s: F.bool_or(F.coalesce(F.col("_status").isin(*s), F.lit(False)))
    told = rows.groupBy("group").agg(F.bool_or(F.col("_selected").isNotNull()).alias("can_copy"), is_(*ACTIVE).alias("_active"), is_("waiting").alias("has_waiting"))
    return told.select("group", (F.col("can_copy") & ~F.col("_active")).alias("can_merge"), "can_copy", (~F.col("_active")).alias("can_clear"), "has_waiting")
