"""Track rows: flattening, selection, order, numbering and flags, as DataFrame transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.text import language_list, type_rank


def flatten(parts: list[tuple[str, DataFrame]], key: str, order: str) -> DataFrame:
    """Rows of several kinds under one key as one list: ``kind``, and ``seq`` from 0 within the key, kinds in the given order and rows of a
    kind by ``order``. All parts have the same columns."""
    union = None
    for rank, (kind, rows) in enumerate(parts):
        part = rows.withColumns({"kind": F.lit(kind), "_rank": F.lit(rank)})
        union = part if union is None else union.unionByName(part)
    return union.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy("_rank", order)).cast("long") - 1).drop("_rank")


def selected(kind: Column, codes: Column, checked: dict[str, bool], languages: dict[str, str]) -> Column:
    """Whether a row is taken: of a language type all if its choice is off, else those with a listed code (an empty list takes all);
    of other types all if their choice is on."""
    out = F.lit(False)
    for name, on in checked.items():
        if name in languages:
            wanted = language_list(F.lit(languages[name]))
            take = (wanted.isNull() | F.coalesce(F.arrays_overlap(codes, wanted), F.lit(False))) if on else F.lit(True)
        else:
            take = F.lit(on)
        out = F.when(kind == name, take).otherwise(out)
    return out


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of rows with equal keys the first in ``order``, which must leave no ties."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def compact_ids(rows: DataFrame, key: str, order: list, name: str = "id") -> DataFrame:
    """Ids from 0 without gaps among the rows of a key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long") - 1)


def in_track_order(rows: DataFrame, key: str, kind: str, ties: list, ranks: dict[str, int], name: str = "place") -> DataFrame:
    """``name``: the place from 0 within the key by type rank, then by ``ties``."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(type_rank(F.col(kind), ranks), *ties)).cast("long") - 1)


def default_flags(rows: DataFrame, unit: str, kind: str, order: list, name: str = "is_default") -> DataFrame:
    """One default per type in a unit: the first of each."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(unit, kind).orderBy(*order)) == 1)


def running_offset(rows: DataFrame, key: str, order: list, length: str, name: str = "begins") -> DataFrame:
    """Where a row begins if those before it under the key lie end to end."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(length).over(before), F.lit(0)))


def edited(rows: DataFrame, edits: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows with the values that ``edits`` (keys, and some of the columns; one row a key) has for them; a null leaves a value as it is. Edits of unknown keys do nothing."""
    new = edits.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"_new_{c}") for c in columns])
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    return rows.join(new, same, "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop(*new.columns)


def moved(rows: DataFrame, key: str, place: str, moves: DataFrame) -> DataFrame:
    """Rows of a key after one of them goes from one place to another (``moves``: key, from_place, to_place; one row a key) and those between close up. Moves of places that
    a key doesn't have do nothing. The rows that move past are found by their places alone, without sorting."""
    size = rows.groupBy(key).agg(F.max(place).alias("_last"))
    ok = moves.join(size, key).where("from_place <> to_place AND from_place BETWEEN 0 AND _last AND to_place BETWEEN 0 AND _last").select(F.col(key).alias("_key"), "from_place", "to_place")
    p, a, z = F.col(place), F.col("from_place"), F.col("to_place")
    new = F.when(p == a, z).when((p > a) & (p <= z), p - 1).when((p < a) & (p >= z), p + 1).otherwise(p)
    return rows.join(ok, F.col(key) == F.col("_key"), "left").withColumn(place, new).drop("_key", "from_place", "to_place")


def first_free(used: DataFrame, key: str, number: str) -> DataFrame:
    """Per key the least number from 0 that isn't used: where the used ones, in order, first leave their ranks. Keys that aren't in ``used`` have 0 free."""
    from_0 = used.where(F.col(number) >= 0).select(key, number).distinct()
    ranked = from_0.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(number)) - 1)
    return ranked.groupBy(key).agg(F.count_if(F.col(number) == F.col("_rank")).alias("free"))


def gated(rows: DataFrame, unit: str, order: str, number: str, kind: str, codec: str) -> DataFrame:
    """Tracks that count: of a unit's tracks with a number the first by ``order`` of each number, and of those the ones with a type and a codec. A track without either still takes its number."""
    first = keep_first(rows.where(F.col(number).isNotNull()), [unit, number], [order])
    return first.where(F.col(kind).isNotNull() & (F.coalesce(F.col(codec), F.lit("")) != ""))


def unit_flags(rows: DataFrame, unit: str, kind: str, order: str, checked: str, reset_default: bool = True, reset_forced: bool = True, kinds: tuple[str, ...] = ("video", "audio", "subtitles")) -> DataFrame:
    """Rows with ``default_track`` and ``forced`` (true, false or unspecified) after the profile's automation: of a unit's checked tracks the first of each of ``kinds`` by ``order`` (its own order
    where it has one; no ties) is the default and the others are not; none is forced. Rows that aren't checked, and of other types, stay as they are."""
    on = F.coalesce(F.col(checked), F.lit(False)) & F.col(kind).isin(*kinds)
    first = F.row_number().over(Window.partitionBy(unit, kind, on).orderBy(order)) == 1
    out = rows if not reset_default else rows.withColumn("default_track", F.when(on, F.when(first, "true").otherwise("false")).otherwise(F.col("default_track")))
    return out if not reset_forced else out.withColumn("forced", F.when(on, "false").otherwise(F.col("forced")))
