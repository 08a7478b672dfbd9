"""Merge commands: argument lists of outputs from selected track rows.

A row is a selected track of a file: ``file`` (its path), ``seq`` (its place in the table), ``id``, ``type``, ``language``, ``track_name``, and ``default_track`` and
``forced`` as ``true``, ``false`` or ``unspecified``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.text import shell_quoted, type_rank

#: Options of the merge tool by track type; fixed values.
TAKE = {"video": "-d", "audio": "-a", "subtitles": "-s"}
NONE = {"video": "--no-video", "audio": "--no-audio", "subtitles": "--no-subtitles"}

def _when(condition: Column, *args: Column) -> Column:
    return F.when(condition, F.array(*args)).otherwise(F.array().cast("array<string>"))


def _ids(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: x["id"].cast("string")), ",")


def input_options(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ``options``, ``order`` per input file: which tracks of each type (in the table's order) or none, then of video, audio and subtitles in turn each track's
    language, name and flags where they are given, then what is left out of chapters, global tags and attachments, then the file. ``order``
    has (rank, seq, id) of the ordered types."""
    text = F.col("id").cast("string")
    flag = lambda c: F.concat_ws(":", text, F.when(F.col(c) == "true", "1").otherwise("0"))
    opts = F.concat(
        _when(F.coalesce(F.col("language"), F.lit("")) != "", F.lit("--language"), F.concat_ws(":", text, "language")),
        _when(F.coalesce(F.col("track_name"), F.lit("")) != "", F.lit("--track-name"), F.concat_ws(":", text, "track_name")),
        _when(F.coalesce(F.col("default_track"), F.lit("unspecified")) != "unspecified", F.lit("--default-track-flag"), flag("default_track")),
        _when(F.coalesce(F.col("forced"), F.lit("unspecified")) != "unspecified", F.lit("--forced-display-flag"), flag("forced")),
    )
    item = F.struct("seq", "id", "type", type_rank(F.col("type")).alias("rank"), opts.alias("opts"))
    files = rows.groupBy(*keys, "file").agg(F.array_sort(F.collect_list(item)).alias("t"))
    is_of = lambda k: lambda x: x["type"] == F.lit(k)
    of = {k: F.filter("t", is_of(k)) for k in (*TAKE, "chapters", "attachment")}
    parts = [F.when(F.size(of[k]) > 0, F.array(F.lit(take), _ids(of[k]))).otherwise(F.array(F.lit(NONE[k]))) for k, take in TAKE.items()]
    parts += [F.flatten(F.transform(of[k], lambda x: x["opts"])) for k in TAKE]
    parts += [_when(F.size(of["chapters"]) == 0, F.lit("--no-chapters")), F.array(F.lit("--no-global-tags"))]
    parts += [F.when(F.size(of["attachment"]) > 0, F.array(F.lit("--attachments"), _ids(of["attachment"]))).otherwise(F.array(F.lit("--no-attachments"))), F.array("file")]
    order = F.transform(F.filter("t", lambda x: x["type"].isin(*TAKE)), lambda x: F.struct(x["rank"].alias("rank"), x["seq"].alias("seq"), x["id"].alias("id")))
    return files.select(*keys, F.concat(*parts).alias("options"), order.alias("order"))


def arguments(rows: DataFrame, unit: str = "unit", output: str = "output") -> DataFrame:
    """unit, argv of merging one file's tracks: the output, the file's options, and the tracks in the table's order."""
    made = input_options(rows, [unit, output])
    order = F.array_join(F.transform("order", lambda x: F.concat(F.lit("0:"), x["id"].cast("string"))), ",")
    return made.select(unit, F.concat(F.array(F.lit("-o"), F.col(output)), "options", _when(F.size("order") > 0, F.lit("--track-order"), order)).alias("argv"))


def arguments_of_many(rows: DataFrame, unit: str = "unit", output: str = "output", index: str = "file_index") -> DataFrame:
    """unit, argv of merging several files: options of each by its index, then all ordered tracks by type, then file, then the file's own order. Where the rows have a
    column ``place``, it orders the tracks instead, whatever their types and files."""
    placed = "place" in rows.columns
    made = input_options(rows.withColumn("seq", F.struct("seq", "place")) if placed else rows, [unit, output, index])
    key = (lambda x: x["seq"]["place"]) if placed else (lambda x: x["rank"])
    entries = F.transform("order", lambda x: F.struct(key(x).alias("first"), F.col(index).alias("index"), x["seq"].alias("seq"), x["id"].alias("id")))
    both = made.groupBy(unit, output).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("index"), "options"))).alias("files"), F.array_sort(F.flatten(F.collect_list(entries))).alias("all"))
    order = F.array_join(F.transform("all", lambda x: F.concat_ws(":", x["index"].cast("string"), x["id"].cast("string"))), ",")
    options = F.flatten(F.transform("files", lambda x: x["options"]))
    return both.select(unit, F.concat(F.array(F.lit("-o"), F.col(output)), options, _when(F.size("all") > 0, F.lit("--track-order"), order)).alias("argv"))


def command_text(program: Column, argv: Column) -> Column:
    """The command for display: each argument quoted where it has to be."""
    return F.array_join(F.transform(F.concat(F.array(program), argv), shell_quoted), " ")


def dispatched(rows: DataFrame, members: DataFrame, unit: str = "unit", output: str = "output", index: str = "file_index") -> DataFrame:
    """unit, argv of all units: of those with one member (``members``: unit, file) by its tracks alone, of others by all their files, in their own order where the rows have ``place``. A unit's
    form follows its members, whether or not all of them have selected tracks."""
    many = members.groupBy(F.col(unit).alias("_unit")).agg((F.count("*") > 1).alias("_many"))
    sized = rows.join(many, F.col(unit) == F.col("_unit"))
    single = sized.where("NOT _many").drop("_unit", "_many")
    return arguments(single, unit, output).unionByName(arguments_of_many(sized.where("_many").drop("_unit", "_many"), unit, output, index))
