"""Normal forms of names, dates and durations, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Only these letters fold; the types that have a name of their own; seconds from 1970 to 2001; the limits of a time budget.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TYPES = ("video", "audio", "subtitles", "buttons")
_EPOCH_2001 = 978307200
_BUDGET_MS = (100, 60_000)
_SUB = ("sub", "SUB", "Sub")


def writing_app(raw: Column) -> Column:
    """``name version`` of a writing application: the name in lower case, the version as two to four numbers without zeros at its end. A text without a name and a version of numbers up to 255 stays as it is."""
    text = F.regexp_replace(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""), "^(?i)avi-mux gui", "avimuxgui")
    words = F.filter(F.split(text, " ", 3), lambda w: w != "")
    digits = F.regexp_replace(F.get(words, 1), "[^0-9.]", "")
    parts = F.transform(F.split(digits, r"\."), lambda p: F.when(p == "", 0).otherwise(p.try_cast("bigint")))
    bad = F.coalesce(digits == "", F.lit(True)) | F.exists(parts, lambda p: p.isNull() | (p > 255))
    four = F.concat_ws(".", F.transform(F.slice(F.concat(parts, F.array_repeat(F.lit(0).cast("bigint"), 4)), 1, 4), lambda p: p.cast("string")))
    return F.when(bad, raw).otherwise(F.concat_ws(" ", F.translate(F.get(words, 0), _UPPER, _LOWER), F.regexp_replace(four, r"(\.0){1,2}$", "")))


def fourcc(raw: Column) -> Column:
    """Four bytes in upper case after control characters go (spaces count); else null."""
    plain = F.regexp_replace(raw, r"[\x00-\x1f\x7f]", "")
    return F.when(F.octet_length(plain) == 4, F.translate(plain, _LOWER, _UPPER))


def date_2001(ns: Column) -> Column:
    """Nanoseconds since 2001 as ``yyyy-mm-ddThh:mm:ssZ``, whatever the session's time zone; parts of a second before go down."""
    seconds = _div(ns - F.pmod(ns, F.lit(1_000_000_000)), F.lit(1_000_000_000)) + _EPOCH_2001
    rest = F.pmod(seconds, F.lit(86400))
    day = F.date_add(F.lit("1970-01-01").cast("date"), _div(seconds - rest, F.lit(86400)).cast("int"))
    return F.concat(day.cast("string"), F.format_string("T%02d:%02d:%02dZ", _div(rest, F.lit(3600)), _div(rest, F.lit(60)) % 60, rest % 60))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def ticks_ns(ticks: Column) -> Column:
    """Ticks of 45 kHz in nanoseconds; the product stops at 64 bits. Null stays null."""
    product = F.least(ticks.cast("decimal(20,0)") * F.lit(1_000_000).cast("decimal(7,0)"), F.lit("18446744073709551615").cast("decimal(27,0)"))
    return F.when(ticks.isNotNull(), _div(product, F.lit(45).cast("decimal(2,0)"))).cast("long")


def frame_ns(delta: Column, timescale: Column) -> Column:
    """Nanoseconds of a sample that lasts ``delta`` units of a time scale, which must be positive (else null); no product overflows."""
    return F.when(timescale > 0, _div(delta.cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)"), F.when(timescale > 0, timescale).cast("decimal(20,0)"))).cast("long")


def budget_ms(asked: Column) -> Column:
    """A time budget within its limits; null stays null."""
    return F.when(asked.isNotNull(), F.least(F.greatest(asked, F.lit(_BUDGET_MS[0])), F.lit(_BUDGET_MS[1])))


def next_flag(flag: Column) -> Column:
    """The flag after a click: true, false, unspecified, true."""
    return F.when(flag == "true", "false").when(flag == "false", "unspecified").otherwise("true")


def shown_type(kind: Column) -> Column:
    return F.when(kind.isin(*_TYPES), kind).otherwise("unknown")


def index_path(path: Column) -> Column:
    """The index file of a bitmap subtitle file (``.sub`` in any case); other paths stay."""
    return F.regexp_replace(path, r"(?i)(?<=[^/\\])\.sub$", ".idx")


def empty_subtitles(path: Column, length: Column, bom: Column) -> Column:
    """Whether a file that no reader knows is an empty text subtitle file: of that extension, with at most one byte after the mark."""
    return path.rlike(r"(?i)[^/\\]\.srt$") & (length - bom <= 1)


def with_bitmaps(files: DataFrame, path: str, name: str = "sub_path") -> DataFrame:
    """Each index file (``.idx``) with the file of its bitmaps beside it, spelled ``sub``, ``SUB`` or ``Sub`` (the first of these that is there), null where none is. One shuffle by folder and stem."""
    stem, ext = r"^(.*[^/\\])\.[^./\\]*$", r"\.([^./\\]*)$"
    rows = files.select(F.col(path), F.regexp_extract(path, stem, 1).alias("_stem"), F.regexp_extract(path, ext, 1).alias("_ext"))
    rank = F.array_position(F.array(*map(F.lit, _SUB)), F.col("_ext"))
    beside = rows.where(F.col("_ext").isin(*_SUB)).groupBy("_stem").agg(F.min_by(path, rank).alias(name))
    return rows.where(F.lower("_ext") == "idx").join(beside, "_stem", "left").select(path, name)
