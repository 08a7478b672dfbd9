"""Column functions for what is shown of tracks, attachments, queue items and errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.functions.text import double_in_units, joined

#: Unit and decimals of sizes and bit rates of types without a choice of their own; fixed values.
DEFAULT_FIELD = ("KMGT", 2)
#: Font types by their old names; fixed values.
FONT_TYPES = {"application/vnd.ms-opentype": "font/otf", "application/x-font-otf": "font/otf", "application/x-font-ttf": "font/ttf", "application/x-truetype-font": "font/ttf"}
#: Types by first bytes, the first that matches counts; fixed values.
MAGIC = [
    (b"OTTO", "font/otf"), (b"ttcf", "font/collection"), (b"wOFF", "font/woff"), (b"wOF2", "font/woff2"), (b"true", "font/sfnt"), (b"typ1", "font/sfnt"), (b"\x00\x01\x00\x00", "font/sfnt"),
    (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"), (b"BM", "image/bmp"),
]
#: Extensions of image types; fixed values.
EXTENSIONS = {
    "image/jpeg": "jpg", "image/jpg": "jpg", "image/pjpeg": "jpg", "image/jfif": "jpg", "image/png": "png", "image/gif": "gif", "image/bmp": "bmp", "image/x-bmp": "bmp", "image/webp": "webp", "image/tiff": "tiff",
    "image/x-icon": "ico", "image/vnd.microsoft.icon": "ico",
}
#: What is said of files that can't be read, by kind of error.
ERRORS = {
    "io": "The file can't be read: {detail}", "unexpectedEof": "The file ends too early: {detail}", "unrecognised": "The format is unknown: {detail}", "timeout": "Reading took more than {budget_ms} ms at {stage}: {detail}",
    "malformed": "The file is damaged: {detail}", "oversizedElement": "A part of the file is too large: {detail}", "internal": "Something went wrong: {detail}",
}


def _chosen(key: Column, values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def codec_shown(name: Column, codec_id: Column) -> Column:
    """A codec's name (an empty one is a name), else its id."""
    return F.coalesce(name, codec_id)


def subtitle_description(is_text: Column, variant: Column, encoding: Column, page: Column) -> Column:
    """Text or Image (also where that isn't known), then the variant, the encoding and the teletext page where they are given."""
    return joined(F.when(F.coalesce(is_text, F.lit(False)), "Text").otherwise("Image"), variant, encoding, F.concat(F.lit("p"), page.cast("string")))


def described(*parts: tuple[Column, Column]) -> Column:
    """The description that goes with the first of (properties, description) whose properties are not null; else empty."""
    return F.coalesce(*[F.when(there.isNotNull(), F.coalesce(said, F.lit(""))) for there, said in parts], F.lit(""))


def value_by_type(n: Column, kind: Column, suffix: str, fields: dict[str, tuple[str, int]]) -> Column:
    """A double in the unit and with the decimals that its type has in ``fields`` (video, audio, subtitles), all other types in ``DEFAULT_FIELD``."""
    unit = lambda field: double_in_units(n, suffix, *field)
    return reduce(lambda rest, kv: F.when(kind == kv[0], unit(kv[1])).otherwise(rest), [(k, v) for k, v in fields.items() if k in ("video", "audio", "subtitles")], unit(DEFAULT_FIELD))


def font_type(mime: Column) -> Column:
    """Today's name of a font type; other types as they are."""
    return F.coalesce(_chosen(mime, FONT_TYPES), mime)


def guessed_type(content: Column) -> Column:
    """The type of a font or image by its first bytes; ``application/octet-stream`` for all others and for nothing."""
    out = F.lit("application/octet-stream")
    for raw, said in reversed(MAGIC):
        out = F.when(F.substring(content, 1, len(raw)) == F.lit(raw), said).otherwise(out)
    return out


def image_extension(mime: Column) -> Column:
    """The extension of an image type in whatever case; empty for others."""
    return F.coalesce(_chosen(F.lower(mime), EXTENSIONS), F.lit(""))


def clock_time(ms: Column, zone: str) -> Column:
    """HH:MM:SS in a time zone of milliseconds since 1970; ``--:--:--`` for null."""
    return F.coalesce(F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_millis(ms).cast("timestamp_ntz")), "HH:mm:ss"), F.lit("--:--:--"))


def error_text(kind: Column, raw: Column, texts: dict[str, str] = ERRORS, **values: Column) -> Column:
    """The text for an error's kind with ``values`` in its braces (null as empty); ``raw`` for unknown kinds."""
    said = reduce(lambda text, kv: F.replace(text, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1].cast("string"), F.lit(""))), values.items(), _chosen(kind, texts))
    return F.coalesce(said, raw)
