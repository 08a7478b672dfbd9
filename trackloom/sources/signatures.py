"""Formats that are known by their first bytes and not read any further."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are looked at.
HEAD = 32
#: Formats and their bytes by offset, the first that matches counts; fixed values.
SIGNATURES = [
    ("aac", {0: b"ADIF"}),
    ("asf", {0: b"\x30\x26\xb2\x75"}),
    ("cdxa", {0: b"RIFF", 8: b"CDXA"}),
    ("hdsub", {0: b"SP"}),
    ("unknown", {0: b".R1M"}),
    ("unknown", {0: b"\xb7\xd8\x00\x20\x37\x49\xda\x11\xa6\x4e\x00\x07\xe9\x5e\xad\x8d"}),
]


def unsupported_format(content: Column) -> Column:
    """The format whose bytes all lie within the first ``HEAD``; null where there is none, and for null and too short contents."""
    head = F.substring(content, 1, HEAD)
    at = lambda offset, raw: F.substring(head, offset + 1, len(raw)) == F.lit(raw)
    out = F.lit(None).cast("string")
    for name, parts in reversed(SIGNATURES):
        out = F.when(reduce(lambda a, b: a & b, [at(o, raw) for o, raw in parts.items()]), name).otherwise(out)
    return out


def unsupported(spark: SparkSession, *paths: str) -> DataFrame:
    """path, format of files in formats that are recognised and not read; of others nothing."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select("path", unsupported_format(F.col("content")).alias("format")).where("format IS NOT NULL")
