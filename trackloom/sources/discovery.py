"""Finding media files with Spark's binaryFile source, without reading their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.text import file_name, parent_dir

#: Extensions of supported files, in alphabetical order; fixed values, and a parameter of the listing.
EXTENSIONS = tuple(
    "264 265 aac ac3 ass av1 avc avi btn caf drc dts dtshd dtsma eac3 eb3 ec3 evo evob f4v flac flv h264 h265 hevc idx ivf m1v m2ts m2v m4a m4v mk3d mka mks mkv mlp mov mp2 mp3 mp4 mpeg mpg mpls mpv mts obu ogg ogm ogv "
    "opus ra ram rm rmvb rv srt ssa sub sup textst thd truehd ts tta usf vc1 vob vtt wav weba webm webma webmv webvtt wv x264 x265 xml".split()
)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def listed(spark: SparkSession, paths: str | list[str], extensions: tuple[str, ...] = EXTENSIONS, deep: bool = False) -> DataFrame:
    """input (which of the paths, from 0), path, dir, name, ext, length, modified of supported files: of each path that exists, a file itself or a folder's files (one
    level unless ``deep``). Ordered by (input, path) it is the order in which they were given. Only the listing's columns are selected, so contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower())
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = spark.createDataFrame([], "input int, path string, modificationTime timestamp, length long")
    for i, given in enumerate([paths] if isinstance(paths, str) else paths):  # a few paths that a user names
        at = jvm.org.apache.hadoop.fs.Path(given)
        if at.getFileSystem(conf).exists(at):
            out = out.unionByName(reader.load(given).select(F.lit(i).alias("input"), "path", "modificationTime", "length"))
    path = F.col("path")
    found = out.select("input", "path", parent_dir(path).alias("dir"), file_name(path).alias("name"), extension(path).alias("ext"), "length", F.col("modificationTime").alias("modified"))
    return found.where(F.col("ext").isin(*extensions))


def unseen(found: DataFrame, held: DataFrame) -> DataFrame:
    """Listed files that are not held yet; repeats within the listing stay."""
    return found.join(held.select("path").distinct(), "path", "left_anti")
