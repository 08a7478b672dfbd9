"""Histograms and groups of structurally identical units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.ranks import numbered


def histogram(rows: DataFrame, key: str, kind: str, kinds: list[str]) -> DataFrame:
    """Per key how many rows are of each listed kind; others don't count."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds])


def count_signature(rows: DataFrame, key: str, kind: str, kinds: list[str]) -> DataFrame:
    """Per key a text of its counts by kind."""
    parts = [F.concat(F.lit(f"{k}="), F.col(f"n_{k}").cast("string")) for k in kinds]
    return histogram(rows, key, kind, kinds).select(key, F.concat_ws("|", *parts).alias("signature"))


def language_signature(rows: DataFrame, key: str, language: Column) -> DataFrame:
    """Per key its distinct languages with their counts, sorted and joined. Counting first keeps a key with many rows small."""
    counted = rows.groupBy(key, language.alias("_code")).agg(F.count("*").alias("_n"))
    shown = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("_code"), F.col("_n").cast("string")))), ",")
    return counted.groupBy(key).agg(shown.alias("signature"))


def buckets(units: DataFrame, signature: str, first: str, least: int = 2) -> DataFrame:
    """Signatures with their number of units, the first unit, and whether they make a group (``least`` units or more)."""
    return units.groupBy(signature).agg(F.count("*").alias("n_units"), F.min(first).alias("first_unit")).withColumn("grouped", F.col("n_units") >= least)


def unit_keys(rows: DataFrame, units: DataFrame, languages: bool) -> DataFrame:
    """unit, key: the folder, the number of members, and per type the number of tracks, or (``languages``) the sorted languages of each media type's tracks and the
    numbers of chapters and attachments. ``units``: unit, dir, members. Languages are counted first, so a unit with many tracks stays small."""
    short = {"video": "v", "audio": "a", "subtitles": "s", "chapters": "c", "attachment": "t"}
    if languages:
        counted = rows.groupBy("unit", "type", "language").agg(F.count("*").cast("int").alias("n"))
        by = F.array_sort(F.collect_list(F.struct("type", "language", "n")))
        told = counted.groupBy("unit").agg(by.alias("x"))
        said = lambda k: F.array_join(F.flatten(F.transform(F.filter("x", lambda x: x["type"] == k), lambda x: F.array_repeat(x["language"], x["n"]))), ",")
        total = lambda k: F.aggregate(F.filter("x", lambda x: x["type"] == k), F.lit(0), lambda a, x: a + x["n"]).cast("string")
        parts = [F.concat(F.lit(f"{s}="), F.coalesce(total(k), F.lit("0")) if k in ("chapters", "attachment") else F.coalesce(said(k), F.lit(""))) for k, s in short.items()]
        told = units.join(told, "unit", "left")
    else:
        told = units.join(histogram(rows, "unit", "type", list(short)), "unit", "left")
        parts = [F.concat(F.lit(f"{s}="), F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("string")) for k, s in short.items()]
    return told.select("unit", F.concat_ws("|", F.col("dir"), F.concat(F.lit("n="), F.col("members").cast("string")), *parts).alias("key"))


def entries(units: DataFrame, keyed: DataFrame) -> DataFrame:
    """unit, place, kind, key: where each unit is shown. Keys come in the order of their first units (``units``: unit, position, loaded), as a group where two units or more
    share them, else alone; units that aren't loaded follow, each alone, without a key. Places are dense from 0."""
    held = units.where("loaded").join(keyed, "unit")
    keys = held.groupBy("key").agg(F.min("position").alias("at"), F.count("*").alias("n")).select("key", "at", F.lit(0).alias("late"), F.when(F.col("n") >= 2, "group").otherwise("single").alias("kind"))
    rest = units.where("NOT loaded").select("unit", F.col("position").alias("at"), F.lit(1).alias("late"), F.lit("single").alias("kind"))
    shown = held.select("unit", "key").join(keys, "key").select("unit", "key", "at", "late", "kind").unionByName(rest.select("unit", F.lit(None).cast("string").alias("key"), "at", "late", "kind"))
    place = numbered(shown.select("late", "at").distinct(), [], ["late", "at"])
    return shown.join(place, ["late", "at"]).select("unit", "place", "kind", "key")
