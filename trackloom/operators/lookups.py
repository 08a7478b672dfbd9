"""Lookups in small tables: catalogues with prefixes, aliases of which the first wins, chains of keys; and pairs by conditions that are no equality."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.text import distinct_folded, trimmed
from trackloom.operators.tracks import keep_first

#: Rows of a table that is sent to all tasks, at most; a larger one is joined by shuffle.
SENT = 50_000


def bounded(table: DataFrame, most: int = SENT) -> DataFrame:
    """The table marked to be broadcast if it has ``most`` rows or fewer, which is counted; else as it is."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def catalogued(rows: DataFrame, code: str, catalogue: DataFrame, most: int = SENT) -> DataFrame:
    """Rows with the catalogue's columns (``id``, ``prefix``, and others) for their code: of the entry with that very id, else of the entry marked ``prefix`` with the longest id that the
    code begins with, else nulls. Ids differ; a null code has no entry.

    Each distinct code is looked up once, as a whole and cut to each length that ids with ``prefix`` have, by equality; the catalogue is broadcast if it is small."""
    lengths = [r[0] for r in catalogue.where("prefix").select(F.length("id").alias("n")).distinct().orderBy("n").collect()]  # no more than the longest id is long
    codes = rows.where(F.col(code).isNotNull()).select(F.col(code).alias("_code")).distinct()
    whole = F.struct(F.col("_code").alias("key"), F.lit(True).alias("exact"))
    cut = [F.when(F.length("_code") > n, F.struct(F.substring("_code", 1, n).alias("key"), F.lit(False).alias("exact"))) for n in lengths]
    tries = codes.select("_code", F.explode(F.filter(F.array(whole, *cut), lambda x: x.isNotNull())).alias("_try"))
    entry = bounded(catalogue.select(F.col("id").alias("_id"), F.col("prefix").alias("_prefix"), F.struct(*catalogue.columns).alias("_entry")), most)
    met = tries.join(entry, (F.col("_try.key") == F.col("_id")) & (F.col("_try.exact") | F.col("_prefix")))
    best = met.groupBy("_code").agg(F.max_by("_entry", F.struct("_try.exact", F.length("_id"))).alias("_entry"))
    return rows.join(bounded(best, most), F.col(code) == F.col("_code"), "left").select(*[rows[c] for c in rows.columns], *[F.col("_entry")[c].alias(c) for c in catalogue.columns])


def band_pairs(rows: DataFrame, keys: list[str], size: str, low: int, high: int, name: str) -> DataFrame:
    """Pairs of rows of equal keys of which the second's size is ``low`` to ``high`` per cent of the first's (whole numbers; ``low`` at least 1). Sizes fall into buckets that grow like the band,
    so that the first's band meets three at most: buckets are joined by equality, and the band is checked on what meets. Sizes that are null or not positive, null keys, and a row with itself pair
    with nothing."""
    width = max(math.log(high / low), 0.01)
    near = lambda x, slack: F.floor(F.log(x.cast("double")) / width + slack)
    some = rows.where(F.col(size) > 0)
    small = some.select(*keys, F.col(name).alias(f"{name}_first"), F.col(size).alias("_a"), F.explode(F.sequence(near(F.col(size) * (low / 100), -1e-9), near(F.col(size) * (high / 100), 1e-9))).alias("_bucket"))
    large = some.select(*keys, F.col(name).alias(f"{name}_second"), F.col(size).alias("_b"), near(F.col(size), 0).alias("_bucket"))
    met = small.join(large, [*keys, "_bucket"]).where((F.col("_b") * 100 >= F.col("_a") * low) & (F.col("_b") * 100 <= F.col("_a") * high) & (F.col(f"{name}_first") != F.col(f"{name}_second")))
    return met.select(*keys, f"{name}_first", f"{name}_second")


#: Sizes of a base layer by profile of the layer that enhances it and that layer's own size; fixed values.
LAYERS = {(4, 960, 540): [(1920, 1080)], (7, 1920, 1080): [(1920, 1080), (3840, 2160)]}


def hidden_layers(rows: DataFrame) -> DataFrame:
    """Tracks (unit, place, pid, codec, profile, base_pid, width, height, keep) with ``hidden``: kept tracks with a profile that enhance another track of the unit. Where they name its pid, a track with
    that pid must be there; else one of the same codec and of a size that goes with the profile and their own size. Sizes to look for come from a table, so tracks meet by equality."""
    own = rows.where("profile IS NOT NULL AND keep").select("unit", "place", "codec", "profile", "base_pid", "width", "height")
    other = rows.select(F.col("unit").alias("_unit"), F.col("place").alias("_place"), F.col("pid").alias("_pid"), F.col("codec").alias("_codec"), F.col("width").alias("_width"), F.col("height").alias("_height"))
    apart = (F.col("unit") == F.col("_unit")) & (F.col("place") != F.col("_place"))
    named = own.where("base_pid IS NOT NULL").join(other, apart & (F.col("base_pid") == F.col("_pid")), "left_semi")
    sizes = F.lit(None).cast("array<struct<w:int,h:int>>")
    for (profile, w, h), wanted in LAYERS.items():
        sizes = F.when((F.col("profile") == profile) & (F.col("width") == w) & (F.col("height") == h), F.array(*[F.struct(F.lit(x).alias("w"), F.lit(y).alias("h")) for x, y in wanted])).otherwise(sizes)
    sized = own.where("base_pid IS NULL").withColumn("_size", F.explode(sizes))
    sized = sized.join(other, apart & (F.col("codec") == F.col("_codec")) & (F.col("_size.w") == F.col("_width")) & (F.col("_size.h") == F.col("_height")), "left_semi")
    found = named.select("unit", "place").unionByName(sized.select("unit", "place")).distinct().withColumn("_found", F.lit(True))
    return rows.join(found, ["unit", "place"], "left").withColumn("hidden", F.coalesce("_found", F.lit(False))).select(*rows.columns, "hidden")


def aliases(languages: DataFrame) -> DataFrame:
    """alias (lower-case), short, code of languages (place, code, label). A label may end with ``(xx; yyy)``, of which the two letters are the short code, else the code is short. Aliases are, in
    this order, the code, the short code, the two letters, the label without its brackets, and the label; of equal ones the first language's stays."""
    two = F.nullif(F.regexp_extract("label", r"(?i)\(([a-z]{2});\s*[a-z]{3}\)", 1), F.lit(""))
    short = F.coalesce(F.nullif(F.regexp_extract("label", r"(?i)\(([a-z]{2});\s*[a-z]{3}\)$", 1), F.lit("")), F.col("code"))
    shown = trimmed(F.regexp_replace("label", r"\s*\([^)]*\)\s*$", ""))
    said = languages.select("place", "code", short.alias("short"), F.posexplode(F.array("code", short, two, shown, "label")).alias("rank", "alias"))
    first = keep_first(said.where("alias <> ''").withColumn("alias", F.lower("alias")), ["alias"], ["place", "rank"])
    return first.select("alias", "short", "code")


def by_alias(rows: DataFrame, value: str, names: DataFrame, most: int = SENT) -> DataFrame:
    """Rows with ``short`` and ``code`` of the language that the value is an alias of, in whatever case; of any other value it is the value itself, trimmed."""
    key = trimmed(F.col(value))
    met = rows.join(bounded(names.select(F.col("alias").alias("_alias"), F.col("short").alias("_short"), F.col("code").alias("_own")), most), F.lower(key) == F.col("_alias"), "left")
    return met.select(*[rows[c] for c in rows.columns], F.coalesce("_short", key).alias("short"), F.coalesce("_own", key).alias("code"))


def preset_names(rows: DataFrame, presets: DataFrame, names: DataFrame, kind: str = "kind", language: str = "language", most: int = SENT) -> DataFrame:
    """Rows with ``options``: the names that ``presets`` (kind, code, names: one a line; one row for a kind and code) has for their kind and the code of their language, trimmed, without empty ones, and of names
    that differ in case only the first; an empty list where there is none."""
    lines = distinct_folded(F.filter(F.transform(F.split("names", "\n"), trimmed), lambda x: x != ""))
    held = bounded(presets.select(F.col("kind").alias("_kind"), F.col("code").alias("_code"), lines.alias("_lines")), most)
    met = by_alias(rows, language, names, most).join(held, (F.col(kind) == F.col("_kind")) & (F.col("code") == F.col("_code")), "left")
    return met.select(*rows.columns, F.coalesce("_lines", F.array().cast("array<string>")).alias("options"))


_TAG = r"(?i)^(?:(?:[a-z]{2,3}(?:-[a-z]{3}){0,3}|[a-z]{4,8})(?:-[a-z]{4})?(?:-(?:[a-z]{2}|[0-9]{3}))?(?:-(?:[a-z0-9]{5,8}|[0-9][a-z0-9]{3}))*(?:-[a-wy-z0-9](?:-[a-z0-9]{2,8})+)*(?:-x(?:-[a-z0-9]{1,8})+)?|x(?:-[a-z0-9]{1,8})+)$"


def language_tag(tag: Column) -> Column:
    """A well-formed language tag (RFC 5646; its list of old irregular tags is not known here) in its usual case: lower, but a script's first letter and a region; else null."""
    parts = F.split(F.lower(tag), "-")
    single = F.array_position(F.transform(parts, lambda x: F.length(x)), F.lit(1))  # what follows a single letter stays lower
    cased = F.transform(parts, lambda x, i: F.when((i == 0) | ((single > 0) & (i + 1 >= single)), x).when(x.rlike("^[a-z]{4}$"), F.initcap(x)).when(x.rlike("^[a-z]{2}$"), F.upper(x)).otherwise(x))
    return F.when(tag.rlike(_TAG), F.array_join(cased, "-"))


def resolved_language(rows: DataFrame, tag: str, code: str, codes: DataFrame, default: str | None = None, most: int = SENT) -> DataFrame:
    """Rows with iso639_2, iso639_2_bib, iso639_1, ietf and name of their language: by the tag if it is well-formed (its first part may be unknown: ``und`` without a name, and the tag stays), else by the
    code if that is known, else ``default``'s, else ``und``. ``codes``: code, bib, alpha2, name, one row a language; a tag's first part of two letters is looked up in alpha2, one of three letters, and a code,
    in bib, then in code."""
    entry = F.struct(F.col("code").alias("iso639_2"), F.col("bib").alias("iso639_2_bib"), F.col("alpha2").alias("iso639_1"), "name")
    keys = codes.select(F.explode(F.array(F.struct(F.col("bib").alias("key"), F.lit(0).alias("rank")), F.struct(F.col("code").alias("key"), F.lit(1).alias("rank")), F.struct(F.col("alpha2").alias("key"), F.lit(2).alias("rank")))).alias("k"), entry.alias("entry"))
    keys = keys.where("k.key IS NOT NULL").groupBy(F.lower("k.key").alias("key")).agg(F.min_by("entry", "k.rank").alias("entry"))
    table = lambda n: bounded(keys.select(F.col("key").alias(f"_key{n}"), F.col("entry").alias(f"_entry{n}")), most)
    canonical = language_tag(F.col(tag))
    primary = F.lower(F.split(canonical, "-")[0])
    plain = F.lower(F.trim(F.col(code)))
    fallback = None if default is None else codes.where(F.col("code") == default).select(entry.alias("e")).first()
    none = lambda name: F.struct(F.lit("und").alias("iso639_2"), F.lit(None).cast("string").alias("iso639_2_bib"), F.lit(None).cast("string").alias("iso639_1"), F.lit(name).cast("string").alias("name"))
    last = none("Undetermined") if fallback is None else F.struct(*[F.lit(fallback.e[c]).cast("string").alias(c) for c in ("iso639_2", "iso639_2_bib", "iso639_1", "name")])
    met = rows.withColumn("_tag", canonical).join(table(1), F.when(F.length(primary).isin(2, 3), primary) == F.col("_key1"), "left").join(table(2), F.when(F.length(plain) == 3, plain) == F.col("_key2"), "left")
    found = F.when(F.col("_tag").isNotNull(), F.coalesce("_entry1", none(None))).otherwise(F.coalesce(F.col("_entry2"), last))
    out = met.withColumn("_found", found)
    return out.select(*[rows[c] for c in rows.columns], "_found.iso639_2", "_found.iso639_2_bib", "_found.iso639_1", F.col("_tag").alias("ietf"), "_found.name")
