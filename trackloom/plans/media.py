"""Queries of the media transforms: orders stand for files and line items for their tracks, with types, languages, names and flags made from their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import text
from trackloom.operators import groups, tracks
from trackloom.plans import commands
from trackloom.plans.registry import ORACLES, QUERIES, _query, _t

_IDS, _SEQ = "l_linenumber, l_partkey, l_suppkey, l_shipdate", "l_shipdate, l_partkey, l_suppkey, l_linenumber"
_TYPE = "CASE WHEN l_discount >= 0.09 THEN 'attachment' WHEN l_returnflag = 'R' THEN 'video' WHEN l_returnflag = 'A' THEN 'audio' ELSE 'subtitles' END"
_ROWS = f"""
SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_IDS}) - 1 AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_SEQ}) - 1 AS seq, {_TYPE} AS type,
CASE WHEN l_tax < 0.02 THEN '' WHEN l_tax < 0.04 THEN 'und' WHEN l_linestatus = 'F' THEN 'fr' ELSE 'en' END AS language, CASE WHEN l_quantity < 8 THEN 'a "name"' ELSE '' END AS track_name,
CASE WHEN l_quantity > 30 THEN 'true' WHEN l_quantity < 10 THEN 'false' ELSE 'unspecified' END AS default_track, CASE WHEN l_tax > 0.06 THEN 'true' WHEN l_tax < 0.01 THEN 'false' ELSE 'unspecified' END AS forced FROM lineitem"""


def _rows(spark, d):
    """Line items as selected tracks."""
    line = _t(spark, d, "lineitem").withColumn("k", F.col("l_orderkey"))
    line = tracks.compact_ids(tracks.compact_ids(line, "k", _IDS.split(", ")), "k", _SEQ.split(", "), "seq")
    quantity, tax = F.col("l_quantity"), F.col("l_tax")
    three = lambda yes, no: F.when(yes, "true").when(no, "false").otherwise("unspecified")
    return line.select(
        "k", "id", "seq", F.when(F.col("l_discount") >= 0.09, "attachment").when(F.col("l_returnflag") == "R", "video").when(F.col("l_returnflag") == "A", "audio").otherwise("subtitles").alias("type"),
        F.when(tax < 0.02, "").when(tax < 0.04, "und").when(F.col("l_linestatus") == "F", "fr").otherwise("en").alias("language"), F.when(quantity < 8, 'a "name"').otherwise("").alias("track_name"),
        three(quantity > 30, quantity < 10).alias("default_track"), three(tax > 0.06, tax < 0.01).alias("forced"),
    )


_RANK = "CASE type WHEN 'video' THEN 0 WHEN 'audio' THEN 1 WHEN 'subtitles' THEN 2 END"
_S = "chr(31)"


def _take(kind: str, option: str, none: str) -> str:
    return f"coalesce('{option}' || {_S} || string_agg(CAST(id AS VARCHAR), ',' ORDER BY seq) FILTER (type = '{kind}'), '{none}')"


_OPTS = f"""(CASE WHEN language <> '' THEN {_S} || '--language' || {_S} || id || ':' || language ELSE '' END || CASE WHEN track_name <> '' THEN {_S} || '--track-name' || {_S} || id || ':' || track_name ELSE '' END
|| CASE default_track WHEN 'true' THEN {_S} || '--default-track-flag' || {_S} || id || ':1' WHEN 'false' THEN {_S} || '--default-track-flag' || {_S} || id || ':0' ELSE '' END
|| CASE forced WHEN 'true' THEN {_S} || '--forced-display-flag' || {_S} || id || ':1' WHEN 'false' THEN {_S} || '--forced-display-flag' || {_S} || id || ':0' ELSE '' END)"""
_BLOCK = f"""{_take('video', '-d', '--no-video')} || {_S} || {_take('audio', '-a', '--no-audio')} || {_S} || {_take('subtitles', '-s', '--no-subtitles')}
|| coalesce(string_agg({_OPTS}, '' ORDER BY {_RANK}, seq) FILTER ({_RANK} IS NOT NULL), '') || CASE WHEN count(*) FILTER (type = 'chapters') = 0 THEN {_S} || '--no-chapters' ELSE '' END
|| {_S} || '--no-global-tags' || {_S} || {_take('attachment', '--attachments', '--no-attachments')} || {_S} || any_value(file)"""
_QUOTED = rf"""array_to_string(list_transform(string_split(s, {_S}), lambda x: CASE WHEN x = '' OR regexp_matches(x, '[\s"''\\]') THEN '"' || replace(x, '"', '\"') || '"' ELSE x END), ' ')"""


@_query(f"""
WITH r AS ({_ROWS} UNION ALL SELECT o_orderkey, 0, 1000000, 'chapters', '', '', 'unspecified', 'unspecified' FROM orders WHERE o_orderstatus = 'O'),
f AS (SELECT r.*, '/in dir/' || k || '.avi' AS file FROM r),
s AS (SELECT k AS unit, '/opt/tool' || {_S} || '-o' || {_S} || '/out/' || k || '.mkv' || {_S} || {_BLOCK} || coalesce({_S} || '--track-order' || {_S} || string_agg('0:' || id, ',' ORDER BY seq) FILTER ({_RANK} IS NOT NULL), '') AS s FROM f GROUP BY k)
SELECT unit, {_QUOTED} AS command FROM s
""")
def kernel_argv_single(spark, d):
    """The whole command of each order as one input, with chapters of open orders."""
    rows = _rows(spark, d)
    chapters = _t(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("k"), F.lit(0).cast("long").alias("id"), F.lit(1_000_000).cast("long").alias("seq"), F.lit("chapters").alias("type"), *[F.lit("").alias(c) for c in ("language", "track_name")], *[F.lit("unspecified").alias(c) for c in ("default_track", "forced")])
    rows = rows.unionByName(chapters).withColumn("file", F.concat(F.lit("/in dir/"), F.col("k").cast("string"), F.lit(".avi")))
    out = F.concat(text.output_dir(F.lit(""), F.lit("/out"), F.col("file")), F.lit("/"), text.stem(F.col("file")), F.lit(".mkv"))
    made = commands.arguments(rows.withColumn("output", out).withColumnRenamed("k", "unit"))
    return made.select("unit", commands.command_text(F.lit("/opt/tool"), F.col("argv")).alias("command"))


@_query(f"""
WITH o AS (SELECT o_custkey AS unit, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
f AS (SELECT o.unit, o.i, '/in/' || k || '.avi' AS file, r.* FROM ({_ROWS}) r JOIN o USING (k)),
b AS (SELECT unit, i, {_BLOCK} AS s FROM f GROUP BY unit, i),
t AS (SELECT unit, string_agg(i || ':' || id, ',' ORDER BY {_RANK}, i, seq) AS o FROM f WHERE {_RANK} IS NOT NULL GROUP BY unit),
s AS (SELECT unit, '/opt/tool' || {_S} || '-o' || {_S} || '/out/' || unit || '.mkv' || {_S} || string_agg(s, {_S} ORDER BY i) || coalesce({_S} || '--track-order' || {_S} || any_value(o), '') AS s FROM b LEFT JOIN t USING (unit) GROUP BY unit)
SELECT unit, {_QUOTED} AS command FROM s
""")
def kernel_argv_multi(spark, d):
    """The whole command of each customer, whose orders are the inputs of one output."""
    orders = _t(spark, d, "orders").join(_t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi")
    files = tracks.compact_ids(orders.select(F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("k")), "unit", ["k"], "file_index")
    rows = _rows(spark, d).join(files, "k").withColumns({"file": F.concat(F.lit("/in/"), F.col("k").cast("string"), F.lit(".avi")), "output": F.concat(F.lit("/out/"), F.col("unit").cast("string"), F.lit(".mkv"))})
    return commands.arguments_of_many(rows).select("unit", commands.command_text(F.lit("/opt/tool"), F.col("argv")).alias("command"))


_UNITS = "SELECT o_custkey AS unit, CAST(count(*) AS INT) AS members, arg_min(o_orderpriority, o_orderkey) AS dir, min(o_orderkey) AS position, bool_and(o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS loaded FROM orders GROUP BY 1"


def _units(spark, d):
    """Customers as merge trees of their orders, which are loaded if all have line items."""
    with_lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("has")).distinct()
    orders = _t(spark, d, "orders").join(with_lines, "o_orderkey", "left")
    return orders.groupBy(F.col("o_custkey").alias("unit")).agg(F.count("*").cast("int").alias("members"), F.min_by("o_orderpriority", "o_orderkey").alias("dir"), F.min("o_orderkey").alias("position"), F.bool_and(F.coalesce("has", F.lit(False))).alias("loaded"))


def _entries_sql(key: str) -> str:
    return f"""
WITH u AS ({_UNITS}), r AS (SELECT o_custkey AS unit, type, language FROM ({_ROWS}) JOIN orders ON o_orderkey = k),
h AS (SELECT u.unit, any_value(position) AS position, any_value(dir) || '|n=' || any_value(members){key} AS key FROM u LEFT JOIN r USING (unit) WHERE loaded GROUP BY u.unit),
k AS (SELECT key, min(position) AS pos, CASE WHEN count(*) >= 2 THEN 'group' ELSE 'single' END AS kind FROM h GROUP BY key),
e AS (SELECT unit, key, pos, 0 AS late, kind FROM h JOIN k USING (key) UNION ALL SELECT unit, NULL, position, 1, 'single' FROM u WHERE NOT loaded)
SELECT unit, dense_rank() OVER (ORDER BY late, pos) - 1 AS place, kind, key FROM e"""


_COUNTS = "".join(f" || '|{s}=' || count(*) FILTER (type = '{k}')" for k, s in (("video", "v"), ("audio", "a"), ("subtitles", "s"), ("chapters", "c"), ("attachment", "t")))
_LANGS = "".join(f" || '|{s}=' || coalesce(string_agg(language, ',' ORDER BY language) FILTER (type = '{k}'), '')" for k, s in (("video", "v"), ("audio", "a"), ("subtitles", "s")))
_LANGS += "".join(f" || '|{s}=' || count(*) FILTER (type = '{k}')" for k, s in (("chapters", "c"), ("attachment", "t")))


def _shown(spark, d, languages):
    units = _units(spark, d)
    rows = _rows(spark, d).join(_t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("unit")), "k")
    return groups.entries(units, groups.unit_keys(rows, units, languages))


@_query(_entries_sql(_COUNTS))
def kernel_group_entries(spark, d):
    """Customers as list entries, grouped by folder, number of orders and track counts."""
    return _shown(spark, d, False)


@_query(_entries_sql(_LANGS))
def kernel_group_entries_language(spark, d):
    """Customers as list entries, grouped by folder, number of orders and the languages of each type."""
    return _shown(spark, d, True)


@_query("""
SELECT event_id, concat_ws(' ', (event_id % 4096) || 'x' || (user_id % 2160), CASE WHEN event_id % 7 > 0 THEN rtrim(rtrim(printf('%.3f', floor(1e9 / (event_id % 7 * 5000011) * 1000 + 0.5) / 1000), '0'), '.') || 'fps' END) AS video,
concat_ws(' ', CASE event_id % 5 WHEN 0 THEN '5.1' WHEN 1 THEN '7.1.4' WHEN 2 THEN 'mono' WHEN 3 THEN 'stereo' ELSE (user_id % 9) || 'ch' END, CASE WHEN user_id % 3 > 0 THEN rtrim(rtrim(printf('%.3f', floor((user_id % 3 * 11025)::DOUBLE / 1000 * 1000 + 0.5) / 1000), '0'), '.') || 'kHz' END) AS audio FROM events
WHERE event_id % 5 <> 4 OR user_id % 9 NOT IN (1, 2)
UNION ALL SELECT event_id, concat_ws(' ', (event_id % 4096) || 'x' || (user_id % 2160), CASE WHEN event_id % 7 > 0 THEN rtrim(rtrim(printf('%.3f', floor(1e9 / (event_id % 7 * 5000011) * 1000 + 0.5) / 1000), '0'), '.') || 'fps' END),
concat_ws(' ', CASE user_id % 9 WHEN 1 THEN 'mono' ELSE 'stereo' END, CASE WHEN user_id % 3 > 0 THEN rtrim(rtrim(printf('%.3f', floor((user_id % 3 * 11025)::DOUBLE / 1000 * 1000 + 0.5) / 1000), '0'), '.') || 'kHz' END) FROM events WHERE event_id % 5 = 4 AND user_id % 9 IN (1, 2)
""")
def kernel_track_description(spark, d):
    """Descriptions of video and audio tracks from numbers of events."""
    e, u = F.col("event_id"), F.col("user_id")
    layout = F.when(e % 5 == 0, "layout51").when(e % 5 == 1, "layout714").when(e % 5 == 2, "mono").when(e % 5 == 3, "stereo")
    size = F.concat_ws("x", (e % 4096).cast("string"), (u % 2160).cast("string"))
    return _t(spark, d, "events").select("event_id", text.joined(size, text.frame_rate(e % 7 * 5000011)).alias("video"), text.joined(text.channel_label(layout, u % 9), text.sample_rate(u % 3 * 11025)).alias("audio"))


@_query("""
SELECT page_id, lower(CASE WHEN page_id % 3 = 0 THEN 'TTF' WHEN page_id % 3 = 1 THEN CASE WHEN page_id % 2 = 0 THEN 'jpeg' ELSE '' END ELSE '' END) AS subtype FROM pages
""")
def kernel_attachment_subtype(spark, d):
    """Subtypes of attachments by name, else by media type."""
    p = F.col("page_id")
    name = F.when(p % 3 == 0, F.concat(F.lit("font."), p.cast("string"), F.lit(".TTF"))).when(p % 3 == 1, F.lit("cover.")).otherwise("plain")
    mime = F.when((p % 3 == 1) & (p % 2 == 0), "image/JPEG").when(p % 2 == 0, "image/").otherwise(F.lit(None).cast("string"))
    return _t(spark, d, "pages").select("page_id", text.attachment_subtype(name, mime).alias("subtype"))


@_query("""
SELECT user_id, CAST(arg_min(event_id * 1.5, event_id) FILTER (event_type = 'purchase') AS DOUBLE) AS bps FROM events GROUP BY user_id
""")
def kernel_stat_tag(spark, d):
    """The number in a user's first tag of a name."""
    tag = F.struct("event_id", F.when(F.col("event_type") == "purchase", "Bps").otherwise(F.col("event_type")).alias("name"), (F.col("event_id") * 1.5).cast("string").alias("value"))
    own = _t(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(tag)).alias("tags"))
    return own.select("user_id", text.stat_number(F.col("tags"), "BPS").alias("bps"))


@_query(f"""
SELECT k, id, CASE WHEN e.f IS NOT NULL THEN 'true' ELSE forced END AS forced, CASE WHEN e.f IS NOT NULL THEN 'de' ELSE language END AS language FROM ({_ROWS}) r
LEFT JOIN (SELECT o_orderkey AS f, o_orderkey % 3 AS i FROM orders WHERE o_orderstatus = 'P') e ON e.f = k AND e.i = id
""")
def kernel_edit_tracks(spark, d):
    """Flags and languages of one track of each open order set by an edit."""
    edits = _t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 3).alias("id"), F.lit("true").alias("forced"), F.lit("de").alias("language"))
    return tracks.edited(_rows(spark, d), edits, ["k", "id"], ["forced", "language"]).select("k", "id", "forced", "language")


@_query(f"""
SELECT k, id, language, CASE WHEN type = 'audio' AND language = 'en' THEN 'English' WHEN type = 'subtitles' AND language = 'fr' THEN 'French' ELSE track_name END AS track_name
FROM (SELECT k, id, type, track_name, CASE WHEN type <> 'attachment' AND language = 'und' THEN 'en' ELSE language END AS language FROM ({_ROWS}))
""")
def kernel_automation(spark, d):
    """Undetermined languages replaced, then names by type and the new language."""
    rows = _rows(spark, d)
    media = F.col("type").isin(*commands.TAKE)
    rows = rows.withColumn("language", F.when(media & (F.col("language") == "und"), "en").otherwise(F.col("language")))
    preset = F.when((F.col("type") == "audio") & (F.col("language") == "en"), "English").when((F.col("type") == "subtitles") & (F.col("language") == "fr"), "French")
    return rows.select("k", "id", "language", F.coalesce(F.when(media, preset), "track_name").alias("track_name"))


@_query(f"""
WITH r AS (SELECT k, id, seq, count(*) OVER (PARTITION BY k) AS n, k % 4 AS a, k % 3 AS z FROM ({_ROWS}))
SELECT k, id, CASE WHEN a = z OR a >= n OR z >= n THEN seq WHEN seq = a THEN z WHEN seq > a AND seq <= z THEN seq - 1 WHEN seq < a AND seq >= z THEN seq + 1 ELSE seq END AS seq FROM r
""")
def kernel_reorder(spark, d):
    """One track of each order moved to another place."""
    moves = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct().select("k", (F.col("k") % 4).alias("from_place"), (F.col("k") % 3).alias("to_place"))
    return tracks.moved(_rows(spark, d).select("k", "id", "seq"), "k", "seq", moves)


@_query("""
WITH u AS (SELECT DISTINCT user_id, event_id % 5 AS n FROM events), r AS (SELECT user_id, n, row_number() OVER (PARTITION BY user_id ORDER BY n) - 1 AS i FROM u), f AS (SELECT user_id, count(*) FILTER (n = i) AS free FROM r GROUP BY user_id)
SELECT user_id, '/out/film ' || user_id || CASE WHEN free = 0 THEN '' ELSE ' (' || free || ')' END || '.mkv' AS path FROM f
""")
def kernel_output_path(spark, d):
    """The first output name that isn't taken."""
    free = tracks.first_free(_t(spark, d, "events").select("user_id", (F.col("event_id") % 5).alias("n")), "user_id", "n")
    source = F.concat(F.lit("/in/film "), F.col("user_id").cast("string"), F.lit(".avi"))
    return free.select("user_id", F.concat(F.lit("/out/"), text.stem(source), F.when(F.col("free") == 0, "").otherwise(F.concat(F.lit(" ("), F.col("free").cast("string"), F.lit(")"))), F.lit(".mkv")).alias("path"))


@_query("""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 101 AS INT) END AS percent, event_id % 10 > user_id % 10 OR (event_id % 10 = user_id % 10 AND event_id % 3 > 0) AS newer FROM events
""")
def kernel_progress_lines(spark, d):
    """Progress of lines, and which of two versions is later."""
    e, u = F.col("event_id"), F.col("user_id")
    line = F.when(e % 4 == 0, F.concat(F.lit("  Progress: "), (e % 101).cast("string"), F.lit("%"))).when(e % 4 == 1, "Progress: x%").when(e % 4 == 2, "Warning: 12%").otherwise("")
    latest = F.concat(F.lit("v2."), (e % 10).cast("string"), F.lit("."), (e % 3).cast("string"))
    return _t(spark, d, "events").select("event_id", text.progress(line).alias("percent"), text.newer(latest, F.concat(F.lit("2."), (u % 10).cast("string"))).alias("newer"))


@_query("""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/own' WHEN page_id % 3 = 1 THEN '/common' ELSE regexp_extract(url, '^(.*)/', 1) END AS dir,
CASE WHEN page_id % 2 = 0 THEN '/fixed/x.mkv' ELSE '/put/' || regexp_extract(url, '([^/]*)$', 1) END AS path FROM pages
""")
def kernel_output_dir(spark, d):
    """Output folders by precedence, and overrides that name a folder."""
    p, url = F.col("page_id"), F.col("url")
    own, common = F.when(p % 3 == 0, "/own").otherwise(""), F.when(p % 3 < 2, "/common")
    return _t(spark, d, "pages").select("page_id", text.output_dir(own, common, url).alias("dir"), text.overridden_path(F.when(p % 2 == 0, "/fixed/x.mkv").otherwise("/put/"), url).alias("path"))


__all__ = ["ORACLES", "QUERIES"]
