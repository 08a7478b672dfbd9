"""Queries of what is shown of tracks and queues, of gates and flags: line items stand for tracks, orders for queue items, pages for attachments."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import shown, text
from trackloom.operators import queues, tracks
from trackloom.plans import media
from trackloom.plans.lists import _ITEMS, _items
from trackloom.plans.registry import _query, _t

_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@_query(f"""
SELECT {_KEY}, CASE l_returnflag WHEN 'R' THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || 'x' || l_linenumber WHEN 'A' THEN CASE l_linenumber WHEN 1 THEN 'mono' WHEN 2 THEN 'stereo' ELSE l_linenumber || 'ch' END
    ELSE CASE WHEN l_linestatus = 'O' THEN 'Text' ELSE 'Image' END || CASE WHEN l_tax >= 0.04 THEN ' UTF-8' ELSE '' END || CASE WHEN l_linenumber > 3 THEN ' p' || l_suppkey ELSE '' END END AS description,
    CASE WHEN l_discount < 0.05 THEN l_linestatus ELSE l_returnflag END AS codec FROM lineitem
""")
def kernel_described_rows(spark, d):
    """Descriptions of tracks by the properties that they have, and codecs by name or id."""
    line, n = _t(spark, d, "lineitem"), F.col("l_linenumber")
    flag = lambda x: F.when(F.col("l_returnflag") == x, F.lit(1))
    video = F.concat_ws("x", F.col("l_quantity").cast("long").cast("string"), n.cast("string"))
    audio = text.channel_label(F.lit(None).cast("string"), n)
    subtitle = shown.subtitle_description(F.col("l_linestatus") == "O", F.lit(""), F.when(F.col("l_tax") >= 0.04, "UTF-8"), F.when(n > 3, F.col("l_suppkey")))
    told = shown.described((flag("R"), video), (flag("A"), audio), (F.lit(1), subtitle))
    return line.select(*_KEY.split(", "), told.alias("description"), shown.codec_shown(F.when(F.col("l_discount") < 0.05, F.col("l_linestatus")), F.col("l_returnflag")).alias("codec"))


@_query("""
WITH t AS (SELECT l_partkey, l_linenumber, l_orderkey * 100 + l_suppkey AS pos, l_orderkey, l_suppkey, l_discount, l_tax FROM lineitem WHERE l_quantity > 5),
f AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY pos, l_suppkey, l_orderkey) AS r FROM t)
SELECT l_partkey, l_linenumber, l_orderkey, l_suppkey FROM f WHERE r = 1 AND l_discount > 0 AND l_tax > 0
""")
def kernel_track_gate(spark, d):
    """Line items as tracks of parts, numbered by their lines: those without a number, a type or a codec go, and later ones of the same number."""
    line = _t(spark, d, "lineitem")
    rows = line.select(
        "l_partkey", F.when(F.col("l_quantity") > 5, F.col("l_linenumber")).alias("l_linenumber"), F.struct((F.col("l_orderkey") * 100 + F.col("l_suppkey")).alias("a"), "l_suppkey", "l_orderkey").alias("pos"),
        "l_orderkey", "l_suppkey", F.when(F.col("l_discount") > 0, "video").alias("kind"), F.when(F.col("l_tax") > 0, "V").otherwise("").alias("codec"),
    )
    return tracks.gated(rows, "l_partkey", "pos", "l_linenumber", "kind", "codec").select("l_partkey", "l_linenumber", "l_orderkey", "l_suppkey")


@_query(f"""
WITH r AS (SELECT *, track_name = '' AS checked, -seq AS own FROM ({media._ROWS}))
SELECT k, id, CASE WHEN checked AND type <> 'attachment' THEN CASE WHEN row_number() OVER (PARTITION BY k, type, checked ORDER BY own) = 1 THEN 'true' ELSE 'false' END ELSE default_track END AS default_track,
    CASE WHEN checked AND type <> 'attachment' THEN 'false' ELSE forced END AS forced FROM r
""")
def kernel_unit_flags(spark, d):
    """Defaults of each order's checked tracks by an order of its own; none is forced."""
    rows = media._rows(spark, d).withColumns({"checked": F.col("track_name") == "", "own": -F.col("seq")})
    return tracks.unit_flags(rows, "k", "type", "own", "checked").select("k", "id", "default_track", "forced")


def _scaled(n: str, base: int, labels: str, places: int, suffix: str) -> str:
    """SQL of a double in the largest of some units that it exceeds, by the exact value of the quotient."""
    out = f"CASE WHEN {n} = floor({n}) THEN CAST(CAST({n} AS BIGINT) AS VARCHAR) ELSE CAST({n} AS VARCHAR) END || '{suffix}'"
    for k, label in enumerate(labels.split(), 1):
        q = f"({n} / {float(base**k)!r}::DOUBLE)"
        h = f"(CAST(({q} - floor({q})) * 4503599627370496 AS HUGEINT) * {2 * 10**places} + 4503599627370496) // 9007199254740992"
        whole = f"CAST(CAST(floor({q}) AS BIGINT) + ({h}) // {10**places} AS VARCHAR)"
        number = f"rtrim(rtrim({whole} || '.' || lpad(CAST(({h}) % {10**places} AS VARCHAR), {places}, '0'), '0'), '.')" if places else whole
        out = f"CASE WHEN {n} > {base**k} THEN {number} || '{label}{suffix}' ELSE {out} END"
    return out


@_query(f"""
SELECT {_KEY}, CASE l_returnflag WHEN 'R' THEN {_scaled('n', 1024, 'K M', 1, 'B')} WHEN 'A' THEN {_scaled('n', 1000, 'Ki Mi', 0, 'B')} ELSE {_scaled('n', 1024, 'K M G T', 2, 'B')} END AS size FROM (SELECT *, l_extendedprice * l_quantity AS n FROM lineitem)
""")
def kernel_size_by_type(spark, d):
    """Sizes of line items as their types are shown: two have a choice of their own."""
    kind = F.when(F.col("l_returnflag") == "R", "video").when(F.col("l_returnflag") == "A", "audio").otherwise("chapters")
    return _t(spark, d, "lineitem").select(*_KEY.split(", "), shown.value_by_type(F.col("l_extendedprice") * F.col("l_quantity"), kind, "B", {"video": ("KM", 1), "audio": ("KMi", 0), "chapters": ("K", 0)}).alias("size"))


@_query(f"""
WITH i AS ({_ITEMS}) SELECT drive, file, row_number() OVER (PARTITION BY drive ORDER BY ord) - 1 AS place FROM i
""")
def kernel_queue_by_drive(spark, d):
    """Queue items in the lists of their drives."""
    return queues.by_drive(_items(spark, d)).select("drive", "file", "place")


@_query(f"""
WITH i AS ({_ITEMS}), s AS (SELECT DISTINCT l_orderkey AS file FROM lineitem WHERE l_quantity > 45),
g AS (SELECT i.unit, i.status, s.file IS NOT NULL AS sel FROM i LEFT JOIN s USING (file))
SELECT unit, bool_or(sel) AND NOT bool_or(status IN ('waiting', 'merging')) AS can_merge, bool_or(sel) AS can_copy, NOT bool_or(status IN ('waiting', 'merging')) AS can_clear, bool_or(status = 'waiting') AS has_waiting FROM g GROUP BY 1
""")
def kernel_group_state(spark, d):
    """What can be done with customers as groups of orders."""
    items = _items(spark, d)
    units = items.select(F.col("unit").alias("group"), F.col("file").alias("root"), "file")
    return queues.group_state(units, _t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("file")), items.select("file", "status")).withColumnRenamed("group", "unit")


@_query("""
SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%H:%M:%S') AS clock, CASE event_type WHEN 'error' THEN 'The file is damaged: ' || props WHEN 'view' THEN 'Reading took more than ' || user_id || ' ms at view: ' || props ELSE props END AS said FROM events
""")
def kernel_event_texts(spark, d):
    """Times of day of events in another zone, and texts of those that are errors."""
    kind = F.when(F.col("event_type") == "error", "malformed").when(F.col("event_type") == "view", "timeout").otherwise("other")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return _t(spark, d, "events").select("event_id", shown.clock_time(ms, "+05:30").alias("clock"), shown.error_text(kind, F.col("props"), detail=F.col("props"), budget_ms=F.col("user_id"), stage=F.col("event_type")).alias("said"))
