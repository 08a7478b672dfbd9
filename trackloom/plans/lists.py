"""Queries of queues, selections and normal forms: orders and customers stand for files and their merge trees, line items for tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import normal
from trackloom.operators import queues
from trackloom.plans.registry import _query, _t

_STATUS = "CASE o_orderstatus WHEN 'O' THEN 'waiting' WHEN 'P' THEN 'merging' ELSE CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'completed' WHEN 1 THEN 'cancelled' ELSE 'failed' END END"
_ITEMS = f"SELECT o_orderkey AS file, o_orderpriority AS drive, {_STATUS} AS status, CAST(o_orderkey % 100 AS INT) AS progress, o_orderkey % 5 = 0 AS cancel_requested, o_orderkey AS ord, o_custkey AS unit FROM orders"


def _items(spark, d):
    """Orders as queue items."""
    k = F.col("o_orderkey")
    ended = F.when(k % 3 == 0, "completed").when(k % 3 == 1, "cancelled").otherwise("failed")
    status = F.when(F.col("o_orderstatus") == "O", "waiting").when(F.col("o_orderstatus") == "P", "merging").otherwise(ended)
    return _t(spark, d, "orders").select(k.alias("file"), F.col("o_orderpriority").alias("drive"), status.alias("status"), (k % 100).cast("int").alias("progress"), (k % 5 == 0).alias("cancel_requested"), k.alias("ord"), F.col("o_custkey").alias("unit"))


_FINAL = "('completed', 'cancelled', 'failed')"


@_query(f"""
WITH i AS ({_ITEMS}), s AS (SELECT CASE WHEN l_linenumber = 3 THEN -l_orderkey ELSE l_orderkey END AS file, CASE WHEN min(l_linenumber) = 1 THEN 'merging' ELSE 'waiting' END AS status, CAST(count(*) AS INT) AS progress FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1)
SELECT file, s.status AS status, s.progress AS progress, FALSE AS cancel_requested FROM s WHERE file NOT IN (SELECT file FROM i)
UNION ALL SELECT i.file, s.status, s.progress, CASE WHEN i.status IN {_FINAL} THEN FALSE ELSE i.cancel_requested END FROM i JOIN s ON i.file = s.file
UNION ALL SELECT file, CASE WHEN status IN {_FINAL} THEN status WHEN cancel_requested THEN 'cancelled' ELSE 'completed' END, CASE WHEN status IN {_FINAL} OR cancel_requested THEN progress ELSE 100 END, cancel_requested FROM i WHERE file NOT IN (SELECT file FROM s)
""")
def kernel_queue_reconcile(spark, d):
    """Queue items after a snapshot of the tasks at work."""
    key = F.when(F.col("l_linenumber") == 3, -F.col("l_orderkey")).otherwise(F.col("l_orderkey"))
    snapshot = _t(spark, d, "lineitem").where("l_returnflag <> 'A'").groupBy(key.alias("file")).agg(F.when(F.min("l_linenumber") == 1, "merging").otherwise("waiting").alias("status"), F.count("*").cast("int").alias("progress"))
    return queues.reconciled(_items(spark, d), snapshot)


@_query(f"""
WITH i AS ({_ITEMS}), a AS (SELECT l_partkey AS file, min(l_orderkey) AS ord FROM lineitem GROUP BY 1)
SELECT file, CASE WHEN a.file IS NOT NULL AND (i.status IS NULL OR i.status IN {_FINAL}) THEN 'waiting' ELSE i.status END AS status, CASE WHEN a.file IS NOT NULL AND (i.status IS NULL OR i.status IN {_FINAL}) THEN 0 ELSE progress END AS progress,
i.file IS NULL AS late, coalesce(i.ord, a.ord) AS ord FROM i FULL JOIN a USING (file)
""")
def kernel_requeue(spark, d):
    """Queue items after files are asked for again, and others for the first time."""
    asked = _t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("file")).agg(F.min("l_orderkey").alias("ord"))
    return queues.requeued(_items(spark, d), asked).select("file", "status", "progress", "place.late", "place.ord")


@_query(f"""
SELECT file, drive, status FROM ({_ITEMS}) WHERE NOT (status IN {_FINAL} AND drive IN (SELECT o_orderpriority FROM orders GROUP BY 1 HAVING min(o_orderkey) % 2 = 0))
""")
def kernel_clear_drives(spark, d):
    """Queue items without those that have ended on some drives."""
    drives = _t(spark, d, "orders").groupBy("o_orderpriority").agg((F.min("o_orderkey") % 2 == 0).alias("even")).where("even").select("o_orderpriority")
    return queues.cleared(_items(spark, d), drives).select("file", "drive", "status")


@_query(f"""
SELECT unit, bool_or(status IN {_FINAL}) AS has_completed, bool_or(status IN ('waiting', 'merging')) AS has_active, bool_or(status IN ('cancelled', 'failed')) AS has_resumable FROM ({_ITEMS}) GROUP BY unit
""")
def kernel_group_flags(spark, d):
    """Whether a customer's orders have ended, are active or can be resumed."""
    return queues.flags(_items(spark, d), "unit")


@_query("""
SELECT l_orderkey AS k, CASE WHEN count(DISTINCT mode) = 1 AND bool_and(mode <> '' AND mode IS NOT NULL) THEN any_value(mode) END AS mode
FROM (SELECT l_orderkey, CASE WHEN l_quantity < 2 THEN NULL WHEN l_quantity < 4 THEN '' ELSE l_linestatus || l_returnflag END AS mode FROM lineitem) GROUP BY 1
""")
def kernel_common_value(spark, d):
    """The value that all line items of an order have."""
    mode = F.when(F.col("l_quantity") < 2, F.lit(None)).when(F.col("l_quantity") < 4, "").otherwise(F.concat("l_linestatus", "l_returnflag"))
    return _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(queues.common_value(mode).alias("mode"))


@_query(f"""
WITH u AS (SELECT min(o_orderkey) AS root, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS members FROM orders GROUP BY o_custkey)
SELECT file, coalesce(members, CAST(file AS VARCHAR)) AS members FROM ({_ITEMS}) LEFT JOIN u ON root = file WHERE status IN ('cancelled', 'failed')
""")
def kernel_resume_units(spark, d):
    """The unit of each item to resume; files that are no roots stand alone."""
    units = _t(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("root"), F.array_sort(F.collect_list("o_orderkey")).alias("members"))
    return queues.to_resume(_items(spark, d), units).select("file", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@_query(f"""
WITH i AS (SELECT c_custkey AS file FROM customer WHERE c_acctbal < 0), m AS (SELECT o_custkey AS unit, o_orderkey AS file, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT unit, file, CASE WHEN n = 1 THEN 'single' ELSE 'multi' END AS form, row_number() OVER (PARTITION BY unit ORDER BY file) - 1 AS file_index FROM m
WHERE file IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) AND unit NOT IN (SELECT file FROM i)
""")
def kernel_unit_inputs(spark, d):
    """Orders with picked line items as numbered inputs of their customers, whose merges aren't at work yet."""
    members = _t(spark, d, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("file"), F.col("o_orderkey").alias("ord"))
    picked = _t(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("file"))
    items = _t(spark, d, "customer").select(F.col("c_custkey").alias("file"), F.when(F.col("c_acctbal") < 0, "waiting").otherwise("failed").alias("status"))
    return queues.unit_inputs(members, picked, items).select("unit", "file", "form", "file_index")


@_query("""
WITH gone AS (SELECT o_orderkey AS g FROM orders WHERE o_orderstatus = 'P') SELECT o_orderkey AS source, o_orderkey // 2 AS target FROM orders WHERE o_orderkey NOT IN (SELECT g FROM gone) AND o_orderkey // 2 NOT IN (SELECT g FROM gone)
""")
def kernel_remove_files(spark, d):
    """Merges of which neither side is a removed file."""
    orders = _t(spark, d, "orders")
    merges = orders.select(F.col("o_orderkey").alias("source"), F.expr("o_orderkey div 2").alias("target"))
    return queues.without_files(merges, orders.where("o_orderstatus = 'P'").select("o_orderkey"), "source", "target")


@_query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 4 + 1 = l_linenumber)
""")
def kernel_chosen_tracks(spark, d):
    """Line items that are picked by order and number."""
    picks = _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("l_linenumber"))
    return queues.chosen(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), picks, ["l_orderkey", "l_linenumber"])


@_query("""
WITH n AS (SELECT l_orderkey AS k, l_linenumber AS n, bool_or(l_quantity > 25) AS cur, bool_or(l_tax < 0.04) AS pick FROM lineitem GROUP BY ALL)
SELECT k, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY NOT cur, n) FILTER (cur <> pick), '') AS flipped, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY NOT cur, n) FILTER (cur OR pick), '') AS added,
coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FILTER (cur AND NOT pick), '') AS removed FROM n GROUP BY k
""")
def kernel_selection(spark, d):
    """Selections of an order's line items with some added, removed or flipped."""
    having = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("l_linenumber"))))
    sets = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(having(F.col("l_quantity") > 25).alias("cur"), having(F.col("l_tax") < 0.04).alias("pick"))
    shown = lambda c: F.array_join(c.cast("array<string>"), ",")
    return sets.select("k", shown(queues.flipped(F.col("cur"), F.col("pick"))).alias("flipped"), shown(F.array_union("cur", "pick")).alias("added"), shown(F.array_except("cur", "pick")).alias("removed"))


_TIES = "l_linenumber, l_partkey, l_suppkey, l_shipdate"


@_query(f"""
WITH o AS (SELECT l_orderkey AS k, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey DESC) AS pos FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 20 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')))
SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos NULLS LAST, {_TIES}) - 1 AS place FROM lineitem LEFT JOIN o ON k = l_orderkey AND part = l_partkey
""")
def kernel_custom_order(spark, d):
    """Line items in an own order where their order has one; those that it lacks follow."""
    line = _t(spark, d, "lineitem").select("l_orderkey", *_TIES.split(", "), "l_quantity")
    opened = _t(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    lists = line.where("l_quantity > 20").join(opened, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey"), False).alias("own"))
    rows = line.join(lists, "l_orderkey", "left")
    return queues.in_custom_order(rows, "l_orderkey", F.col("own"), "l_partkey", _TIES.split(", ")).select("l_orderkey", "l_partkey", "l_linenumber", "place")


@_query("""
WITH f AS (SELECT user_id, event_type AS t, min(event_id) AS e FROM events GROUP BY ALL), r AS (SELECT user_id, x.t, x.i FROM (SELECT DISTINCT user_id FROM events), (VALUES ('view', 0), ('signup', 1), ('click', 2), ('other', 3)) x(t, i)),
u AS (SELECT user_id, t, 0 AS late, e AS o FROM f UNION ALL SELECT user_id, t, 1, i FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.user_id = r.user_id AND f.t = r.t)), h AS (SELECT user_id, arg_min(t, e) AS first_type, coalesce(arg_min(t, e) FILTER (t = 'purchase'), arg_min(t, e)) AS active FROM f GROUP BY 1)
SELECT user_id, string_agg(t, ',' ORDER BY late, o) AS options, any_value(active) AS active FROM u JOIN h USING (user_id) GROUP BY user_id
""")
def kernel_options(spark, d):
    """A user's types of events as preferred options before all others, and the active one of them, else the first."""
    firsts = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("e"))
    own = firsts.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("e", "event_type"))), lambda x: x["event_type"]).alias("own"))
    rest = F.array(*map(F.lit, ("view", "signup", "click", "other")))
    return own.select("user_id", F.array_join(queues.preferred_first(F.col("own"), rest), ",").alias("options"), queues.first_match(F.col("own"), lambda x: x == "purchase").alias("active"))


@_query("""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'app ' || trim_version WHEN 1 THEN 'AppX' WHEN 2 THEN 'App 1.' || (256 + user_id % 9) WHEN 3 THEN 'avimuxgui 1.' || user_id % 200 WHEN 4 THEN ' ' ELSE 'x 0.0' END AS app,
CASE event_id % 4 WHEN 0 THEN 'AC' || user_id % 10 || ' ' WHEN 1 THEN 'MP4A' END AS code, strftime(TIMESTAMP '2001-01-01' + to_seconds(CAST(floor((event_id % 1000 - 500) * 7777777.7777777) AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') AS dated,
event_id * 1000000 // 45 AS ticks, CASE WHEN user_id % 4 > 0 THEN CAST(event_id AS HUGEINT) * 1000003 * 1000000000 // (user_id % 4 * 90000) END::BIGINT AS frame, greatest(100, least(60000, event_id * 13)) AS budget
FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN '3.' || user_id % 256 ELSE '3.' || user_id % 256 || '.0.7' END AS trim_version FROM events)
""")
def kernel_normal_forms(spark, d):
    """Application names, four-byte codes, dates, ticks, frame durations and budgets in normal form."""
    e, u = F.col("event_id"), F.col("user_id")
    n = lambda c: c.cast("string")
    version = F.concat(F.lit("3."), n(u % 256), F.when(u % 2 == 0, ".0.0").otherwise(".0.7"))
    app = F.when(e % 6 == 0, F.concat(F.lit(" APP v"), version, F.lit(" 64-bit "))).when(e % 6 == 1, "AppX").when(e % 6 == 2, F.concat(F.lit("App 1."), n(256 + u % 9)))
    app = app.when(e % 6 == 3, F.concat(F.lit("AVI-Mux GUI 1."), n(u % 200), F.lit("-beta"))).when(e % 6 == 4, " ").otherwise("X 0..")
    code = F.when(e % 4 == 0, F.concat(F.lit("ac"), n(u % 10), F.lit(" \0"))).when(e % 4 == 1, "\tmp4a").when(e % 4 == 2, "mp4").otherwise("acé3")
    ns = (e % 1000 - 500) * F.lit(7777777777777700)
    return _t(spark, d, "events").select(
        "event_id", normal.writing_app(app).alias("app"), normal.fourcc(code).alias("code"), normal.date_2001(ns).alias("dated"),
        normal.ticks_ns(e).alias("ticks"), normal.frame_ns(e * 1000003, u % 4 * 90000).alias("frame"), normal.budget_ms(e * 13).alias("budget"),
    )


@_query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CASE WHEN l_tax < 0.03 THEN 'false' WHEN l_tax < 0.06 THEN 'unspecified' ELSE 'true' END AS flag, CASE l_returnflag WHEN 'R' THEN 'video' WHEN 'A' THEN 'buttons' ELSE 'unknown' END AS type FROM lineitem
""")
def kernel_flag_cycle(spark, d):
    """Flags after a click, and the names of types."""
    tax, kind = F.col("l_tax"), F.col("l_returnflag")
    flag = F.when(tax < 0.03, "true").when(tax < 0.06, "false").otherwise("unspecified")
    return _t(spark, d, "lineitem").select("l_orderkey", *_TIES.split(", "), normal.next_flag(flag).alias("flag"), normal.shown_type(F.when(kind == "R", "video").when(kind == "A", "buttons").otherwise("data")).alias("type"))


@_query("""
SELECT '/in/' || user_id || '.idx' AS path, CASE min(event_type) WHEN 'click' THEN '/in/' || user_id || '.sub' WHEN 'purchase' THEN '/in/' || user_id || '.SUB' END AS sub_path FROM events WHERE event_type IN ('click', 'purchase', 'view') GROUP BY user_id HAVING bool_or(event_type = 'view')
""")
def kernel_sibling_files(spark, d):
    """Index files, of users with a view, with the bitmap files beside them: one of clicks before one of purchases."""
    kinds = _t(spark, d, "events").select("user_id", "event_type").distinct()
    ext = F.when(F.col("event_type") == "click", "sub").when(F.col("event_type") == "purchase", "SUB").when(F.col("event_type") == "view", "idx").otherwise("srt")
    return normal.with_bitmaps(kinds.select(F.concat(F.lit("/in/"), F.col("user_id").cast("string"), F.lit("."), ext).alias("path")), "path")


@_query(r"""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || '/a.idx' WHEN 1 THEN url || '/.sub' ELSE url || '.Srt' END AS path, page_id % 3 = 2 AND NOT ends_with(url, '/') AND page_id % 5 <= 1 AS empty FROM pages
""")
def kernel_subtitle_paths(spark, d):
    """Index files of bitmap subtitles, and text files with nothing but a mark; a name that begins with its only dot has no extension."""
    p, url = F.col("page_id"), F.col("url")
    path = F.when(p % 3 == 0, F.concat(url, F.lit("/a.SUB"))).when(p % 3 == 1, F.concat(url, F.lit("/.sub"))).otherwise(F.concat(url, F.lit(".Srt")))
    return _t(spark, d, "pages").select("page_id", normal.index_path(path).alias("path"), normal.empty_subtitles(path, p % 5 + 3, F.lit(3)).alias("empty"))
