"""Queries of the relational operators by name, and the SQL that gives the same rows.

They run the operators of the library on the given tables: the tables hold no media, so orders stand for files, line items for their tracks,
events for queue events, and so on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import text
from trackloom.operators import groups, joins, tracks

FLAGSHIP = "kernel_group_signature_lang"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Return flags as track types.
FLAG_RANK = {"R": 0, "A": 1, "N": 2}


def _query(oracle: str):
    def add(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, oracle
        return fn

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@_query("""
WITH lines AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS ref, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate) AS r FROM lineitem),
u AS (SELECT k, CAST(n AS BIGINT) * 100 + r AS ord, ref, 'track' AS kind, 0 AS rnk FROM lines
UNION ALL SELECT o_orderkey, 0, o_custkey, 'chapters', 1 FROM orders WHERE o_orderstatus = 'O')
SELECT k, ref, kind, row_number() OVER (PARTITION BY k ORDER BY rnk, ord) - 1 AS seq FROM u
""")
def kernel_flatten_union(spark, d):
    """Line items as tracks, then a chapters row of open orders."""
    from pyspark.sql import Window

    lines = _t(spark, d, "lineitem").withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_shipdate")))
    lines = lines.select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber").cast("long") * 100 + F.col("r")).alias("ord"), F.col("l_partkey").alias("ref"))
    chapters = _t(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("k"), F.lit(0).cast("long").alias("ord"), F.col("o_custkey").alias("ref"))
    return tracks.flatten([("track", lines), ("chapters", chapters)], "k", "ord").select("k", "ref", "kind", "seq")


@_query("""
SELECT user_id, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'purchase') AS n_purchase FROM events GROUP BY user_id
""")
def kernel_type_histogram(spark, d):
    """Events per user by type."""
    return groups.histogram(_t(spark, d, "events"), "user_id", "event_type", ["click", "view", "purchase"])


@_query("""
WITH s AS (SELECT l_orderkey, 'A=' || count(*) FILTER (l_returnflag = 'A') || '|N=' || count(*) FILTER (l_returnflag = 'N') || '|R=' || count(*) FILTER (l_returnflag = 'R') AS signature FROM lineitem GROUP BY l_orderkey)
SELECT signature, count(*) AS n_units, min(l_orderkey) AS first_unit, count(*) >= 2 AS grouped FROM s GROUP BY signature
""")
def kernel_group_signature_count(spark, d):
    """Orders grouped by their line items' counts by flag."""
    return groups.buckets(groups.count_signature(_t(spark, d, "lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "R"]), "signature", "l_orderkey")


@_query("""
WITH c AS (SELECT source, coalesce(nullif(lang, ''), 'und') AS code, count(*) AS n FROM documents GROUP BY ALL),
s AS (SELECT source, string_agg(code || ':' || n, ',' ORDER BY code || ':' || n) AS signature FROM c GROUP BY source)
SELECT signature, count(*) AS n_units, min(source) AS first_unit, count(*) >= 2 AS grouped FROM s GROUP BY signature
""")
def kernel_group_signature_lang(spark, d):
    """Sources grouped by the languages of their documents."""
    return groups.buckets(groups.language_signature(_t(spark, d, "documents"), "source", text.display_language(F.col("lang"))), "signature", "source")


@_query("SELECT doc_id, lang, source FROM documents WHERE lower(lang) IN ('de', 'fr')")
def kernel_list_filter(spark, d):
    """Documents in the languages of a written list."""
    docs = _t(spark, d, "documents").select("doc_id", "lang", "source", F.lit("track").alias("kind"))
    return docs.where(tracks.selected(F.col("kind"), text.equivalent_codes(F.col("lang")), {"track": True}, {"track": " DE, fr,,"})).drop("kind")


@_query("""
SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) = 1 AS is_default FROM lineitem
""")
def kernel_default_flag(spark, d):
    """The first line item of an order by flag is the default."""
    return tracks.default_flags(_t(spark, d, "lineitem"), "l_orderkey", "l_returnflag", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]).select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "is_default")


@_query("""
SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS id FROM lineitem WHERE l_quantity > 25
""")
def kernel_renumber(spark, d):
    """Compact ids after a filter."""
    return tracks.compact_ids(_t(spark, d, "lineitem").where("l_quantity > 25"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]).select("l_orderkey", "l_partkey", "id")


@_query("""
SELECT l_orderkey, l_partkey, id + 1 AS id FROM (SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS id FROM lineitem) WHERE l_quantity > 25
""")
def kernel_gap_ids(spark, d):
    """Ids from 1 given before a filter, so gaps stay."""
    rows = tracks.compact_ids(_t(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]).where("l_quantity > 25")
    return rows.select("l_orderkey", "l_partkey", (F.col("id") + 1).alias("id"))


@_query("""
SELECT l_orderkey, l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END, l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS place FROM lineitem
""")
def kernel_rank_sort(spark, d):
    """Line items in type order within their order."""
    return tracks.in_track_order(_t(spark, d, "lineitem"), "l_orderkey", "l_returnflag", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], FLAG_RANK).select("l_orderkey", "l_partkey", "l_returnflag", "place")


@_query("SELECT c_custkey, c_name, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def kernel_left_fill(spark, d):
    """Customers with their number of orders, 0 where none."""
    return joins.fill_counts(_t(spark, d, "customer").select("c_custkey", "c_name"), _t(spark, d, "orders").select("o_custkey"), "c_custkey", "o_custkey", "n_orders")


@_query("""
SELECT o_custkey AS k, CAST(count(*) AS VARCHAR) AS name FROM orders GROUP BY 1
UNION ALL SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
""")
def kernel_anti_append(spark, d):
    """Customers with orders, then those without."""
    first = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").cast("string").alias("name"))
    return joins.append_unseen(first, _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), "k")


@_query("""
WITH e AS (SELECT user_id, ts, event_id FROM events), r AS (SELECT user_id, ts AS begins, max(event_id) AS run FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT e.user_id, e.event_id, coalesce(r.run, -1) AS run FROM e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts >= r.begins
""")
def kernel_asof_run(spark, d):
    """Each event with the last purchase of its user up to then."""
    events = _t(spark, d, "events")
    runs = events.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("begins")).agg(F.max("event_id").alias("run"))
    return joins.covering_run(events.select("user_id", "ts", "event_id"), runs, "user_id", "ts", "begins", ["run"]).select("user_id", "event_id", F.coalesce("run", F.lit(-1)).alias("run"))


@_query("""
SELECT a.p_brand, a.p_type, a.p_partkey AS p_partkey_small, b.p_partkey AS p_partkey_large FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND b.p_size = 2 * a.p_size
""")
def kernel_theta_pair(spark, d):
    """Parts of a brand and type of which one is twice the other's size."""
    return joins.ratio_pairs(_t(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size"), ["p_brand", "p_type"], "p_size", 2, "p_partkey")


@_query("""
WITH l AS (SELECT l_orderkey AS k, count(*) AS n_lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), o AS (SELECT o_orderkey AS k, o_orderstatus FROM orders WHERE o_orderstatus <> 'F')
SELECT k, o_orderstatus, coalesce(n_lines, 0) AS n_lines, CASE WHEN n_lines IS NULL THEN 'completed' WHEN o_orderstatus IS NULL THEN 'unknown' ELSE 'active' END AS status FROM o FULL JOIN l USING (k)
""")
def kernel_full_outer_reconcile(spark, d):
    """Orders that aren't finished against those with returned line items."""
    known = _t(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    found = _t(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n_lines"))
    return joins.reconcile(known, found, "k", "o_orderstatus", "n_lines", F.when(F.col("n_lines").isNull(), "completed").when(F.col("o_orderstatus").isNull(), "unknown").otherwise("active")).withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))


@_query("""
WITH RECURSIVE e AS (SELECT o_orderkey AS node, o_orderkey // 2 AS up FROM orders WHERE o_orderkey > 1 AND o_orderstatus <> 'P'),
tops AS (SELECT DISTINCT up AS node FROM e WHERE up NOT IN (SELECT node FROM e)),
r AS (SELECT node, node AS root FROM tops UNION ALL SELECT e.node, r.root FROM e JOIN r ON e.up = r.node)
SELECT node, root FROM r
""")
def kernel_recursive_root(spark, d):
    """Where chains of merged orders end (halving keys)."""
    edges = _t(spark, d, "orders").where("o_orderkey > 1 AND o_orderstatus <> 'P'").select("o_orderkey", F.expr("o_orderkey div 2").alias("up"))
    return joins.roots(edges, "o_orderkey", "up")


@_query("""
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_shipdate) AS r FROM lineitem) WHERE r = 1
""")
def kernel_dedup_first(spark, d):
    """The first line item of each part and supplier."""
    return tracks.keep_first(_t(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber", "l_shipdate"]).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


@_query("""
SELECT l_orderkey, l_partkey, l_linenumber, coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins FROM lineitem
""")
def kernel_running_offset(spark, d):
    """Where line items begin if they lie end to end by quantity."""
    rows = _t(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    return tracks.running_offset(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "q").select("l_orderkey", "l_partkey", "l_linenumber", "begins")


@_query("""
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN 'merging' ELSE 'waiting' END AS status FROM events
""")
def kernel_fifo_schedule(spark, d):
    """A queue per user: the head is at work, others wait."""
    rows = tracks.compact_ids(_t(spark, d, "events"), "user_id", ["ts", "event_id"], "place")
    return rows.select("user_id", "event_id", "place", F.when(F.col("place") == 0, "merging").otherwise("waiting").alias("status"))


def _units_sql(n: str, suffix: str, base: int, labels: str) -> str:
    """SQL of a size in two decimals: half-up hundredths of the largest unit that it exceeds, trimmed."""
    out = f"CAST({n} AS VARCHAR) || '{suffix}'"
    for k, label in enumerate(labels.split(), 1):
        h = f"(CAST({n} AS HUGEINT) * 200 + {base**k}) // {2 * base**k}"
        out = f"CASE WHEN {n} > {base**k} THEN rtrim(rtrim(CAST({h} // 100 AS VARCHAR) || '.' || lpad(CAST({h} % 100 AS VARCHAR), 2, '0'), '0'), '.') || '{label}{suffix}' ELSE {out} END"
    return f"CASE WHEN {n} >= 0 THEN {out} ELSE '' END"


@_query(f"""
SELECT doc_id, {_units_sql('n', 'B', 1024, 'K M G T')} AS size, {_units_sql('n', 'bps', 1000, 'Ki Mi Gi')} AS rate FROM (SELECT doc_id, n_chars * n_chars * n_chars AS n FROM documents)
""")
def kernel_size_format(spark, d):
    """Sizes and bit rates in the largest unit that they exceed."""
    n = F.col("n_chars") * F.col("n_chars") * F.col("n_chars")
    return _t(spark, d, "documents").select("doc_id", text.in_units(n, "B").alias("size"), text.in_units(n, "bps", "KMiGi").alias("rate"))


@_query("""
SELECT event_id, printf('%02d:%02d:%02d', (event_id * 1000 // 1000) // 3600, ((event_id * 1000 // 1000) // 60) % 60, (event_id * 1000 // 1000) % 60) AS clock,
printf('%02d:%02d:%02d.%09d', (event_id * 1234567 // 1000000000) // 3600, ((event_id * 1234567 // 1000000000) // 60) % 60, (event_id * 1234567 // 1000000000) % 60, event_id * 1234567 % 1000000000) AS clock_ns FROM events
""")
def kernel_duration_format(spark, d):
    """Event numbers as durations."""
    return _t(spark, d, "events").select("event_id", text.clock_ms(F.col("event_id") * 1000).alias("clock"), text.clock_ns(F.col("event_id") * 1234567).alias("clock_ns"))


@_query(r"""
SELECT page_id, regexp_extract(url, '^(.*)[/\\]', 1) AS dir, regexp_extract(url, '([^/\\]*)$', 1) AS name FROM pages
""")
def kernel_path_split(spark, d):
    """URLs as paths: folder and name."""
    return _t(spark, d, "pages").select("page_id", text.parent_dir(F.col("url")).alias("dir"), text.file_name(F.col("url")).alias("name"))


@_query(r"""
WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'c:\' || url WHEN 1 THEN '\\srv\share' || page_id % 7 || '\' || url WHEN 2 THEN '\\srv/share' || page_id % 7 || '/x' ELSE url END AS path FROM pages)
SELECT page_id, upper(CASE WHEN path[2] = ':' AND path[1] BETWEEN 'a' AND 'z' THEN path[:2] WHEN starts_with(path, '\\') THEN '\\srv' || path[6] || 'share' || page_id % 7 ELSE NULL END) AS drive FROM p WHERE path[2] = ':' OR starts_with(path, '\\')
UNION ALL SELECT page_id, 'default' FROM p WHERE path[2] <> ':' AND NOT starts_with(path, '\\')
""")
def kernel_drive_key(spark, d):
    """Drives of paths on a letter, a share (either slash before its name) or neither."""
    page = F.col("page_id")
    share = F.concat(F.lit("share"), (page % 7).cast("string"))
    path = F.when(page % 4 == 0, F.concat(F.lit("c:\\"), "url")).when(page % 4 == 1, F.concat(F.lit("\\\\srv\\"), share, F.lit("\\"), "url")).when(page % 4 == 2, F.concat(F.lit("\\\\srv/"), share, F.lit("/x"))).otherwise(F.col("url"))
    return _t(spark, d, "pages").select("page_id", text.drive_key(path).alias("drive"))


@_query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events")
def kernel_json_lookup(spark, d):
    """A number of a JSON text by a fixed schema, with a default."""
    return _t(spark, d, "events").select("event_id", F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(-1).cast("long")).alias("k"))


@_query("""
SELECT event_id, CASE WHEN event_id % 120 > 0 AND event_id % 120 < 100 THEN (user_id * 60.0::DOUBLE) * (100 - event_id % 120) / (event_id % 120) END AS eta FROM events
""")
def kernel_eta(spark, d):
    """Time left by progress."""
    return _t(spark, d, "events").select("event_id", text.eta(F.col("user_id") * F.lit(60.0), F.col("event_id") % 120).alias("eta"))


@_query("""
SELECT signature, count(*) AS n_units, min(user_id) AS first_unit, count(*) >= 2 AS grouped FROM (
SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type || ':' || n) AS signature FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id) GROUP BY signature
""")
def kernel_bucket_users(spark, d):
    """Users with equal counts of events by type."""
    return groups.buckets(groups.language_signature(_t(spark, d, "events"), "user_id", F.col("event_type")), "signature", "user_id")


from trackloom.plans import details, lists, media, rules  # noqa: E402,F401  add their queries
