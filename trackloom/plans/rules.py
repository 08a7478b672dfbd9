"""Queries of folds, lookups, trees, lines and units: users stand for files and their events for blocks, parts and pages for what is looked up, orders for tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import text
from trackloom.operators import folds, lookups, queues, ranks
from trackloom.plans.registry import _query, _t
from trackloom.streaming import lines

_CATALOGUE = """SELECT p_type AS id, TRUE AS prefix, min(p_name) AS name FROM part GROUP BY ALL
UNION ALL SELECT p_type || '/' || p_brand, count(*) % 2 = 0, max(p_name) FROM part GROUP BY p_type, p_brand
UNION ALL SELECT p_type || '/' || p_brand || '/' || p_size, FALSE, min(p_name) FROM part WHERE p_size < 10 GROUP BY p_type, p_brand, p_size"""


@_query(f"""
WITH c AS ({_CATALOGUE}), codes AS (SELECT p_partkey, p_type || '/' || p_brand || '/' || p_size AS code FROM part),
m AS (SELECT p_partkey, code, c.id, c.name, row_number() OVER (PARTITION BY p_partkey ORDER BY c.id = code DESC, length(c.id) DESC) AS r FROM codes LEFT JOIN c ON c.id = code OR c.prefix AND starts_with(code, c.id))
SELECT p_partkey, code, id, name FROM m WHERE r = 1
""")
def kernel_prefix_catalogue(spark, d):
    """Parts by type, brand and size in a catalogue: by the very code, else by the longest prefix."""
    part = _t(spark, d, "part")
    brand, code = F.concat_ws("/", "p_type", "p_brand"), F.concat_ws("/", "p_type", "p_brand", F.col("p_size").cast("string"))
    whole = part.groupBy(F.col("p_type").alias("id")).agg(F.lit(True).alias("prefix"), F.min("p_name").alias("name"))
    some = part.groupBy(brand.alias("id")).agg((F.count("*") % 2 == 0).alias("prefix"), F.max("p_name").alias("name"))
    exact = part.where("p_size < 10").groupBy(code.alias("id")).agg(F.lit(False).alias("prefix"), F.min("p_name").alias("name"))
    return lookups.catalogued(part.select("p_partkey", code.alias("code")), "code", whole.unionByName(some).unionByName(exact)).select("p_partkey", "code", "id", "name")


@_query("""
SELECT a.p_brand, a.p_type, a.p_partkey AS p_partkey_first, b.p_partkey AS p_partkey_second FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey
AND CAST(b.p_retailprice * 100 AS BIGINT) * 100 BETWEEN CAST(a.p_retailprice * 100 AS BIGINT) * 104 AND CAST(a.p_retailprice * 100 AS BIGINT) * 105
""")
def kernel_band_pair(spark, d):
    """Parts of a brand and type of which one is 4 to 5 per cent dearer than the other."""
    part = _t(spark, d, "part").select("p_partkey", "p_brand", "p_type", F.rint(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    return lookups.band_pairs(part, ["p_brand", "p_type"], "cents", 104, 105, "p_partkey")


_FOLD = """WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(value * 100 AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, event_id, n, CASE WHEN t - 1500 < 0 THEN NULL ELSE t - 1500 END AS corrected, CAST(-1500 AS BIGINT) AS moved, CASE WHEN t - 1500 < 0 THEN CAST(0 AS BIGINT) ELSE t - 1500 END AS last FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.event_id, e.n,
    CASE WHEN moved < 0 AND last <> 0 AND t + moved < last THEN last WHEN t + moved < 0 THEN NULL ELSE t + moved END,
    CASE WHEN moved < 0 AND last <> 0 AND t + moved < last THEN last - t ELSE moved END,
    CASE WHEN moved < 0 AND last <> 0 AND t + moved < last THEN last WHEN t + moved < 0 THEN last ELSE t + moved END
    FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, event_id, corrected FROM f"""


@_query(_FOLD)
def kernel_delay_fold(spark, d):
    """Values of a user's events as times, moved by a delay that changes as rows come too early."""
    events = _t(spark, d, "events").select("user_id", "event_id", "ts", F.rint(F.col("value") * 100).cast("long").alias("t"))
    return folds.corrected_times(events, "user_id", ["ts", "event_id"], "t", -1500).select("user_id", "event_id", "corrected")


@_query("""
WITH e AS (SELECT user_id, event_type, event_id, epoch_us(ts) - event_id % 7 * 60000000 AS t, event_type IN ('view', 'click') AS video FROM events),
f AS (SELECT *, first_value(t) OVER (PARTITION BY user_id ORDER BY event_id) AS t0 FROM e),
g AS (SELECT *, bool_or(t - t0 >= 864000000000) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS far FROM f),
h AS (SELECT *, min(t) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS least_so_far FROM g WHERE NOT far),
i AS (SELECT *, count(*) FILTER (NOT video OR t - least_so_far >= 86400000000) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM h)
SELECT user_id, event_type, min(t) AS least FROM i WHERE coalesce(ended, 0) = 0 GROUP BY ALL
""")
def kernel_least_times(spark, d):
    """Least times of a user's events by type, near the first one: two types are looked at for a day beyond their least one, others end with their first."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) - F.col("event_id") % 7 * 60_000_000
    events = _t(spark, d, "events").select("user_id", "event_type", "event_id", t.alias("t"))
    return folds.least_times(events, "user_id", "event_type", "event_id", "t", F.col("event_type").isin("view", "click"), 864_000_000_000, 86_400_000_000)


@_query("""
WITH RECURSIVE n AS (SELECT o_orderkey AS node, o_orderkey // 2 AS up, o_custkey AS ord, o_orderstatus <> 'P' AS named FROM orders),
t AS (SELECT node, node AS root, [ord, node] AS path, 0 AS depth, named FROM n WHERE up = node OR up NOT IN (SELECT node FROM n) UNION ALL SELECT n.node, root, list_concat(path, [n.ord, n.node]), depth + 1, n.named FROM n JOIN t ON n.up = t.node WHERE n.up <> n.node)
SELECT node, root, CAST(depth AS INTEGER) AS depth, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS place FROM t WHERE named
""")
def kernel_tag_tree(spark, d):
    """Orders as nested tags, half an order's key being its parent: lists of each tree, parents before children; some have no name and only their children are shown."""
    key = F.col("o_orderkey")
    half = F.expr("o_orderkey div 2")
    nodes = _t(spark, d, "orders").select(key.alias("node"), F.when(half != key, half).alias("parent"), F.col("o_custkey").alias("ord"), (F.col("o_orderstatus") != "P").alias("named"))
    return ranks.preorder(nodes, "node", "parent", "ord", "named").select("node", "root", "depth", "place")


@_query(r"""
WITH l AS (SELECT page_id, string_split_regex(html, '[\r\n>]') AS x FROM pages), e AS (SELECT page_id, unnest(x) AS text, unnest(range(len(x))) AS line FROM l)
SELECT page_id, line, text FROM e WHERE text <> ''
""")
def kernel_output_lines(spark, d):
    """Pages as output in chunks of 37 bytes, put together to lines again (a tag's end is a line's end)."""
    raw = F.regexp_replace("html", ">", "\n").cast("binary")
    at = F.sequence(F.lit(0), F.greatest(F.octet_length("html") - 1, F.lit(0)), F.lit(37))
    cut = F.explode(F.transform(at, lambda i: F.struct(i.alias("at"), F.substring(F.col("raw"), i + 1, F.lit(37)).alias("data"))))
    chunks = _t(spark, d, "pages").select("page_id", raw.alias("raw"), "html").select("page_id", cut.alias("x")).select("page_id", "x.*")
    return lines.split_lines(chunks.repartition("page_id", "at"), "page_id", "at", "data")


#: Languages as an alias table has them: (place, code, label).
LANGUAGES = [(0, "eng", "English (en; eng)"), (1, "fre", "French (fr; fre)"), (2, "ger", "German (de; ger)"), (3, "mul", "Multiple"), (4, "es", "Wrong (fr; fre)")]
#: Languages as a table of codes has them: (code, bib, alpha2, name).
CODES = [("eng", None, "en", "English"), ("fra", "fre", "fr", "French"), ("deu", "ger", "de", "German"), ("net", None, None, "Networkish"), ("und", None, None, "Undetermined")]

_HINTS = r"""SELECT page_id, regexp_extract(url, '://[^/]+/([A-Za-z]+)/', 1) AS lang, regexp_extract(url, '://[^/]+/[A-Za-z]+/([0-9A-Za-z]+)', 1) AS leaf, regexp_extract(url, '://[^/?#]*[.]([a-z]+)', 1) AS tld FROM pages"""


def _hints(spark, d):
    part = lambda p: F.regexp_extract("url", p, 1)
    return _t(spark, d, "pages").select("page_id", part("://[^/]+/([A-Za-z]+)/").alias("lang"), part("://[^/]+/[A-Za-z]+/([0-9A-Za-z]+)").alias("leaf"), part("://[^/?#]*[.]([a-z]+)").alias("tld"))


@_query(f"""
WITH h AS ({_HINTS}), s AS (SELECT page_id, leaf, tld, lang, CASE lang WHEN 'en' THEN 'en' WHEN 'fr' THEN 'fr' WHEN 'de' THEN 'de' WHEN 'es' THEN 'fr' ELSE lang END AS short,
    CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fre' WHEN 'de' THEN 'ger' WHEN 'es' THEN 'es' ELSE lang END AS code FROM h)
SELECT page_id, tld AS kind, lang, array_to_string(CASE WHEN tld = 'com' AND code = 'eng' THEN ['Stereo', 'Commentary'] WHEN tld = 'com' AND code = 'fre' THEN ['VF'] WHEN tld = 'org' AND code = 'ger' THEN ['Ton', 'ton 2'] ELSE [] END, '|') AS options FROM s
""")
def kernel_name_presets(spark, d):
    """Preset names of pages by their domain's end and their language, whatever form it has."""
    names = lookups.aliases(spark.createDataFrame(LANGUAGES, "place int, code string, label string"))
    presets = spark.createDataFrame([("com", "eng", " Stereo\nCommentary\n\nSTEREO"), ("com", "fre", "VF"), ("org", "ger", "Ton\nton 2\nTON")], "kind string, code string, names string")
    rows = _hints(spark, d).select("page_id", F.col("tld").alias("kind"), "lang")
    return lookups.preset_names(rows, presets, names, "kind", "lang").withColumn("options", F.array_join("options", "|"))


@_query(f"""
WITH h AS ({_HINTS}), r AS (SELECT page_id, lang || '-' || leaf AS tag, tld AS hint, lang, leaf, regexp_full_match(lang || '-' || leaf, '[a-z]{{2,3}}-([0-9]{{3}}|[a-z]{{2,4}}|[a-z0-9]{{5,8}}|[0-9][a-z0-9]{{3}})') AS ok FROM h),
k AS (SELECT *, CASE WHEN ok THEN CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' ELSE 'und' END WHEN hint = 'net' THEN 'net' ELSE 'eng' END AS code FROM r)
SELECT page_id, code AS iso639_2, CASE code WHEN 'fra' THEN 'fre' WHEN 'deu' THEN 'ger' END AS iso639_2_bib, CASE code WHEN 'eng' THEN 'en' WHEN 'fra' THEN 'fr' WHEN 'deu' THEN 'de' END AS iso639_1,
    CASE WHEN ok THEN tag END AS ietf, CASE code WHEN 'eng' THEN 'English' WHEN 'fra' THEN 'French' WHEN 'deu' THEN 'German' WHEN 'net' THEN 'Networkish' END AS name FROM k
""")
def kernel_language_resolution(spark, d):
    """Languages of pages: by a tag of their paths if it is well-formed, else by their domain's end if that is a code, else English."""
    codes = spark.createDataFrame(CODES, "code string, bib string, alpha2 string, name string")
    rows = _hints(spark, d).select("page_id", F.concat_ws("-", "lang", "leaf").alias("tag"), F.col("tld").alias("hint"))
    return lookups.resolved_language(rows, "tag", "hint", codes, "eng").drop("tag", "hint")


@_query("""
WITH i AS (SELECT o_custkey AS unit, o_orderkey, o_orderkey::VARCHAR AS file, CASE WHEN o_orderstatus = 'P' THEN 'not loaded' WHEN o_totalprice < 2000 THEN 'no tracks' END AS bad FROM orders),
e AS (SELECT unit, arg_min(bad, o_orderkey) AS error FROM i WHERE bad IS NOT NULL GROUP BY unit)
SELECT i.unit, CASE WHEN any_value(error) IS NULL THEN string_agg(file, ' ' ORDER BY o_orderkey) END AS inputs, any_value(error) AS error FROM i LEFT JOIN e USING (unit) GROUP BY i.unit
""")
def kernel_merge_all(spark, d):
    """All customers' orders as units to merge: inputs of the good ones, and the first thing that is wrong with each other one."""
    rows = _t(spark, d, "orders").select(F.col("o_custkey").alias("unit"), "o_orderkey", "o_orderstatus", "o_totalprice")
    checks = {"not loaded": F.col("o_orderstatus") != "P", "no tracks": F.col("o_totalprice") >= 2000}
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), " ")
    return queues.apart(rows, "unit", "o_orderkey", checks, lambda good: good.groupBy("unit").agg(listed.alias("inputs")))


@_query("""
WITH v AS (SELECT event_id, value * 1000 AS n FROM events), q AS (SELECT event_id, n, CASE WHEN n > 1000000 THEN 1000000.0::DOUBLE WHEN n > 1000 THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS base FROM v),
p AS (SELECT *, n / base AS x, (CAST((n / base - floor(n / base)) * 4503599627370496 AS HUGEINT) * 200 + 4503599627370496) // 9007199254740992 AS h FROM q)
SELECT event_id, CASE WHEN base = 1 THEN CASE WHEN n = floor(n) THEN CAST(CAST(n AS BIGINT) AS VARCHAR) ELSE CAST(n AS VARCHAR) END
    ELSE rtrim(rtrim(CAST(CAST(floor(x) AS BIGINT) + h // 100 AS VARCHAR) || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0'), '0'), '.') END || CASE base WHEN 1 THEN '' WHEN 1000 THEN 'Ki' ELSE 'Mi' END || 'bps' AS rate FROM p
""")
def kernel_rate_format(spark, d):
    """Bit rates that are doubles in the largest unit that they exceed."""
    return _t(spark, d, "events").select("event_id", text.double_in_units(F.col("value") * 1000, "bps", "KMi").alias("rate"))
