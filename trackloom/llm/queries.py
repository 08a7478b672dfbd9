"""Registered queries of the training-data operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, dedup, divergence, host_rules, jaccard, langid, manifest, packing, pieces, repeats, secret_scan, token_counts, urls

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by the base rules and by automata inferred from what those label."""
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


@_query
def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, and one of control strings, formatted into budgeted windows and read back."""
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.format_windows(turns))


@_query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by a conditional random field that learns from three quarters of them."""
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


@_query
def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded into pieces and decoded again."""
    return pieces.encode_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by shingle similarity of 0.8 or more."""
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host rules, then naive Bayes over segmented host and path words."""
    return urls.judge(_table(spark, sf_dir, "pages"))


@_query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies by streaming keyed state; the largest doc_id of equal texts stays."""
    out = dedup.exact_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLES["op5_jaccard_join"] = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM documents LEFT JOIN sizes USING (doc_id) JOIN least ON x = doc_id
"""


ORACLES["op7_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""


@_query
def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules per document, failure rates per host shrunk by a beta prior, verdicts joined back."""
    out = host_rules.apply_host_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate")


@_query
def op9_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in Hilbert order, cut into sequences of 1024 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents")).drop("ids")


_WORD = r"[^\x20\x09-\x0D]"
ORACLES["op8_host_rules"] = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, doc_id, source, text, regexp_extract_all(text, '{_WORD}+') AS w,
    [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '{_WORD}')] AS lines FROM docs),
starts AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM starts) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY rid),
m AS (SELECT words.rid, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(list_aggregate(w, 'string_agg', '')) AS BIGINT) AS wc,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
    FROM words LEFT JOIN covered USING (rid)),
b AS (SELECT *, coalesce(wc, 0) AS word_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 10 * n_symbols > word_chars OR 10 * n_dup_lines > 3 * n_lines OR word_chars > 20 * n_words AS failed FROM b),
hosts AS (SELECT source, count(*) AS n, sum(CASE WHEN failed THEN 1 ELSE 0 END) AS k FROM f GROUP BY source),
p AS (SELECT avg(k / n) AS m, var_pop(k / n) AS v FROM hosts),
q AS (SELECT m, CASE WHEN v > 0 THEN greatest(1.0, m * (1 - m) / v - 1) ELSE 1.0 END AS w FROM p),
rates AS (SELECT source, round((k + m * w) / (n + w), 9) AS host_rate, round(m + sqrt(m * (1 - m) / (w + 1)), 9) AS bound FROM hosts, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_rate <= 0.5 AND NOT (failed AND host_rate > bound) AS kept, host_rate
FROM f LEFT JOIN rates ON f.source IS NOT DISTINCT FROM rates.source
"""


@_query
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by 100-byte strings that start earlier, removed from all documents."""
    return repeats.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


ORACLES["op10_repeats"] = """
WITH docs AS (SELECT doc_id, upper(hex(encode(coalesce(text, '')))) AS h FROM documents),
strings AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 99)) AS i FROM docs)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM strings) WHERE r > 1),
ends AS (SELECT doc_id, i AS a, max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS z FROM later),
runs AS (SELECT doc_id, a, sum(CASE WHEN z IS NULL OR a > z THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a) AS run FROM ends),
spans AS (SELECT doc_id, run, min(a) AS a, max(a) + 100 AS z FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, z, lag(z, 1, CAST(0 AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
cut AS (SELECT g.doc_id, count(*) AS n_spans, sum(z - a) AS gone, max(z) AS tail, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS left_part FROM gaps g JOIN docs d ON g.doc_id = d.doc_id GROUP BY g.doc_id)
SELECT doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(coalesce(left_part || substr(h, 2 * tail + 1), h))) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)
"""


@_query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, huge ones by chunks spliced where they provably agree."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources against each other and against their language, by exact term shares."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


ORACLES["op12_source_divergence"] = r"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
kept AS (SELECT lang, t FROM (SELECT lang, unnest(list_distinct(w)) AS t FROM docs) GROUP BY ALL HAVING count(*) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
found AS (SELECT lang, source, t, count(*) AS c FROM (SELECT lang, source, unnest(w) AS t FROM docs) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
grid AS (SELECT g.lang, g.source, k.t, coalesce(f.c, 0) AS c, sum(coalesce(f.c, 0)) OVER (PARTITION BY g.lang, g.source) AS n, sum(coalesce(f.c, 0)) OVER (PARTITION BY g.lang, k.t) AS c_all
    FROM groups g JOIN kept k USING (lang) LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.t = k.t),
wide AS (SELECT lang, source, t, c, v, 1 + (CAST(1000000000 AS HUGEINT) * CAST(c + 1 AS HUGEINT)) // CAST(n + v AS HUGEINT) AS p, c_all, sum(c) OVER (PARTITION BY lang) AS n_all FROM grid JOIN v USING (lang)),
own AS (SELECT *, 1 + (CAST(1000000000 AS HUGEINT) * CAST(c_all + 1 AS HUGEINT)) // CAST(n_all + v AS HUGEINT) AS q FROM wide),
summed AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM own a JOIN own b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, t AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM own WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@_query
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents, and what an audit of tampered rows finds."""
    return manifest.manifest(_table(spark, sf_dir, "documents"))


def _field(column: str) -> str:
    return f"coalesce(octet_length(encode(CAST({column} AS VARCHAR))) || ':' || CAST({column} AS VARCHAR), '-')"


# a crc32 by bits; ids are short
_CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(k AS BIGINT) FOR k IN range(8)]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))"""
ORACLES["op13_manifest"] = f"""
WITH RECURSIVE docs AS (SELECT doc_id, lang, sha256({_field("doc_id")} || {_field("source")} || {_field("lang")} || {_field("n_chars")} || {_field("text")}) AS leaf,
    sha256({_field("doc_id")} || {_field("source")} || {_field("lang")} || {_field("(n_chars + 1)")} || {_field("text")}) AS other, xor({_CRC}, 4294967295) % 7 = 0 AS hit, n_chars IS NOT NULL AS n_chars_known FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS place FROM docs),
low AS (SELECT lang, 0 AS lvl, list(leaf ORDER BY place) AS nodes FROM placed GROUP BY lang
    UNION ALL SELECT lang, lvl + 1, [sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')) FOR i IN range((len(nodes) + 1) // 2)] FROM low WHERE len(nodes) > 1),
tops AS (SELECT lang, nodes[1] AS subroot, lvl AS depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS spot FROM low WHERE len(nodes) = 1),
high AS (SELECT 0 AS lvl, (SELECT list(subroot ORDER BY spot) FROM tops) AS nodes
    UNION ALL SELECT lvl + 1, [sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')) FOR i IN range((len(nodes) + 1) // 2)] FROM high WHERE len(nodes) > 1),
steps AS (SELECT p.doc_id, low.lvl, CAST(p.place >> low.lvl AS BIGINT) AS node, nodes FROM placed p JOIN low ON p.lang IS NOT DISTINCT FROM low.lang WHERE len(nodes) > 1
    UNION ALL SELECT p.doc_id, depth + high.lvl, CAST(spot >> high.lvl AS BIGINT), high.nodes FROM placed p JOIN tops t ON p.lang IS NOT DISTINCT FROM t.lang, high WHERE len(high.nodes) > 1),
sides AS (SELECT doc_id, lvl, CASE WHEN node % 2 = 1 THEN nodes[node] ELSE '' END AS l, CASE WHEN node % 2 = 0 THEN coalesce(nodes[node + 2], '') ELSE '' END AS r FROM steps),
paths AS (SELECT doc_id, list(l || ',' || r ORDER BY lvl) AS path, string_agg(l || r, '' ORDER BY lvl) AS proof FROM sides GROUP BY doc_id),
folded AS (SELECT p.doc_id, leaf, subroot, (SELECT nodes[1] FROM high WHERE len(nodes) = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend(CASE WHEN hit AND n_chars_known THEN other ELSE leaf END, coalesce(path, [])), lambda x, y: sha256(split_part(y, ',', 1) || x || split_part(y, ',', 2))) AS folded_root
    FROM placed p JOIN tops t ON p.lang IS NOT DISTINCT FROM t.lang LEFT JOIN paths USING (doc_id))
SELECT *, folded_root = root AS verified FROM folded
"""
