"""URL filter: host rules first, then naive Bayes over words that a unigram Viterbi finds in host names.

Word counts come from all page texts, and every word counts: the distinct names of all hosts are cut into substrings of the lengths
that words have, and their hashes are joined with those of the words, so that each name meets the words it may hold, and only
those. Names are segmented once. Naive Bayes is multinomial over hashed tokens, so its table has ``2 * buckets`` counts at
any scale; it learns from every URL that a rule decides.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices, small_batches, stage

#: (verdict, host, path); the longest that fits wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: What an unknown run of letters costs, and each of its letters, in nats.
UNKNOWN, LETTER = 10.0, 2.5
#: Rows of one host that meet its words in one task; a host with more is dealt to several.
HOST_ROWS = 1 << 20
#: An odd number, so that its powers have inverses in 64 bits.
_BASE = 0x9E3779B97F4A7C15
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null or where there is no ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text, and its verdict; null where none fits."""
    text = verdict = F.lit(None).cast("string")
    for said, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        text, verdict = F.when(fits, name + start).otherwise(text), F.when(fits, said).otherwise(verdict)
    return text, verdict


def word_counts(texts: Column, table: DataFrame) -> DataFrame:
    """word, n over all texts: lower-case letter runs, without what stands in tags, scripts or styles."""
    plain = F.regexp_replace(F.lower(texts), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    words = table.select(F.explode(F.split(plain, r"[^\p{L}]+")).alias("word"))
    return words.where(F.length("word") > 1).groupBy("word").agg(F.count("*").alias("n"))


def substring_hashes(name: str, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """The different 64-bit hashes of a name's substrings, by length; the hash of a whole word is that of its substring of full length."""
    codes = np.frombuffer(name.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    powers, inverse = (np.cumprod(np.r_[np.uint64(1), np.full(len(codes), x, dtype=np.uint64)]) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    sums = np.r_[np.uint64(0), np.cumsum((codes + np.uint64(1)) * powers[:-1])]
    for n in lengths[: np.searchsorted(lengths, len(codes), "right")]:
        yield np.unique((sums[n:] - sums[:-n]) * inverse[: len(codes) - n + 1]).view(np.int64)


def known_words(names: DataFrame, counts: DataFrame) -> DataFrame:
    """id, name, words (array of word, n): what each name (id, name; all different) meets among the words (word, n). Equal hashes of different strings bring a word
    that the name doesn't hold, which its segmentation then never looks up. A substring that very many names share joins one word; adaptive execution splits it."""
    spark = names.sparkSession
    longest = names.agg(F.max(F.length("name"))).first()[0] or 0
    lengths = [r.n for r in counts.select(F.length("word").alias("n")).where(F.col("n") <= longest).distinct().orderBy("n").collect()]  # at most one for each letter of the longest name
    held = spark.sparkContext.broadcast(np.array(lengths, dtype=np.int64))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.repeat(ids, [len(h) for h in hashes]))], names=["h", "id"])

        hashes, ids, size = [], [], 0
        for piece in slices(batches, "name"):
            for i, name in zip(piece.column("id").to_pylist(), piece.column("name").to_pylist(), strict=True):
                for h in substring_hashes(name, held.value):
                    hashes.append(h)
                    ids.append(i)
                    size += len(h)
                    if size > 1 << 18:
                        yield batch()
                        hashes, ids, size = [], [], 0
        if hashes:
            yield batch()

    def hashed(batch: pa.RecordBatch) -> dict:
        out = batch.to_pydict()
        return out | {"h": [int(next(substring_hashes(w, np.array([len(w)])))[0]) for w in out["word"]]}

    small_batches(spark)
    words = arrow_map(counts.where(F.length("word") <= longest), hashed, "word string, n long, h long", "word", 4096)
    met = names.select("id", "name").mapInArrow(cut, "h long, id long").join(words, "h").groupBy("id").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    return names.join(met, "id", "left")


def segment(name: str, words: dict[str, float]) -> list[str]:
    """The likeliest split of a name into words, given their log probabilities. An unknown letter run costs ten nats and two and a half per letter, so known words
    win where they cover the name; ties go to the split whose last word is longest. A step looks at one substring for each length that words have."""
    best, back = [0.0], [0]
    lengths = sorted({len(w) for w in words})
    run, begin = 0.0, 0  # where an unknown run that ends here starts best, and its score but for what depends on the end
    for end in range(1, len(name) + 1):
        top, at = run - UNKNOWN - LETTER * end, begin
        for n in lengths:
            if n > end:
                break
            known = words.get(name[end - n : end])
            if known is not None and (best[end - n] + known, at) > (top, end - n):
                top, at = best[end - n] + known, end - n
        best.append(top)
        back.append(at)
        if top + LETTER * end > run:
            run, begin = top + LETTER * end, end
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def names_of(host: str) -> list[str]:
    """Letter runs of every label but the last, the top-level domain. Digits part names and are dropped."""
    return [run for label in [x for x in host.split(".") if x][:-1] for run in re.findall(r"[^\W\d_]+", label)]


def host_tokens(host: str, words: dict[str, float]) -> list[str]:
    """``h:`` words of a host's names."""
    return [f"h:{w}" for name in names_of(host) for w in segment(name, words)]


def path_tokens(path: str) -> list[str]:
    """``p:`` words of a path; a run of digits is ``p:0``."""
    return [f"p:{x}" if not x.isdigit() else "p:0" for x in re.findall(r"[^\W\d_]+|\d+", path.lower())]


def bucket(token: str, buckets: int) -> int:
    return zlib.crc32(token.encode()) % buckets


def host_buckets(hosts: DataFrame, counts: DataFrame, buckets: int) -> DataFrame:
    """host, h_tokens: the buckets of each host's words, for different hosts."""
    total = max(1, counts.agg(F.sum("n")).first()[0] or 0)
    named = arrow_map(hosts, lambda b: (o := b.to_pydict()) | {"names": [names_of(h) for h in o["host"]]}, "host string, names array<string>", "host")
    names = named.select("host", F.posexplode("names").alias("place", "name"))
    distinct = stage(names.select("name").distinct().withColumn("id", F.monotonically_increasing_id()))

    def split(batch: pa.RecordBatch) -> dict:
        out = batch.to_pydict()
        words = [{w["word"]: math.log(w["n"] / total) for w in found or ()} for found in out.pop("words")]
        return {"name": out["name"], "own": [[bucket(f"h:{w}", buckets) for w in segment(n, known)] for n, known in zip(out["name"], words, strict=True)]}

    own = arrow_map(known_words(distinct, counts).select("name", "words"), split, "name string, own array<int>", "name", 64)
    joined = names.join(own, "name").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "own"))).alias("x"))
    return hosts.join(joined, "host", "left").select("host", F.coalesce(F.flatten("x.own"), F.array().cast("array<int>")).alias("h_tokens"))


def with_tokens(urls: DataFrame, counts: DataFrame, buckets: int, host_rows: int = HOST_ROWS) -> DataFrame:
    """Adds ``tokens``, the buckets of a URL's host and path tokens. A host's tokens go to as many copies as its rows need tasks (one for each
    ``host_rows``); which hosts have several is broadcast, and those are no more than one for each ``host_rows`` rows."""
    hosts = stage(urls.groupBy("host").agg(F.ceil(F.count("*") / host_rows).cast("long").alias("copies")))
    hot = hosts.where("copies > 1")
    dealt = host_buckets(hosts.select("host"), counts, buckets).join(hosts, "host").select("host", "h_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("deal"))
    marked = urls.join(F.broadcast(hot), "host", "left").withColumn("deal", F.pmod(F.xxhash64("page_id", "path"), F.coalesce("copies", F.lit(1).cast("long")))).drop("copies")

    def run(batch: pa.RecordBatch) -> dict:
        out = batch.to_pydict()
        return out | {"tokens": [own + [bucket(t, buckets) for t in path_tokens(p)] for own, p in zip(out["h_tokens"], out["path"], strict=True)]}

    joined = marked.join(dealt, ["host", "deal"]).select(*urls.columns, "h_tokens")
    return arrow_map(joined, run, "page_id long, host string, path string, rule string, ruled string, tokens array<int>", "path", 8192)


def log_odds(labelled: DataFrame, buckets: int) -> np.ndarray:
    """log P(token|block) - log P(token|allow) by bucket, add-one smoothed; the last entry is the prior's."""
    rows = labelled.select("ruled", F.explode("tokens").alias("b")).groupBy("ruled", "b").count().collect()  # 2 * buckets rows at most
    docs = dict(labelled.groupBy("ruled").count().collect())
    table = np.ones((2, buckets))
    for said, b, n in rows:
        table[int(said == "block"), b] += n
    odds = np.log(table[1] / table[1].sum()) - np.log(table[0] / table[0].sum())
    return np.append(odds, math.log((docs.get("block", 0) + 1) / (docs.get("allow", 0) + 1)))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", rules=RULES, buckets: int = 1 << 16) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (log odds of block; the rule's verdict overrides it).

    Null urls, and urls without ``://``, have an empty host and path and are judged by the prior alone. Repeated rows and null ids are rows of their own; other columns are
    not read. An empty table gives an empty result; without any labelled url every score is 0 and the verdict allow."""
    host, path = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    text, said = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumn("rule", text).withColumn("ruled", said)
    tokens = stage(with_tokens(ruled, stage(word_counts(F.col(text_col), pages)), buckets))
    odds = pages.sparkSession.sparkContext.broadcast(log_odds(tokens.where("ruled IS NOT NULL"), buckets))

    def score(batch: pa.RecordBatch) -> dict:
        out = batch.to_pydict()
        return out | {"score": [float(odds.value[-1] + odds.value[np.array(t, dtype=np.int64)].sum()) for t in out["tokens"]]}

    scored = arrow_map(tokens, score, "page_id long, host string, path string, rule string, ruled string, score double", "path", 8192)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), F.round("score", 6).alias("score"))
