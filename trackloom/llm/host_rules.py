"""Host-level quality rules, in DataFrame functions only.

Each document is measured over its whole text, rule failures are summed by host, each host's failure
rate is shrunk with a beta prior fitted to all hosts by the method of moments, and the host's verdict
is joined back to its documents. A bad host loses all of them; a host that stands out from the prior loses
those that fail one of the softer rules, which elsewhere are given the benefit of the doubt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: ASCII white space, and the characters that count as symbols.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the lambda names it."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    blanks = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), SPACE[1:], text)
    return F.array_remove(F.split(blanks, " "), "")


def _windows(words: Column, make) -> Column:
    starts = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: make(i, [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]))


def repeated_window_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more. Most texts have no such window, which distinct hashes
    prove. In the others, windows are sorted with their positions, so that equal ones are neighbours, and covered words
    are summed from the gaps between the repeated ones' starts."""
    hashes = _windows(words, lambda i, w: F.xxhash64(*w))
    # words hold no white space, so a blank between them keeps windows apart
    ranked = F.sort_array(_windows(words, lambda i, w: F.struct(F.concat_ws(" ", *w).alias("w"), i.alias("i"))))
    twice = _let(ranked, lambda s: F.filter(s, lambda x, k: F.coalesce(x["w"] == F.get(s, k - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(s, k + 1)["w"], F.lit(False))))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = _let(starts, lambda at: F.aggregate(F.transform(at, lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - F.get(at, k - 1)))), F.lit(0), lambda a, x: a + x))
    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered)).cast("long")


def _measure(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    bare = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SYMBOLS, F.col("text"))  # one byte each
    # each array is built in one projection and only read by the next
    second = first.select(
        "doc_id", "host", words_of(F.col("text")).alias("words"), lines.alias("lines"),
        (F.octet_length("text") - F.octet_length(bare)).cast("long").alias("n_symbols"),
    )
    return second.select(
        "doc_id", "host", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").cast("long").alias("n_lines"),
        repeated_window_words(F.col("words")).alias("n_repeat_words"),
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words,
    base_failed, failed (base rule, or one of the softer ones). Null text counts as empty."""
    m = _measure(docs, id_col, text_col, host_col)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    soft = (10 * F.col("n_symbols") > F.col("word_chars")) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")) | (F.col("word_chars") > 20 * F.col("n_words"))
    return m.withColumn("base_failed", base).withColumn("failed", base | soft)


def host_verdicts(measured: DataFrame, most: float = 0.5) -> DataFrame:
    """host, n_docs, n_failed, host_rate, host_ok, host_strict. The prior's mean m and weight w come from the hosts' rates
    (w = m(1-m)/var - 1, at least 1, and 1 where the rates don't vary); host_rate = (n_failed + m w)/(n_docs + w).
    A host is ok if that is at most ``most``, and strict if it lies more than the prior's standard deviation, the root of m(1-m)/(w+1), above m.
    Documents without a host form one host of their own."""
    hosts = measured.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).select(
        "m", F.when(F.col("v") > 0, F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1)).otherwise(1.0).alias("w")
    )
    shrunk = hosts.join(F.broadcast(prior))  # one row
    bound = F.round(F.col("m") + F.sqrt(F.col("m") * (1 - F.col("m")) / (F.col("w") + 1)), 9)
    rated = shrunk.select("host", "n_docs", "n_failed", F.round((F.col("n_failed") + F.col("m") * F.col("w")) / (F.col("n_docs") + F.col("w")), 9).alias("host_rate"), bound.alias("bound"))
    return rated.withColumn("host_ok", F.col("host_rate") <= most).withColumn("host_strict", F.col("host_rate") > F.col("bound")).drop("bound")


def apply_host_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most: float = 0.5) -> DataFrame:
    """Measured documents with host_rate, host_ok, host_strict and kept. A document is kept if it passes the base rule, its host's
    shrunk failure rate is at most ``most``, and it passes the softer rules too or its host isn't strict. Every input row gives one row, repeated ids too; an empty table gives none."""
    measured = stage(measure(docs, id_col, text_col, host_col))
    hosts = host_verdicts(measured, most)
    out = measured.join(hosts.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")), "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("host_ok") & ~(F.col("failed") & F.col("host_strict"))).drop("of", "failed", "n_lines")
