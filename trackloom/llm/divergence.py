"""Audit of how the sources of a language differ in their words, by exact sparse counts.

A count vectoriser per language keeps the terms of at least ``min_df`` documents, all of them (its vocabulary size is the largest integer). One fit serves all
languages, as each term carries its language, so every language has a vocabulary of its own. It isn't fitted to the documents themselves but to
what they come to: of a chunk of terms, those in one or more documents, in two or more, ... make ``min_df`` documents, and a
term is in ``min_df`` of these just when it is in as many documents. A vocabulary is held by the driver, so chunks, whose kept terms are
counted before, are dealt to as many vectorisers as keep each vocabulary within a bound.

Documents become sparse vectors, a slice of them at a time, and vectors are summed by language and source within slices. The sums go by digest of the term to
tasks that add up those of all slices, and meet the vocabularies as a table. Pairs of sources are evaluated on what is not zero: terms that both have are met by a join, terms that one has count by how often
each share occurs, and the terms that neither has are one product.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_of, slices, small_batches, stage

#: Documents that a kept term is in, at least; the largest integer; shares are in parts of this many; ranks of terms that are told.
MIN_DF, ALL, UNIT, RANKS = 3, 2**31 - 1, 1_000_000_000, 200
#: Terms that a vocabulary holds at most.
MOST_TERMS = 1 << 18
#: Bytes of texts, and texts, that become vectors at once; a longer text stands alone.
HELD, TEXTS = 16_000_000, 1 << 16
#: Sources of a row that is handed on; terms of a chunk; rows that a task hands on at once.
ROW, CHUNK, AT_ONCE = 20_000, 4096, 20_000
#: Bytes that no term has are blanks, and only A-Z fold. Only ASCII characters end a term, so bytes of UTF-8 can stand for characters.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def vectors(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse vectors of texts: terms, and (text, term, count) as three arrays of numbers, in order of texts."""
    raw = [t.encode("utf-8", "surrogatepass").translate(_FOLD) + b" " for t in texts]
    begin = np.cumsum([0] + [len(x) for x in raw])[:-1]
    flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
    del raw  # millions of numbers follow, so what is done with goes
    blank = flat == 32
    after = np.concatenate([[True], blank[:-1]])
    first = np.flatnonzero(~blank & after)
    data = flat[~(blank & after)]  # each term and one blank
    del flat, blank, after
    offsets = np.concatenate([[0], np.flatnonzero(data == 32) + 1]).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    key = np.searchsorted(begin, first, "right") - 1
    del offsets, data, first
    key <<= 32
    key |= np.asarray(coded.indices)
    key.sort()
    cut = np.flatnonzero(np.diff(key, prepend=-1))
    return pc.utf8_rtrim(coded.dictionary.cast(pa.large_string()), " ").cast(pa.string()), key[cut] >> 32, key[cut] & 0xFFFFFFFF, np.diff(cut, append=len(key))


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """(high, low, sums) of the values by the two halves of a key, in order; last, how many there are of each."""
    order = np.argsort(key)
    key = key[order]
    cut = np.flatnonzero(np.diff(key, prepend=-1))
    return key[cut] >> 32, key[cut] & 0xFFFFFFFF, *(np.add.reduceat(x[order], cut) if len(cut) else x for x in values), np.diff(cut, append=len(key))


def _named(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])


def slice_sums(named: DataFrame, places: int) -> DataFrame:
    """The sums of the vectors of each slice of a task's documents, a row for each place that terms are dealt to by digest: terms, (lang, source) groups, and (group, term, count, docs) of what is not
    zero, where ``docs`` is in how many documents of the slice's group the term is."""
    names_of, numbers = pa.list_(pa.string()), pa.list_(pa.int32())
    schema = pa.schema([("place", pa.int32()), ("terms", names_of), ("langs", names_of), ("sources", names_of), ("group", numbers), ("term", numbers), ("count", pa.list_(pa.int64())), ("docs", numbers)])

    def work(rows: list[tuple[str, str, str]]) -> Iterator[pa.RecordBatch]:
        names, doc, term, count = vectors([t for _, _, t in rows])
        groups = {g: k for k, g in enumerate(dict.fromkeys((lang, source) for lang, source, _ in rows))}
        where = np.fromiter(map(zlib.crc32, names.cast(pa.binary()).to_pylist()), np.int64, len(names)) % places
        order = np.argsort(where, kind="stable")
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        of = np.array([groups[lang, source] for lang, source, _ in rows], np.int64)
        cells = where[term]
        cells *= len(groups)
        cells += of[doc]
        cells <<= 32
        cells |= rank[term]
        del doc, term
        both, term, count, docs = _summed(cells, count)
        place = both // len(groups)
        new = np.diff(both, prepend=-1) != 0
        used = both[new]
        steps = np.arange(places + 1)
        of_names, of_cells, of_groups = np.searchsorted(where[order], steps), np.searchsorted(place, steps), np.searchsorted(used // len(groups), steps)
        group = np.cumsum(new) - 1 - of_groups[place]
        have = np.flatnonzero(np.diff(of_cells))

        def lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array(np.append(offsets[have], offsets[-1]), pa.int32()), values)

        langs, sources = (pa.array([g[k] for g in groups], pa.string()).take(pa.array(used % len(groups))) for k in (0, 1))
        cell = [lists(of_cells, pa.array(x, t)) for x, t in ((group, pa.int32()), (term - of_names[place], pa.int32()), (count, pa.int64()), (docs, pa.int32()))]
        if len(have):
            yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), lists(of_names, names.take(pa.array(order))), lists(of_groups, langs), lists(of_groups, sources), *cell], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for piece in slices(batches, "text", 4096):
            for x in zip(*(piece.column(k).to_pylist() for k in range(3)), strict=True):
                if rows and (size + len(x[2]) > HELD or len(rows) == TEXTS):
                    yield from work(rows)
                    rows, size = [], 0
                rows.append(x)
                size += len(x[2])
        if rows:
            yield from work(rows)
        pa.default_memory_pool().release_unused()

    return named.mapInArrow(run, "place int, terms array<string>, langs array<string>, sources array<string>, group array<int>, term array<int>, count array<long>, docs array<int>")


def task_sums(named: DataFrame, min_df: int) -> DataFrame:
    """The sums of all vectors: lang, term and its sources with counts, where those of very many sources take several rows; and, by chunk and level, ``tokens``: terms with their
    language that are in ``level`` documents or more, for each level up to ``min_df``. A term is in one chunk, so chunks' tokens stand for documents in which each term is as often as in
    the given ones, or ``min_df`` times if it is in more."""
    small_batches(named.sparkSession)
    places = parts_of(named.sparkSession, named.rdd.getNumPartitions(), 1)
    sources_of = pa.list_(pa.struct([("source", pa.string()), ("count", pa.int64())]))
    schema = pa.schema([("chunk", pa.int64()), ("level", pa.int32()), ("tokens", pa.list_(pa.string())), ("lang", pa.string()), ("term", pa.string()), ("sources", sources_of)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, cells, groups, place, held = [], [], {}, 0, 0
        for batch in batches:
            place = batch.column(0)[0].as_py() if batch.num_rows else place
            for k in range(batch.num_rows):
                names, langs, sources, group, term, count, docs = (batch.column(c)[k].values for c in range(1, 8))
                own = np.array([groups.setdefault(g, len(groups)) for g in zip(langs.to_pylist(), sources.to_pylist(), strict=True)], np.int64)
                cells.append((own[np.asarray(group)], np.asarray(term).astype(np.int64) + held, np.asarray(count), np.asarray(docs).astype(np.int64)))
                terms.append(names)
                held += len(names)
        if cells:
            yield from work(terms, [np.concatenate(x) for x in zip(*cells, strict=True)], groups, place)
        pa.default_memory_pool().release_unused()

    def work(terms: list[pa.Array], cells: list[np.ndarray], groups: dict[tuple[str, str], int], place: int) -> Iterator[pa.RecordBatch]:
        coded = pa.chunked_array(terms).combine_chunks().dictionary_encode()
        group, term, count, docs = cells
        term = np.asarray(coded.indices).astype(np.int64)[term]
        # groups by language, so that those of a term and language lie together
        named = sorted(groups)
        to = np.empty(len(named), np.int64)
        to[[groups[g] for g in named]] = np.arange(len(named))
        langs = {lang: k for k, lang in enumerate(dict.fromkeys(lang for lang, _ in named))}
        lang_of, lang_names = np.array([langs[lang] for lang, _ in named]), pa.array(list(langs))
        term, group, count, docs, _ = _summed(term << 32 | to[group], count, docs)
        lang = lang_of[group]
        # entries: a term of a language
        first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(lang, prepend=-1) != 0))
        often = np.add.reduceat(docs, first)
        tokens = pc.binary_join_element_wise(lang_names.take(pa.array(lang[first])), coded.dictionary.take(pa.array(term[first])), " ")
        for k, i in enumerate(range(0, len(first), CHUNK)):
            kept = [tokens.slice(i, CHUNK).filter(pa.array(often[i : i + CHUNK] >= level)) for level in range(1, min_df + 1)]
            ends = pa.array(np.cumsum([0] + [len(x) for x in kept]), pa.int32())
            yield rows(min_df, chunk=pa.array([place << 32 | k] * min_df, pa.int64()), level=pa.array(range(1, min_df + 1), pa.int32()), tokens=pa.ListArray.from_arrays(ends, pa.concat_arrays(kept)))
        begin = np.zeros(len(term), np.int64)
        begin[first] = first
        cut = np.flatnonzero((np.arange(len(term)) - np.maximum.accumulate(begin)) % ROW == 0)
        sources = pa.StructArray.from_arrays([pa.array([s for _, s in named]).take(pa.array(group)), pa.array(count, pa.int64())], fields=list(sources_of.value_type))
        lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(term)), pa.int32()), sources)
        lang, term = lang_names.take(pa.array(lang[cut])), coded.dictionary.take(pa.array(term[cut]))
        for i in range(0, len(cut), AT_ONCE):
            yield rows(min(AT_ONCE, len(cut) - i), lang=lang.slice(i, AT_ONCE), term=term.slice(i, AT_ONCE), sources=lists.slice(i, AT_ONCE))

    def rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    dealt = slice_sums(named, places).repartitionById(places, "place")
    return dealt.mapInArrow(run, "chunk long, level int, tokens array<string>, lang string, term string, sources array<struct<source: string, count: long>>")


def vocabulary(sums: DataFrame, min_df: int = MIN_DF, most: int = MOST_TERMS) -> DataFrame:
    """lang, term: the kept terms, from the documents that chunks' tokens stand for. The terms that a chunk keeps are counted first; where all are more than ``most``, each of several vectorisers is fitted to
    a range of chunks, so that no vocabulary is larger, unless a chunk alone is."""
    spark = sums.sparkSession
    standing = sums.where("level IS NOT NULL")
    sizes = standing.where(F.col("level") == min_df).groupBy("chunk").agg(F.sum(F.size("tokens")).alias("n")).where("n > 0").orderBy("chunk").collect()
    n = sum(r.n for r in sizes)
    even = n / max(1, -(-n // most))
    ranges, held = [], most
    for r in sizes:
        if held + r.n > most or held >= even:
            ranges.append([r.chunk, r.chunk])
            held = 0
        ranges[-1][1] = r.chunk
        held += r.n
    found = None
    for low, high in ranges:
        model = CountVectorizer(inputCol="tokens", outputCol="vector", minDF=float(min_df), vocabSize=ALL).fit(standing.where(F.col("chunk").between(low, high)).select("tokens"))
        # a term has no blank, so the last one parts it from its language
        pairs = [t.rpartition(" ")[::2] for t in model.vocabulary]
        part = stage(spark.createDataFrame(pa.table({"lang": pa.array([a for a, _ in pairs]), "term": pa.array([b for _, b in pairs])})))
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], "lang string, term string") if found is None else found


def cells(named: DataFrame, min_df: int = MIN_DF, most: int = MOST_TERMS) -> tuple[DataFrame, DataFrame]:
    """lang, source, term, count of what is not zero, and lang, v: the number of kept terms where there are some."""
    sums = stage(task_sums(named, min_df))
    kept = vocabulary(sums, min_df, most)
    found = sums.where("level IS NULL").select("lang", "term", "sources").join(kept, ["lang", "term"]).select("lang", "term", F.explode("sources").alias("x"))
    return stage(found.select("lang", "x.source", "term", "x.count")), kept.groupBy("lang").agg(F.count("*").alias("v"))


def share(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(UNIT (count + 1) / (total + v)); as decimals, since a product may pass 64 bits."""
    return F.lit(1).cast("long") + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), (total + v).cast("decimal(20,0)"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_df: int = MIN_DF, ranks: int = RANKS, most: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair`` has for each source of a language every other one, with the summed gaps between both; part ``term`` the ``ranks`` terms that
    the source has beyond its language's share. All arithmetic is on whole numbers.

    Null languages, sources and texts are empty strings; a text without terms adds a group and nothing else; repeated rows count as often as they are; ids are not read. Equal values stand by item. A
    language of one source has no pairs; an empty table gives none."""
    named = _named(docs, lang_col, source_col, text_col)
    found, sizes = cells(named, min_df, most)
    counts = found.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("own"))
    groups = named.select("lang", "source").distinct().join(sizes, "lang", "left").join(counts, ["lang", "source"], "left").na.fill(0, ["v", "n", "own"])
    # a language without kept terms has no shares
    groups = stage(groups.withColumn("base", F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.greatest("v", F.lit(1))))))
    own = stage(found.join(groups.select("lang", "source", "n", "v", "base"), ["lang", "source"]).select("lang", "source", "term", "count", share(F.col("count"), F.col("n"), F.col("v")).alias("p"), "base"))

    # pairs: what both have, met by term, once for both ways
    a, b = (own.select("lang", "term", *[F.col(c).alias(f"{c}_{x}") for c in ("source", "p", "base")]) for x in "ab")
    met = a.join(b, ["lang", "term"]).where("source_a < source_b")
    more = lambda x, y: gap(F.col(f"p_{x}"), F.col(f"p_{y}")) - gap(F.col(f"p_{x}"), F.col(f"base_{y}")) - gap(F.col(f"base_{x}"), F.col(f"p_{y}"))
    both = stage(met.groupBy("lang", "source_a", "source_b").agg(F.sum(more("a", "b")).alias("ab"), F.sum(more("b", "a")).alias("ba"), F.count("*").alias("shared")))
    both = both.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), F.col("ab").alias("value"), "shared").unionByName(both.select("lang", F.col("source_b").alias("source"), F.col("source_a").alias("item"), F.col("ba").alias("value"), "shared"))
    # what one has, against the other's base share
    often = stage(own.groupBy("lang", "source", "base", "p").agg(F.count("*").alias("times")))
    other = groups.where("v > 0").select("lang", F.col("source").alias("of"), F.col("base").alias("rest"))
    sided = often.join(other, "lang").where("source <> of").groupBy("lang", "source", "of").agg(F.sum(F.col("times") * gap(F.col("p"), F.col("rest"))).alias("mine"), F.sum(F.col("times") * gap(F.col("rest"), F.col("p"))).alias("its"))
    sided = stage(sided)
    x, y = (groups.select("lang", *[F.col(c).alias(f"{c}_{k}") for c in ("source", "own", "base")], *(["v"] if k == "x" else [])) for k in "xy")
    pairs = x.join(y, "lang").where("source_x <> source_y").select("lang", F.col("source_x").alias("source"), F.col("source_y").alias("item"), "v", "own_x", "own_y", "base_x", "base_y")
    pairs = pairs.join(both, ["lang", "source", "item"], "left").join(sided.select("lang", "source", F.col("of").alias("item"), "mine"), ["lang", "source", "item"], "left")
    pairs = pairs.join(sided.select("lang", F.col("of").alias("source"), F.col("source").alias("item"), "its"), ["lang", "source", "item"], "left").na.fill(0, ["value", "shared", "mine", "its"])
    neither = (F.col("v") - F.col("own_x") - F.col("own_y") + F.col("shared")) * F.coalesce(gap(F.col("base_x"), F.col("base_y")), F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + F.col("mine") + F.col("its") + neither).alias("value"))
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(place))

    # terms, against the language's share
    whole = own.groupBy("lang", "term").agg(F.sum("count").alias("all"))
    totals = groups.groupBy("lang").agg(F.sum("n").alias("n"), F.max("v").alias("v")).where("v > 0")
    whole = whole.join(totals, "lang").select("lang", "term", share(F.col("all"), F.col("n"), F.col("v")).alias("q"))
    told = own.join(whole, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    told = told.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= ranks)
    return pairs.unionByName(told)
