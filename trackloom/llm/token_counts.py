"""Token counts, with huge documents encoded in overlapping chunks that are spliced where both sides provably agree.

The tokenizer cuts a text into words from left to right, looking only ahead, and encodes each word by itself. So once two scans of
the same text stand at the same word boundary, they agree from there on. A chunk's scan is the document's own scan up to a
margin before the chunk's end (what the splitting looks ahead, and an added token that the end may cut); the next chunk
starts anywhere, maybe within a word, and is right from the first of its boundaries that the chunk before has too. Neighbours are
spliced at the least boundary that both have and that lies before the margin. Where an overlap has none (one endless word), the
document's chunks are merged eight at a time, with overlaps eight times as wide, until all its seams are found or it is one chunk.

Chunks are rows, dealt to all tasks by document and number, and a seam is a row with the few numbers of both sides, so no task needs a
whole huge document unless no seam can be found in it.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, parts_of, stage
from .packing import _CONTROL, _OTHER, _SPLIT, REMEMBERED

#: Characters of a chunk and of its overlap with the next one; documents longer than a chunk are huge.
CHUNK, OVERLAP = 1 << 16, 1 << 9
#: Characters that the splitting may look at beyond a boundary.
AHEAD = 4
#: Chunks that become one where an overlap held no common boundary.
WIDER = 8
#: Characters of chunks that a partition of them has, about.
DEALT = 1 << 23


class Counter:
    """Numbers of tokens by a tokenizers file, as its ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            held = json.load(f)
        self.model = Tokenizer.from_file(file)
        self.model.no_truncation()
        self.model.no_padding()
        self.model.post_processor = None  # it only trims offsets, where words can be told apart at all (see below)
        split = held["pre_tokenizer"] or {}
        self.added = {t["id"]: t["content"] for t in held["added_tokens"]}
        #: Whether words are cut by the byte-level pattern, each encoded by itself: what the memory and the seams rest on.
        self.by_words = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and held["normalizer"] is None and not held["model"].get("dropout")
            and (held["post_processor"] or {}).get("type") in (None, "ByteLevel") and not any(t[k] for t in held["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
            # an added token that can overlap another or itself could be found elsewhere from within
            and not any(a.endswith(b[:k]) for a in self.added.values() for b in self.added.values() for k in range(1, len(b) + (a != b)))
        )
        if not self.by_words:
            self.model = Tokenizer.from_file(file)
            self.model.no_truncation()
            self.model.no_padding()
        self.margin = AHEAD + max(map(len, self.added.values()), default=0)
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Words met before come from a bounded memory; texts with characters on which the pattern's classes
        and Python's differ go to the library whole."""
        out = [0] * len(texts)
        whole = [i for i, t in enumerate(texts) if not self.by_words or (_CONTROL if t.isascii() else _OTHER).search(t) or any(a in t for a in self.added.values())]
        for i, x in zip(whole, self.model.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = len(x.ids)
        rest = sorted(set(range(len(texts))) - set(whole))
        words = {i: _SPLIT.findall(texts[i]) for i in rest}
        known = self.known
        new = list({w for found in words.values() for w in found if w not in known})
        known.update(zip(new, (len(x.ids) for x in self.model.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        for i, found in words.items():
            out[i] = sum(map(known.__getitem__, found))
        if len(known) > REMEMBERED:
            known.clear()
        else:
            for w in new:
                if len(w) > 48:
                    del known[w]
        return out

    def chunk(self, text: str, overlap: int, first: bool, last: bool) -> tuple[int, list[int], list[int], list[int], list[int]]:
        """Tokens of a chunk; its word boundaries in the overlap at its start, with the tokens before them; its stable word boundaries in
        the overlap at its end, with the tokens from them on. Places count from the chunk's start."""
        x = self.model.encode(text, add_special_tokens=False)
        n = len(x.ids)
        begin = np.array([a for a, _ in x.offsets] + [len(text)], dtype=np.int64)
        word = np.array([-1 if w is None else w for w in x.word_ids], dtype=np.int64)
        added = np.isin(np.array(x.ids, dtype=np.int64), list(self.added))
        edge = np.ones(n + 1, dtype=bool)
        if n > 1:
            edge[1:n] = (word[1:] != word[:-1]) | added[1:] | added[:-1]
        at = np.flatnonzero(edge)
        head = at[begin[at] < overlap] if not first else at[:0]
        tail = at[(begin[at] >= len(text) - overlap) & (begin[at] <= len(text) - self.margin)] if not last else at[:0]
        return n, begin[head].tolist(), head.tolist(), begin[tail].tolist(), (n - tail).tolist()


@lru_cache(maxsize=2)
def counter(file: str) -> Counter:
    return Counter(file)


def chop(docs: DataFrame, file: str, chunk: int, overlap: int) -> DataFrame:
    """Rows (row, doc_id, text) as row, doc_id, n_bytes, n_tokens where a document is not huge, and else its chunks: part, last, piece; the
    first one has the bytes."""
    step = chunk - overlap

    def run(batch: pa.RecordBatch) -> dict:
        count = counter(file)
        names = ("row", "doc_id", "n_bytes", "n_tokens", "part", "last", "piece")
        out: dict[str, list] = {n: [] for n in names}
        texts = [t or "" for t in batch.column(2).to_pylist()]
        huge = [count.by_words and len(t) > chunk for t in texts]
        tokens = iter(count.counts([t for t, big in zip(texts, huge, strict=True) if not big]))
        for row, doc, text, big in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, huge, strict=True):
            size = len(text.encode("utf-8", "surrogatepass"))
            places = range(0, max(len(text) - overlap, 1), step) if big else ()
            rows = [(row, doc, 0 if k else size, None, k, at + chunk >= len(text), text[at : at + chunk]) for k, at in enumerate(places)] or [(row, doc, size, next(tokens), None, None, None)]
            for name, column in zip(names, zip(*rows, strict=True), strict=True):
                out[name] += column
        return out

    return arrow_map(docs, run, "row long, doc_id long, n_bytes long, n_tokens long, part long, last boolean, piece string", limit=8_000_000)


def seams(pieces: DataFrame, file: str, overlap: int, step: int, parts: int) -> DataFrame:
    """row, n_tokens, failed: the tokens of documents in chunks (row, part, last, piece), or that some overlap had no common boundary."""

    def run(batch: pa.RecordBatch) -> dict:
        names = ("row", "seam", "n", "heads", "before", "tails", "after")
        out: dict[str, list] = {n: [] for n in names}
        for row, part, last, piece in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            n, heads, before, tails, after = counter(file).chunk(piece, overlap, part == 0, last)
            rows = [(row, part, n, None, None, [part * step + x for x in tails], after)] + ([(row, part - 1, 0, [part * step + x for x in heads], before, None, None)] if part else [])
            for name, column in zip(names, zip(*rows, strict=True), strict=True):
                out[name] += column
        return out

    dealt = pieces.select("row", "part", "last", "piece").repartition(parts, "row", "part")
    sides = arrow_map(dealt, run, "row long, seam long, n long, heads array<long>, before array<long>, tails array<long>, after array<long>", "piece", limit=8_000_000)
    two = sides.groupBy("row", "seam").agg(F.sum("n").alias("n"), *[F.first(c, ignorenulls=True).alias(c) for c in ("heads", "before", "tails", "after")])
    at = two.withColumn("at", F.array_min(F.array_intersect("tails", "heads")))
    beyond = F.element_at("after", F.array_position("tails", F.col("at")).cast("int")) + F.element_at("before", F.array_position("heads", F.col("at")).cast("int"))
    inner = F.col("heads").isNotNull()  # the last chunk has no seam after it
    each = at.select("row", (F.col("n") - F.when(inner, F.coalesce(beyond, F.lit(0))).otherwise(0)).alias("n"), (inner & F.col("at").isNull()).alias("failed"))
    return each.groupBy("row").agg(F.sum("n").alias("n_tokens"), F.max("failed").alias("failed"))


def wider(pieces: DataFrame, step: int, overlap: int) -> DataFrame:
    """Chunks of ``step`` characters and what they overlap by, merged ``WIDER`` at a time; ``overlap`` is the new one, of which the next chunk after them has all."""
    own = F.struct((F.col("part") - F.col("part") % WIDER).alias("of"), F.col("part"), F.col("last"), F.when(F.col("last"), F.col("piece")).otherwise(F.substring("piece", 1, step)).alias("piece"))
    ahead = F.struct((F.col("part") - WIDER).alias("of"), F.col("part"), F.lit(False).alias("last"), F.substring("piece", 1, overlap).alias("piece"))
    both = F.when((F.col("part") % WIDER == 0) & (F.col("part") > 0), F.array(own, ahead)).otherwise(F.array(own))
    rows = pieces.select("row", F.explode(both).alias("x")).select("row", "x.*")
    # nine pieces at most
    merged = rows.groupBy("row", "of").agg(F.array_sort(F.collect_list(F.struct("part", "piece"))).alias("all"), F.max("last").alias("last"))
    return merged.select("row", (F.col("of") / WIDER).cast("long").alias("part"), "last", F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("piece"))


def count_tokens(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    Null texts are empty and have no tokens; repeated rows and null ids count by themselves; an empty table gives none. Only documents of more than
    ``chunk`` characters are cut. A file whose tokenizer doesn't encode word by word has no provable seams: its documents are encoded whole."""
    if not 0 < 4 * overlap <= chunk:
        raise ValueError("a chunk must be four overlaps or more")
    spark = docs.sparkSession
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = stage(chop(named, file, chunk, overlap))  # what follows reads each text no more
    done = first.where("part IS NULL").select("doc_id", "n_bytes", "n_tokens")
    pieces, step = first.where("part IS NOT NULL").select("row", "part", "last", "piece"), chunk - overlap
    heads = first.where("part = 0").select("row", "doc_id", "n_bytes")
    found, size = None, chunk
    n = pieces.count()
    while n:
        counted = stage(seams(pieces, file, overlap, step, parts_of(spark, n * size, DEALT)))
        good = counted.where("NOT failed").select("row", "n_tokens")
        found = good if found is None else found.unionByName(good)
        bad = counted.where("failed").select("row")
        if bad.isEmpty():
            break
        pieces = stage(wider(pieces.join(bad, "row", "left_semi"), step, WIDER * overlap))
        step, overlap, size, n = WIDER * step, WIDER * overlap, WIDER * size, pieces.count()
    if found is not None:
        done = done.unionByName(heads.join(found, "row").select("doc_id", "n_bytes", "n_tokens"))
    return done.withColumn("over_limit", F.col("n_tokens") > limit)
