"""Exact Jaccard self-join of documents' word shingles, as connected classes, by adaptive multi-match prefixes.

Shingles are 64-bit hashes. Their global order is by rarity: a first pass counts all shingles of all documents in a table of fixed size, whose
places that hold far more than the mean give classes of frequency; within a class the hash decides. A document of n shingles has a prefix of
n - ceil(t n) + l tokens, and two documents with similarity t or more share at least the smaller l of the two within their prefixes. Each
document chooses its own l: what its prefix would cost to post, plus what verifying the candidates would cost that are left when l tokens must
be shared, is least. Documents whose rare tokens already tell them apart keep short prefixes; those of large groups lengthen theirs.

Equal sets are one. Lists of documents that share the same prefix tokens are kept once with their multiplicity. A round of stars verifies
each set against pivots of its lists (linear in list length) and joins what matches into classes. What lists still hold of
different classes becomes pairs where a list is short. Long lists never become pairs: their sets are rebased on a pivot q,
as differences x ^ q, since (x ^ q) ^ (y ^ q) = x ^ y, and similar sets differ in at most a ninth of their sizes. Two of them that are
not both similar to q share a token of their differences, so prefixes of the differences make new, shorter lists, until none is long (the bound doubles with every round).
Candidates are verified by the intersection of whole shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, mix, parts_of, release, slices, small_batches, stage

#: Words of a shingle, and similarity in hundredths.
WIDTH, PERCENT = 5, 80
#: Places of the frequency table, as a power of two.
PLACES = 20
#: Cost model: candidates per posted token that is not known to be frequent, and the cost of verifying a candidate, per shingle, in postings.
STRAY, VERIFY = 0.2, 0.25
#: Members of a list that become pairs; longer lists are rebased. A round doubles it, up to ``MOST``.
SHORT, MOST = 16, 1024
#: Sets brought to one place of another.
MET = 2048
#: Prefix tokens that a task gathers.
GATHERED = 6_000_000
_FACTORS = np.random.default_rng(3).integers(1, 1 << 63, size=WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES = np.random.default_rng(4).integers(1, 1 << 63, size=256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse by 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    one = np.ones(1, dtype=np.uint64)
    return tuple(np.concatenate([one, np.cumprod(np.full(size, b, dtype=np.uint64))]) for b in (_BASE, inverse))


def hashes(text: str | None) -> np.ndarray:
    """Hashes of the text's shingles in their order: A-Z lowered, words parted by ASCII white space; fewer than five words are
    one shingle; none for null and for texts without a word. Linear in the text."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    b = np.frombuffer(raw, dtype=np.uint8)
    inside = (b > 32) | (b < 9) | ((b > 13) & (b < 32))
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(1 << max(16, len(b).bit_length()))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTES[b] * up[: len(b)])])
    words = mix((total[end] - total[start]) * down[start])
    k = min(WIDTH, len(words))
    h = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = h + words[i : len(words) - k + 1 + i] * _FACTORS[i]
    return mix(h)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    return np.unique(hashes(text))


def digest_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def needed(n: int) -> int:
    """Tokens that a set of n shares with every similar set."""
    return -(-PERCENT * n // 100)


def similar(inter, n, m):
    return 100 * inter >= PERCENT * (n + m - inter)


def frequency_classes(texts: DataFrame) -> np.ndarray:
    """For each place of the table (a hash's top bits): 0, or twice the logarithm of how far its count of shingles, over the whole column, lies above what chance
    would bring. Tasks count for themselves and stretches of the table are added up in parallel; the driver gets one table."""
    stretch = 1 << (PLACES - 6)

    def count(batches):
        total = np.zeros(1 << PLACES, dtype=np.int64)
        for piece in slices(batches, "text"):
            got = np.concatenate([hashes(t) for t in piece.column(0).to_pylist()])
            total += np.bincount((got >> np.uint64(64 - PLACES)).astype(np.int64), minlength=1 << PLACES)
        if total.any():
            for k in range(64):
                part = total[k * stretch : (k + 1) * stretch]
                kind = "<u1" if part.max() < 256 else "<u2" if part.max() < 65536 else "<u8"
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "counts": pa.array([part.astype(kind).tobytes()], pa.binary())})

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(raw, dtype=f"<u{len(raw) // stretch}").astype(np.int64)
        for k, total in held.items():
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    rows = texts.mapInArrow(count, "k int, counts binary").repartition("k").mapInArrow(add, "k int, counts binary").collect()  # 64 rows
    total = np.zeros(1 << PLACES, dtype=np.int64)
    for r in rows:
        total[r.k * stretch : (r.k + 1) * stretch] = np.frombuffer(r.counts, dtype=np.int64)
    mean = total.mean()
    above = np.maximum(total - mean - 4 * np.sqrt(mean), 1)
    return np.floor(2 * np.log2(above)).astype(np.uint8)


def class_of(tokens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return classes[(tokens >> np.uint64(64 - PLACES)).astype(np.int64)]


def matches_wanted(n: int, frequency: np.ndarray) -> int:
    """l of a document of n shingles whose estimated frequencies, in the global order, are given: the choice that costs least. Longer prefixes post
    more tokens and, with more matches needed, leave fewer of the documents on their lists to verify."""
    choice = np.unique(np.minimum(1 + n * np.arange(13) // 40, needed(n)))
    size = n - needed(n) + choice
    met = np.cumsum(frequency - 1 + STRAY)[size - 1]
    return int(choice[np.argmin(size + met + met / choice * VERIFY * n)])


def prefix(tokens: np.ndarray, classes: np.ndarray) -> tuple[int, np.ndarray]:
    """l and the prefix of a sorted set of tokens."""
    n = len(tokens)
    if not n:
        return 0, tokens
    c = class_of(tokens, classes)
    if c.any():
        order = np.argsort(c, kind="stable")
        tokens, c = tokens[order], c[order]
    wanted = matches_wanted(n, np.exp2(c / 2))
    return wanted, tokens[: n - needed(n) + wanted]


def measured(named: DataFrame, classes: Broadcast) -> DataFrame:
    """row, doc_id, n, l, digest (of the whole set), prefix, written once. Rows are numbered densely. Of equal sets in a task one posts its prefix."""

    def run(batches):
        posted: set[bytes] = set()
        for piece in slices(batches, "text"):
            out: dict[str, list] = {n: [] for n in ("n", "l", "digest", "prefix")}
            for text in piece.column(1).to_pylist():
                tokens = shingles(text)
                digest = digest_of(tokens)
                wanted, first = prefix(tokens, classes.value)
                for name, x in (("n", len(tokens)), ("l", wanted), ("digest", digest), ("prefix", b"" if digest in posted else first.tobytes())):
                    out[name].append(x)
                if len(posted) > 500_000:
                    posted.clear()
                posted.add(digest)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(out["n"], pa.int64()), pa.array(out["l"], pa.int64()), pa.array(out["digest"], pa.binary()), pa.array(out["prefix"], pa.binary())], ["doc_id", "n", "l", "digest", "prefix"])

    kind = dict(named.dtypes)["doc_id"]
    made = stage(named.mapInArrow(run, f"doc_id {kind}, n long, l long, digest binary, prefix binary").withColumn("row", F.monotonically_increasing_id()))
    counts = made.groupBy(F.shiftright("row", 33).alias("part")).count().orderBy("part").collect()  # a number for each partition
    ahead, at = [], 0
    for r in counts:
        ahead.append((r.part, at))
        at += r["count"]
    base = made.sparkSession.createDataFrame(ahead, "part long, ahead long")
    dense = made.join(F.broadcast(base), F.shiftright("row", 33) == F.col("part")).withColumn("row", F.col("row").bitwiseAND((1 << 33) - 1) + F.col("ahead"))
    return dense.drop("part", "ahead")


def dealt(rows: DataFrame, column: str, partitions: int) -> DataFrame:
    """tokens, rows: packed tokens and the rows that they are of, met in ``partitions`` parts of the token space."""

    def deal(batch: pa.RecordBatch) -> dict | None:
        blobs, number = batch.column(1).to_pylist(), np.asarray(batch.column(0))
        tokens = np.frombuffer(b"".join(blobs), dtype=np.uint64)
        if not len(tokens):
            return None
        row = np.repeat(number, [len(x) // 8 for x in blobs])
        part = (mix(tokens) % np.uint64(partitions)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.flatnonzero(np.diff(part[order], prepend=-1))
        pieces = list(zip(cut, np.append(cut[1:], len(order)), strict=True))
        kind = "<u4" if number.max() < 1 << 32 else "<u8"
        return {"part": part[order[cut]], "tokens": [tokens[order[a:z]].tobytes() for a, z in pieces], "rows": [row[order[a:z]].astype(kind).tobytes() for a, z in pieces]}

    out = arrow_map(rows.select("row", column), deal, "part int, tokens binary, rows binary", column, 8192, 16_000_000)
    return out.repartition(partitions, "part").select("tokens", "rows")


def shared_lists(rows: DataFrame, partitions: int) -> DataFrame:
    """list, times, row: the rows that share prefix tokens; lists of equal members are one, with the number of their tokens."""

    def gather(batches):
        tokens, rows = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
        for batch in batches:
            for t, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens.append(np.frombuffer(t, dtype=np.uint64))
                rows.append(np.frombuffer(r, dtype="<u4" if len(r) * 2 == len(t) else "<u8").astype(np.int64))
        t, r = np.concatenate(tokens), np.concatenate(rows)
        tokens = rows = None
        order = np.lexsort((r, t))
        t, r = t[order], r[order]
        begin = np.flatnonzero(np.concatenate([t[:1] == t[:1], t[1:] != t[:-1]]))
        size = np.diff(np.append(begin, len(t)))
        t = order = None
        if not len(begin):
            return
        # members' names are summed twice over: equal sums are equal lists
        name = np.stack([np.add.reduceat(mix(r.astype(np.uint64) + np.uint64(s)), begin) for s in (1, 1 << 40)], axis=1)
        begin, size, name = begin[size > 1], size[size > 1], name[size > 1]
        if not len(begin):
            return
        name, first, times = np.unique(name, axis=0, return_index=True, return_counts=True)
        begin, size = begin[first], size[first]
        cut = np.flatnonzero(np.diff(np.cumsum(size) // 50_000, prepend=-1))
        for a, z in zip(cut, np.append(cut[1:], len(size)), strict=True):
            own = size[a:z]
            member = np.concatenate([r[b : b + s] for b, s in zip(begin[a:z], own, strict=True)])
            which = np.repeat(np.arange(a, z), own)
            for k in range(0, len(member), 50_000):  # a list may be longer than a batch
                w = which[k : k + 50_000]
                names = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(w), [None, pa.py_buffer(np.ascontiguousarray(name[w]))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([names, pa.array(times[w], pa.int64()), pa.array(member[k : k + 50_000], pa.int64())], ["list", "times", "row"])

    return dealt(rows.where("length(prefix) > 0"), "prefix", partitions).mapInArrow(gather, "list binary, times long, row long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that links reach), for nodes with an edge (a, b), by alternating large and small stars."""
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, stage(small)
        release(before)
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == mark:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        mark = sums


def _sieve(keys: DataFrame, column: str, bits: int = 24) -> np.ndarray:
    """A bitmap of 2**bits places that holds every key: fixed in size, and only a first sieve."""
    places = keys.select(F.pmod(F.xxhash64(column), F.lit(1 << bits)).alias("p"))
    words = places.select(F.shiftright("p", 5).alias("w"), F.expr("shiftleft(1L, int(p & 31))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(1 << (bits - 5), dtype=np.uint32)
    for batch in words.toArrow().to_batches():
        out[np.asarray(batch.column(0))] = np.asarray(batch.column(1)).astype(np.uint32)
    return out


def texts_of(sids: DataFrame, sets: DataFrame, named: DataFrame) -> DataFrame:
    """digest, text: one text for each of the sets. All texts are read again: a bitmap sieves them, then a join on the digest picks the sets'."""
    wanted = stage(sids.distinct().join(sets, "sid").select(F.col("doc_id").alias("wanted_id"), "digest"))
    sieve = named.sparkSession.sparkContext.broadcast(_sieve(wanted, "wanted_id"))

    def run(batch: pa.RecordBatch) -> dict | None:
        place = np.asarray(batch.column(1))
        hit = np.flatnonzero((sieve.value[place >> 5] >> (place & 31).astype(np.uint32)) & 1 == 1)
        if not len(hit):
            return None
        texts = batch.column(0).take(pa.array(hit))
        return {"digest": [digest_of(shingles(t)) for t in texts.to_pylist()], "text": texts}

    placed = named.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)).alias("place"))
    found = arrow_map(placed, run, "digest binary, text string")
    # one row for each set, also where rows repeat; both sides grow with the corpus, so neither is broadcast
    return found.hint("merge").join(wanted.select("digest"), "digest").groupBy("digest").agg(F.first("text").alias("text"))


def brought(pairs: DataFrame, sets: DataFrame, texts: DataFrame, fn: Callable[[dict, np.ndarray, np.ndarray], None], schema: str) -> DataFrame:
    """The sets of pairs (a, b, and columns besides), each a brought to its b and compared there, by ``fn(row, tokens of a, tokens of b)``, which yields rows as dicts.
    A text travels once to each b. A b that many meet stands in several places, among which they are dealt."""
    extra = [c for c in pairs.columns if c not in ("a", "b")]
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / MET).cast("int").alias("places"))
    each = pairs.join(many, "b").select(F.col("a").alias("sid"), "b", F.pmod(F.xxhash64("a"), F.col("places")).cast("int").alias("place"), F.lit(1).alias("late"), *extra)
    own = many.select(F.col("b").alias("sid"), "b", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), F.lit(0).alias("late"), *(F.lit(None).cast(t).alias(c) for c, t in pairs.dtypes if c in extra))
    roles = each.unionByName(own).join(sets.select("sid", "digest"), "sid")
    met = roles.hint("merge").join(texts, "digest").drop("digest").repartition("b", "place").sortWithinPartitions("b", "place", "late")
    fields = [f.split(" ") for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    kinds = pa.schema([(n, kinds[k]) for n, k in fields])

    def run(batches):
        tokens = None
        for piece in slices(batches, "text", 256):
            out = []
            for row in piece.to_pylist():
                if row["late"]:
                    out += fn(row, shingles(row["text"]), tokens)
                else:
                    tokens = shingles(row["text"])
            for k in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_pylist(out[k : k + 20_000], kinds)

    return met.select("sid", "b", "late", "text", *extra).mapInArrow(run, schema)


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of sets those whose whole shingle sets are similar."""

    def check(row: dict, x: np.ndarray, y: np.ndarray):
        if similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
            yield {"a": row["sid"], "b": row["b"]}

    return brought(pairs.select("a", "b"), sets, texts, check, "a long, b long")


def _block(n: Column, shift: float = 0.0) -> Column:
    """Sizes of similar sets lie in one block or in neighbouring ones: a block is a shade wider than their ratio."""
    return F.floor(F.log(n) / F.log(F.lit(100 / PERCENT + 1e-4)) + F.lit(shift)).cast("int")


def star_pairs(lists: DataFrame) -> DataFrame:
    """a, b: a set and the pivot, of those of its lists, that it shares most tokens with. The pivot of a list is the member of most fame of those
    whose size is in a block with the set's, by either of two blockings."""
    blocks = F.explode(F.array(F.struct(F.lit(0).alias("k"), _block(F.col("n")).alias("b")), F.struct(F.lit(1).alias("k"), _block(F.col("n"), 0.5).alias("b"))))
    cut = lists.select("list", "times", "sid", "l", "fame", blocks.alias("at")).select("list", "times", "sid", "l", "fame", "at.k", "at.b")
    pivots = cut.groupBy("list", "k", "b").agg(F.max(F.struct("fame", -F.col("sid"))).alias("x")).select("list", "k", "b", (-F.col("x.col2")).alias("pivot"))
    star = cut.join(pivots, ["list", "k", "b"]).where("sid <> pivot").groupBy("sid", "l", "pivot", "k").agg(F.sum("times").alias("c"))
    best = star.where("2 * c >= l").groupBy("sid").agg(F.max(F.struct("c", -F.col("pivot"))).alias("x"))  # what is passed over here may still match later
    return best.select(F.col("sid").alias("a"), (-F.col("x.col2")).alias("b"))


def _blocked(entries: DataFrame) -> DataFrame:
    """Entries once in the block of their size (own) and once as guests of the next larger one: two similar sets, not both guests, meet in the block of the larger."""
    own = _block(F.col("n"))
    at = F.explode(F.array(F.struct(own.alias("k"), F.lit(True).alias("own")), F.struct((own + 1).alias("k"), F.lit(False).alias("own"))))
    return entries.withColumn("at", at).select(*entries.columns, "at.k", "at.own")


def _sharing(entries: DataFrame) -> DataFrame:
    """Entries of lists (in a block) that hold different classes, of sets that share enough tokens there: as many as they, or the least of
    those they meet, need."""
    open_ = entries.groupBy("list", "k").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("l").alias("least"), F.max("own").alias("owned")).where("low <> high AND owned").select("list", "k", "least")
    held = entries.join(open_, ["list", "k"])
    enough = held.groupBy("sid", "k").agg(F.sum("times").alias("shared"), F.min("least").alias("any"), F.first("l").alias("l")).where("shared >= least(l, any)").select("sid", "k")
    return held.drop("least").join(enough, ["sid", "k"], "left_semi")


def short_pairs(lists: DataFrame) -> DataFrame:
    """a, b, c, need: pairs of different classes and of sizes that allow similarity, of lists (list, k) of few members; how many of the lists' tokens hold both, and
    how many must. Not of two guests; of differences, a set whose difference is not the larger one meets another by the first part of its prefix."""
    held = lists.groupBy("list", "k").agg(F.max("times").alias("times"), F.collect_list(F.struct("sid", "n", "root", "l", "h", "own", "first", "e")).alias("s"))

    def cross(batch: pa.RecordBatch) -> dict | None:
        out = []
        for times, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sid, n, root, l, h, own, first, e = (np.array([x[k] for x in members]) for k in ("sid", "n", "root", "l", "h", "own", "first", "e"))
            i, j = np.triu_indices(len(sid), 1)
            fit = (root[i] != root[j]) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])) & (own[i] | own[j])
            fit &= (first[i] & (e[i] <= e[j])) | (first[j] & (e[j] <= e[i]))
            i, j = i[fit], j[fit]
            if len(i):
                a, b = np.where(sid[i] < sid[j], i, j), np.where(sid[i] < sid[j], j, i)
                out.append(np.stack([sid[a], sid[b], np.full(len(a), times), np.minimum(l[a], l[b]) - np.minimum(h[a], h[b])]))
        return dict(zip(("a", "b", "c", "need"), np.concatenate(out, axis=1), strict=True)) if out else None

    found = arrow_map(held.select("times", "s", F.lit("").alias("text")), cross, "a long, b long, c long, need long", "text", 1024)
    return found.groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("need").alias("need"))


def difference(x: np.ndarray, q: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The tokens in which x and q differ, those first that few sets near q differ in: of x's own the rare ones, then of q's the frequent ones."""
    e = np.setxor1d(x, q, assume_unique=True)
    c = class_of(e, classes).astype(np.int64)
    return e[np.lexsort((e, np.where(np.isin(e, q, assume_unique=True), 1000 - c, c)))]


def prefixes_of_difference(size: int, n: int, pivot: int, linked: bool) -> tuple[int, int]:
    """How many tokens of a difference of ``size``, of a set of n to a pivot's of ``pivot``, must be posted to meet every similar set (not both similar to the pivot) whose
    difference is as large or larger, and every one whose difference is as large or smaller. What similar sets' differences share follows from their
    sizes, and for a set that is similar to the pivot (``linked``) from the size that the other's must have, as it is not."""
    apart = (n + 100 * n // PERCENT) * (100 - PERCENT) // (100 + PERCENT)  # similar sets differ in no more tokens
    if linked:
        both = max(1, ((100 + PERCENT) * size + (100 - PERCENT) * (pivot - n)) // (2 * (100 + PERCENT)) + 1)
        return (max(0, size - both + 1),) * 2
    return min(size, apart // 2 + 1), min(size, apart + 1)


def rebased(long: DataFrame, sets: DataFrame, texts: DataFrame, classes: Broadcast) -> DataFrame:
    """sid, n, root, fame, list, first, e for the tokens of differences to pivots; rows of list -1 are links of sid to the pivot's class (root)."""
    top = long.groupBy("list", "k").agg(F.max(F.struct("fame", -F.col("sid"), "root")).alias("x")).select("list", "k", (-F.col("x.col2")).alias("b"), F.col("x.root").alias("b_root"))
    near = long.join(top, ["list", "k"]).where("sid <> b").groupBy(F.col("sid").alias("a"), "b").agg(*(F.first(c).alias(c) for c in ("root", "fame", "b_root")))

    def differ(row: dict, x: np.ndarray, q: np.ndarray):
        d = difference(x, q, classes.value)
        linked = similar((len(x) + len(q) - len(d)) // 2, len(x), len(q))
        first, every = prefixes_of_difference(len(d), len(x), len(q), linked)
        tokens = (mix(d[:every] ^ mix(np.array([row["b"]], dtype=np.uint64))) >> np.uint64(1)).tolist()
        own = {"sid": row["sid"], "n": len(x), "root": row["b_root"] if linked else row["root"], "fame": row["fame"], "e": len(d)}
        if linked:
            yield own | {"list": -1, "first": False}
        for i, t in enumerate(tokens):
            yield own | {"list": t, "first": i < first}

    return brought(near, sets, texts, differ, "sid long, n long, root long, fame double, list long, first boolean, e long")


def candidates(entries: DataFrame, sets: DataFrame, texts: DataFrame, classes: Broadcast, short: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) that are to be verified, and links (a, b) found on the way, from entries (list, k, times, sid, n, l, root, own, fame)."""
    pairs, links, used = [], [], []
    sizes = entries.groupBy("list", "k").agg(F.count("*").alias("m"))
    sized = stage(entries.join(sizes, ["list", "k"]).withColumns({"first": F.lit(True), "e": F.lit(0).cast("long")}))
    while True:
        used.append(sized)
        long = sized.where(F.col("m") > short)
        # a set's tokens on long lists, which are not counted; on lists of differences one token is enough
        unseen = long.groupBy("sid", "k").agg(F.sum("times").alias("h"))
        rest = sized.where(F.col("m") <= short).join(unseen, ["sid", "k"], "left").withColumn("h", F.coalesce("h", F.lit(0)))
        pairs.append(stage(short_pairs(rest).where("c >= need").select("a", "b")))
        if long.isEmpty():
            break
        short = max(short, min(2 * short, MOST))  # each round has fewer sets left: a list's pivot leaves it
        made = stage(rebased(long, sets, texts, classes))
        links.append(stage(made.where("list = -1").select(F.col("sid").alias("a"), F.col("root").alias("b"))))
        lists = made.where("list >= 0")
        # a list's pairs are those of its members by their first parts (m) with the others
        open_ = lists.groupBy("list").agg(F.count("*").alias("all"), F.sum(F.col("first").cast("long")).alias("m"), F.min("root").alias("low"), F.max("root").alias("high")).where("all > 1 AND low <> high AND m > 0").select("list", "m")
        sized = stage(
            lists.join(open_, "list")
            .select("list", F.lit(0).alias("k"), F.lit(1).cast("long").alias("times"), "sid", "n", F.lit(1).cast("long").alias("l"), "root", F.lit(True).alias("own"), "fame", "m", "first", "e")
        )
        release(made)
    found = stage(reduce(DataFrame.unionByName, pairs).distinct())
    for x in [*used, *pairs]:
        release(x)
    return found, (reduce(DataFrame.unionByName, links) if links else found.limit(0))


def _rooted(sids: DataFrame, roots: DataFrame) -> DataFrame:
    return sids.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: int = SHORT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Documents without a word (null or empty texts too) link with nothing. Rows that repeat an id are documents of their own; a null id is never
    the smallest. Other columns are not read. An empty table gives an empty result. ``short``: members of a list above which it is rebased; it
    doesn't change the result."""
    spark = docs.sparkSession
    small_batches(spark)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    classes = spark.sparkContext.broadcast(frequency_classes(named.select("text")))  # 2**PLACES bytes
    rows = measured(named, classes)
    tokens = rows.agg(F.sum(F.length("prefix"))).first()[0] or 0
    members = rows.select("row", "doc_id", "n", "l", "digest")
    first = members.where("n > 0").groupBy("digest").agg(F.min("row").alias("sid"))
    members = stage(members.join(first, "digest", "left"))  # sid is null for documents without a word
    sets = members.where("row = sid").select("sid", "doc_id", "digest")

    # lists of rows become lists of sets, of which those stay that share enough tokens with any others
    entries = shared_lists(rows, parts_of(spark, tokens / 8, GATHERED)).groupBy("list", "row").agg(F.sum("times").alias("times"))
    entries = stage(entries.join(members.where("n > 0").select("row", "sid", "n", "l"), "row").groupBy("list", "sid", "n", "l").agg(F.max("times").alias("times")))
    release(rows)
    sizes = entries.groupBy("list").agg(F.count("*").alias("m"), F.min("l").alias("least")).where("m > 1")
    met = entries.join(sizes, "list")
    enough = met.groupBy("sid").agg(F.sum("times").alias("shared"), F.min("least").alias("any"), F.first("l").alias("own_l"), (F.sum(F.col("times") * F.col("m")) / F.first("n")).alias("fame"))
    enough = enough.where("shared >= least(own_l, any)").select("sid", "fame")
    lists = stage(met.join(enough, "sid").select("list", "times", "sid", "n", "l", "fame"))
    release(entries)

    stars = stage(star_pairs(lists))
    starred = stars.select(F.col("a").alias("sid")).unionByName(stars.select(F.col("b").alias("sid")))
    roots = stage(components(verified(stars, sets, texts_of(starred, sets, named))))
    open_ = stage(_sharing(_sharing(_blocked(_rooted(lists, roots)))))
    release(lists)
    texts = stage(texts_of(open_.select("sid"), sets, named))
    pairs, links = candidates(open_, sets, texts, classes, short)
    edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links).unionByName(verified(pairs, sets, texts))
    final = stage(components(edges))
    for x in (texts, stars, roots, open_, pairs):
        release(x)
    placed = members.join(_rooted(sets.select("sid"), final), "sid", "left")
    class_id = placed.where("sid IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return placed.join(class_id, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
