"""Long repeats across documents, by run-compressed Burrows-Wheeler transforms of the repetitive part of a corpus.

A string of ``length`` bytes has one anchor: of its ``GRAM``-byte grams the one of least hash, leftmost of equals. Equal strings
have equal anchors at equal places, so anchors that occur once are in no repeat. Around each anchor that occurs
more than once, the stretch of text of all strings that it anchors (a context) goes to the anchor's part of the hash space;
equal contexts travel and are kept once. A part builds the Burrows-Wheeler transform of its distinct contexts, keeps runs and samples at
run ends, and computes the longest match with the neighbouring suffix only where a run begins: within a run it is one
less than at the text position before. Streaming over positions gives all matching statistics; neighbouring suffixes that
match by ``length`` bytes or more are one string, of which all but the earliest occurrence are repeats.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, mix, parts_of, stage
from .packing import starts

#: Bytes of a gram, and of a repeat.
GRAM, LENGTH = 24, 100
#: Positions worked on at once.
CHUNK = 1 << 20
#: Bytes of contexts in an index, but for an anchor's own that are more.
INDEXED = 1 << 20
#: Bytes of texts for each part that anchors and contexts are dealt to.
PART = 1 << 25
#: Occurrences of an anchor above which its strings meet one by one (it is hot), not by the anchor.
HOT = 1 << 13
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, size=256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK + 2 * LENGTH
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    one = np.ones(1, dtype=np.uint64)
    return tuple(np.concatenate([one, np.cumprod(np.full(size, b, dtype=np.uint64))]) for b in (_BASE, inverse))


def _window_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of every w neighbours: running minima from both ends of blocks of w."""
    n = len(x)
    padded = np.concatenate([x, np.full(-n % w, np.iinfo(x.dtype).max, dtype=x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """position, hash, first and last string start of every anchor of a text, in order. A stretch of strings that is cut between chunks is two, with the
    same anchor. Linear in the text."""
    found = [[np.empty(0, dtype=t)] for t in (np.int64, np.uint64, np.int64, np.int64)]  # a short text has none, of the same kinds
    up, down = _powers()
    w = length - GRAM + 1
    b = np.frombuffer(raw, dtype=np.uint8)
    for at in range(0, len(raw) - length + 1, CHUNK):
        part = b[at : at + CHUNK + length - 1]
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTES[part] * up[: len(part)])])
        n = len(part) - GRAM + 1
        h = mix((total[GRAM:] - total[:-GRAM]) * down[:n])
        key = (h & ~np.uint64((1 << 21) - 1)) | np.arange(n, dtype=np.uint64)
        least = (_window_least(key, w) & np.uint64((1 << 21) - 1)).astype(np.int64)
        cut = np.flatnonzero(np.diff(least, prepend=-1))
        place = least[cut]
        for out, x in zip(found, (place + at, h[place], cut + at, np.append(cut[1:], len(least)) - 1 + at), strict=True):
            out.append(x)
    return tuple(np.concatenate(x) for x in found)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers in four bytes each where they fit, else in eight."""
    return x.astype("<u4" if not len(x) or 0 <= x.min() and x.max() < 1 << 32 else "<i8").tobytes()


def _unpack(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u4" if len(raw) == 4 * n else "<i8").astype(np.int64)


def _grouped(part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """An order by part, and each part's stretch of it."""
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[order], prepend=-1))
    return order, list(zip(cut.tolist(), np.append(cut[1:], len(order)).tolist(), strict=True))


def repeated_anchors(docs: DataFrame, length: int, parts: int) -> DataFrame:
    """doc_id, place: positions of anchors whose hash occurs more than once; of hot ones, -1 less the position."""

    def deal(batch: pa.RecordBatch) -> dict | None:
        ids, found = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            place, h, _, _ = anchors(_raw(text), length)
            ids.append(np.full(len(place), doc, dtype=np.int64))
            found.append((place, h))
        doc, place, h = np.concatenate(ids), np.concatenate([p for p, _ in found]), np.concatenate([h for _, h in found])
        if not len(h):
            return None
        part = (h % np.uint64(parts)).astype(np.int64)
        order, cuts = _grouped(part)
        return {"part": [int(part[order[a]]) for a, _ in cuts], "hashes": [h[order[a:z]].tobytes() for a, z in cuts], "docs": [_pack(doc[order[a:z]]) for a, z in cuts], "places": [_pack(place[order[a:z]]) for a, z in cuts]}

    dealt = arrow_map(docs, deal, "part int, hashes binary, docs binary, places binary", rows=4096, limit=8_000_000).repartition(parts, "part")

    def gather(batches):
        held = [[], [], []]
        for batch in batches:
            for h, doc, place in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                held[0].append(np.frombuffer(h, dtype=np.uint64))
                held[1].append(_unpack(doc, len(h) // 8))
                held[2].append(_unpack(place, len(h) // 8))
        if not held[0]:
            return
        h, doc, place = (np.concatenate(x) for x in held)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        begin = np.flatnonzero(np.concatenate([[True], ~same]))
        times = np.diff(np.append(begin, len(order)))
        place[order] = np.where(np.repeat(times > HOT, times), -1 - place[order], place[order])
        twice = order[np.repeat(times > 1, times)]
        for a in range(0, len(twice), 100_000):
            pick = twice[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(doc[pick]), pa.array(place[pick])], ["doc_id", "place"])

    return dealt.select("hashes", "docs", "places").mapInArrow(gather, "doc_id long, place long")


def contexts(texts: DataFrame, length: int, parts: int) -> DataFrame:
    """Packed contexts by part, from texts with the places of their repeated anchors: distinct contexts of a batch (compressed), how often each
    occurs, and its documents and starts. A hot anchor's contexts go to parts by their own bytes, where equal ones are kept once and nothing
    else is compared; the strings of a context, from its first occurrence in the batch, go each to a part by its bytes. Both have -1 less the anchor."""

    def of_bytes(x: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest()) % parts

    def deal(batch: pa.RecordBatch) -> dict | None:
        held: dict[tuple[int, int, bytes], list[tuple[int, int]]] = {}
        hot: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        for doc, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = _raw(text)
            place, h, first, last = anchors(raw, length)
            places = np.array(places, dtype=np.int64)
            for i in np.flatnonzero(np.isin(-1 - place, places)).tolist():
                hot.setdefault((int(place[i] - first[i]), raw[first[i] : last[i] + length]), []).append((doc, int(first[i])))
            hit = np.isin(place, places)
            part = (h[hit] % np.uint64(parts)).tolist()
            for k, a, z, at in zip(part, first[hit].tolist(), (last[hit] + length).tolist(), place[hit].tolist(), strict=True):
                held.setdefault((k, at - a, raw[a:z]), []).append((doc, a))
        for (at, context), where in hot.items():
            held.setdefault((of_bytes(context), -1 - at, context), []).extend(where)
            doc, a = min(where)
            for k in range(len(context) - length + 1 if len(context) > length else 0):
                string = context[k : k + length]
                held.setdefault((of_bytes(string), -1 - (at - k), string), []).append((doc, a + k))
        if not held:
            return None
        by_part: dict[int, list] = {}
        for (part, at, context), where in held.items():
            by_part.setdefault(part, []).append((context, at, where))
        out: dict[str, list] = {n: [] for n in ("part", "bytes", "sizes", "anchors", "times", "docs", "starts")}
        press = zstandard.ZstdCompressor(level=1)
        for part, pairs in by_part.items():
            flat = np.array([x for _, _, where in pairs for x in where], dtype=np.int64)
            for name, x in (("part", part), ("bytes", press.compress(b"".join(c for c, _, _ in pairs))), ("sizes", np.array([len(c) for c, _, _ in pairs], dtype=np.int32).tobytes()), ("anchors", np.array([at for _, at, _ in pairs], dtype=np.int32).tobytes()), ("times", np.array([len(w) for _, _, w in pairs], dtype=np.int32).tobytes()), ("docs", _pack(flat[:, 0])), ("starts", _pack(flat[:, 1]))):
                out[name].append(x)
        return out

    return arrow_map(texts, deal, "part int, bytes binary, sizes binary, anchors binary, times binary, docs binary, starts binary", rows=4096, limit=8_000_000).repartition(parts, "part")


def could_share(distinct: list[bytes], at: np.ndarray, group: np.ndarray, length: int, most: int = 16) -> np.ndarray:
    """Whether a context could share a string with another of its anchor (equal ``group``): how far two agree to both sides of the
    anchor. Contexts of anchors with more than ``most`` contexts are not compared and all could."""
    many = np.bincount(group)[group]
    out = many > most
    order = np.argsort(group, kind="stable")
    order = order[(~out & (many > 1))[order]]
    reach = length - GRAM
    size = np.array([len(distinct[i]) for i in order.tolist()], dtype=np.int64)
    joined = np.frombuffer(b"".join([distinct[i] for i in order.tolist()]) + bytes(reach), dtype=np.uint8)
    anchor = np.cumsum(size) - size + at[order]
    left, right = at[order], size - at[order] - GRAM

    def agree(a: np.ndarray, b: np.ndarray, room: np.ndarray, way: int) -> np.ndarray:
        """How many bytes agree from a and b on; pairs leave as they part."""
        n, on = np.zeros(len(a), dtype=np.int64), np.arange(len(a))
        for k in range(reach):
            on = on[k < room[on]]
            on = on[joined[a[on] + way * k] == joined[b[on] + way * k]]
            if not len(on):
                break
            n[on] += 1
        return n

    for d in range(1, most):
        i = np.flatnonzero(group[order[d:]] == group[order[:-d]])
        if not len(i):
            break
        j = i + d
        ahead = agree(anchor[i] + GRAM, anchor[j] + GRAM, np.minimum(right[i], right[j]), 1)
        back = agree(anchor[i] - 1, anchor[j] - 1, np.minimum(left[i], left[j]), -1)
        hit = ahead + back + GRAM >= length
        out[order[i[hit]]] = out[order[j[hit]]] = True
    return out


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes of a text of symbols below 512, in order by ``depth`` symbols or more (then by place), from 7 symbols that fit a word and then by ranks of
    three (or, in a long text, two) neighbouring stretches in a word; and the ranks by the first 7, 21, ... symbols, for each such number."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(7, dtype=np.uint64)])
    key = np.zeros(n, dtype=np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | padded[k : k + n]
    bits = n.bit_length()
    times = 3 if 3 * bits <= 64 else 2
    done, ranks = 7, []
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        rank = np.empty(n, dtype=np.uint32)
        rank[order] = np.cumsum(fresh)
        ranks.append((done, rank))
        if done >= depth or fresh.all():
            return order, ranks
        key = rank.astype(np.uint64)
        for k in range(1, times):
            key <<= np.uint64(bits)
            key[: max(n - k * done, 0)] |= rank[k * done :]
        done *= times


def common(text: np.ndarray, ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """How many symbols the suffixes at ``a`` and ``b`` (pairwise unlike) have in common, ``depth`` at most: stretches of equal rank are stepped over whole,
    the longest first, and what is left symbol by symbol."""
    n, match, on = len(text), np.zeros(len(a), dtype=np.int64), np.arange(len(a))

    def step(on: np.ndarray, held: np.ndarray, size: int) -> np.ndarray:
        """Advance the pairs whose next stretches are equal; these are returned."""
        x, y = a[on] + match[on], b[on] + match[on]
        inside = np.maximum(x, y) < n
        on, x, y = on[inside], x[inside], y[inside]
        on = on[held[x] == held[y]]
        match[on] += size
        return on

    for size, rank in reversed(ranks):
        again = on
        while len(again):
            again = step(again, rank, size)
            again = again[match[again] < depth]
    again = on
    while len(again):
        again = step(again, text, 1)
        again = again[match[again] < depth]
    return match


def same_strings(distinct: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the joined contexts, of suffixes in order; group numbers): equal numbers are equal strings of ``length`` bytes. Contexts are joined
    with a separator after each."""
    size = np.array([len(c) for c in distinct], dtype=np.int64)
    joined = np.frombuffer(b"\0".join(distinct) + b"\0", dtype=np.uint8).astype(np.int16) + 1
    joined[np.cumsum(size + 1) - 1] = 0
    n = len(joined)
    # two distinct contexts differ before their ends, so a match runs through one separator at most
    depth = 2 * (int(size.max()) + 1)
    order, ranks = suffix_order(joined, depth)
    before = np.where(order > 0, joined[order - 1], -1)  # the transform; nothing stands before the whole text
    rows = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
    # samples at the run ends: where a run begins, and the last suffix of the run above it
    sample = order[rows]
    match = np.zeros(len(rows), dtype=np.int64)
    match[1:] = common(joined, ranks, sample[1:], order[rows[1:] - 1], depth)
    # streamed over text positions: from each sample on, one less with every step
    by_place = np.argsort(sample)
    place, value = sample[by_place], match[by_place]
    last = np.repeat(np.arange(-1, len(place)), np.diff(np.concatenate([[0], place, [n]])))
    statistic = np.where(last >= 0, value[last] - (np.arange(n) - place[last]), 0)
    return order, np.cumsum(statistic[order] < length)


def _later(distinct: list[bytes], own_doc: np.ndarray, own_begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents and stretches of strings that occur earlier in another of these contexts."""
    size = np.array([len(c) for c in distinct], dtype=np.int64)
    order, group = same_strings(distinct, length)
    n = len(order)
    owner = np.repeat(np.arange(len(distinct)), size + 1)
    offset = np.arange(n) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    valid = (offset + length <= size[owner])[order]
    rows, group = order[valid], group[valid]
    _, who = np.unique(own_doc, return_inverse=True)
    key = (who[owner[rows]].astype(np.int64) << 40) | (own_begin[owner[rows]] + offset[rows])
    cut = np.flatnonzero(np.diff(group, prepend=-1))
    least = np.repeat(np.minimum.reduceat(key, cut), np.diff(np.append(cut, len(group))))
    later = np.zeros(n, dtype=bool)
    later[rows[key > least]] = True
    # neighbouring string starts are one stretch
    edge = np.diff(later.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    return own_doc[owner[begin]], own_begin[owner[begin]] + offset[begin], own_begin[owner[begin]] + offset[end] + length


def repeats(packed: DataFrame, length: int) -> DataFrame:
    """doc_id, a, z: stretches of bytes covered by strings that occur earlier."""

    def find(batches):
        unpress = zstandard.ZstdDecompressor()
        number: dict[tuple[int, bytes], int] = {}
        which, docs, begins = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for batch in batches:
            for raw, sizes, ats, times, doc, begin in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                raw = unpress.decompress(raw)
                ends = np.cumsum(np.frombuffer(sizes, dtype=np.int32)).tolist()
                own = [number.setdefault((at, raw[a:z]), len(number)) for at, a, z in zip(np.frombuffer(ats, dtype=np.int32).tolist(), [0, *ends], ends)]
                which.append(np.repeat(np.array(own, dtype=np.int64), np.frombuffer(times, dtype=np.int32)))
                docs.append(_unpack(doc, len(which[-1])))
                begins.append(_unpack(begin, len(which[-1])))
        if not number:
            return
        distinct, at = [c for _, c in number], np.array([a for a, _ in number])
        number = None
        size = np.array([len(c) for c in distinct], dtype=np.int64)
        which, doc, begin = (np.concatenate(x) for x in (which, docs, begins))
        order = np.lexsort((begin, doc, which))
        which, doc, begin = which[order], doc[order], begin[order]
        first = np.concatenate([[True], which[1:] != which[:-1]])
        own_doc, own_begin = doc[first], begin[first]
        yield from stretches(doc[~first], begin[~first], begin[~first] + size[which[~first]])
        # what distinct contexts of an anchor share, an index for some anchors at a time; those of hot ones have met as strings
        cold = np.flatnonzero(at >= 0)
        distinct, at, size, own_doc, own_begin = [distinct[i] for i in cold.tolist()], at[cold], size[cold], own_doc[cold], own_begin[cold]
        if not len(cold):
            return
        gram: dict[bytes, int] = {}
        group = np.array([gram.setdefault(c[a : a + GRAM], len(gram)) for c, a in zip(distinct, at.tolist(), strict=True)])
        gram = None
        keep = np.flatnonzero(could_share(distinct, at, group, length))
        keep = keep[np.argsort(group[keep], kind="stable")]
        if not len(keep):
            return
        share = np.cumsum(size[keep]) // INDEXED
        new_group = np.concatenate([[True], group[keep][1:] != group[keep][:-1]])
        # an anchor's contexts stay in the index where its first one is
        share = np.maximum.accumulate(np.where(new_group, share, 0))
        cuts = np.flatnonzero(np.diff(share, prepend=-1))
        for a, z in zip(cuts, np.append(cuts[1:], len(keep)), strict=True):
            pick = keep[a:z]
            yield from stretches(*_later([distinct[i] for i in pick.tolist()], own_doc[pick], own_begin[pick], length))

    def stretches(doc, a, z):
        for i in range(0, len(doc), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (doc, a, z)], ["doc_id", "a", "z"])

    return packed.select("bytes", "sizes", "anchors", "times", "docs", "starts").mapInArrow(find, "doc_id long, a long, z long")


def removed(raw: bytes, stretches: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of a text without the stretches, and the number of maximal runs that went."""
    cover = np.zeros(len(raw) + 1, dtype=np.int32)
    if stretches:
        x = np.array(stretches, dtype=np.int64)
        np.add.at(cover, x[:, 0], 1)
        np.add.at(cover, x[:, 1], -1)
    gone = np.cumsum(cover[:-1]) > 0
    return np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes(), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Documents with ids that are distinct and not null: their own where those are, else places in their order (and the table that
    gives the own ids back). Nulls come first."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if named.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return named, None
    rows = stage(named.withColumn("row", F.monotonically_increasing_id()))
    place = starts(rows.select("row", F.coalesce("doc_id", F.lit(-(2**63))).alias("key"), F.lit(1).cast("long").alias("n")))
    both = stage(rows.join(place, "row"))
    return both.select(F.col("start").alias("doc_id"), "text"), both.select(F.col("start").alias("place"), F.col("doc_id").alias("own"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary: the bytes that stay).

    Bytes covered by a string of ``length`` bytes that also starts earlier (in a smaller doc_id, or before in the same) are
    removed; null texts are empty. Repeated ids count in the order of their rows, nulls first. An empty table gives an empty result."""
    named, own = _numbered(docs, id_col, text_col)
    named = named.where("doc_id IS NOT NULL")  # none is; both joins then read texts by one and the same shuffle
    size = named.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = parts_of(named.sparkSession, size, PART)
    places = repeated_anchors(named, length, parts).groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    packed = contexts(named.join(places, "doc_id").select("doc_id", "text", "places"), length, parts)
    by_doc = repeats(packed, length).groupBy("doc_id").agg(F.collect_list(F.array("a", "z")).alias("stretches"))

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = _raw(text)
            left, runs = removed(raw, found or [])
            for name, x in (("doc_id", doc), ("n_bytes", len(raw)), ("n_removed", len(raw) - len(left)), ("n_spans", runs), ("kept_sha256", hashlib.sha256(left).hexdigest()), ("kept", left)):
                out[name].append(x)
        return out

    done = arrow_map(named.join(by_doc, "doc_id", "left").select("doc_id", "text", "stretches"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if own is None:
        return done
    return done.join(own, F.col("doc_id") == F.col("place")).drop("doc_id", "place").withColumnRenamed("own", "doc_id").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
