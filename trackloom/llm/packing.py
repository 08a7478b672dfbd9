"""Packing in the order of a space-filling curve.

A document's token ids are hashed to a few dimensions (seeded random signs, summed over its tokens and scaled), each
coordinate is cut into equal shares of the normal curve, and the cell's place on a Hilbert curve is the key. Documents are
range-sorted by (key, row), their tokens form one gapless stream in that order, and the stream is cut every ``width`` tokens:
neighbours on the curve share sequences, and only the last sequence needs padding. Where a document starts in the
stream is the sum of what comes before: per range partition in tasks, across partitions over one number each.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, stage

#: Dimensions and bits of the curve.
DIMS, BITS = 4, 12
#: The vocabulary's splitting of texts for characters up to U+024F, apart from those where Python's classes and Unicode's
#: differ; texts with others are split by the encoder itself.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:_|[^\s\w])+|\s+(?!\S)|\s+")
_OTHER = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
_CONTROL = re.compile("[\x1c-\x1f]")
#: The added token of byte_bpe_50k.json.
ADDED, ADDED_ID = "<|endoftext|>", 50256
#: Distinct words that a task remembers.
REMEMBERED = 250_000


class Encoder:
    """Byte-level BPE ids of texts; words met before come from memory."""

    def __init__(self, ranks_file: str, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(ranks_file, "rb"))}
        self.model = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def miss(self, word: str) -> bytes:
        ids = np.array(self.model.encode_ordinary(word), dtype="<u2").tobytes()
        if len(word) <= 48:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if (_CONTROL if text.isascii() else _OTHER).search(text):
            return np.array(self.model.encode_ordinary(text), dtype="<u2")
        get, miss = self.known.get, self.miss
        return np.frombuffer(b"".join([get(w) or miss(w) for w in _SPLIT.findall(text)]), dtype="<u2")

    def encode_added(self, text: str) -> np.ndarray:
        """Like ``encode``, with one id for each added token; what stands between those is encoded by itself."""
        if ADDED not in text:
            return self.encode(text)
        between = [self.encode(x) for x in text.split(ADDED)]
        one = np.array([ADDED_ID], dtype="<u2")
        return np.concatenate([x for pair in zip(between, [one] * len(between)) for x in pair][:-1])


@lru_cache(maxsize=1)
def _encoder() -> Encoder:
    """The vocabulary of byte_bpe_50k.json; its ranks give the same ids as that file and faster, but for the added token."""
    import public_tokenizers

    return Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with ``bits``-bit coordinates: cells is (points, dimensions). Each bit
    plane, from the top, exchanges or inverts the lower bits so that the sub-cube is entered where the last was left;
    Gray decoding of the planes then gives the place."""
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for d in range(dims):
            inside = (x[:, d] >> b) & 1 == 1
            swap = np.where(inside, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(inside, low, swap)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, dims - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[:, d] >> b) & 1)
    return key


@lru_cache(maxsize=1)
def _directions(n_ids: int) -> np.ndarray:
    return np.random.default_rng(7).choice(np.array([-1, 1], dtype=np.float32), size=(n_ids, DIMS))


def curve_key(ids: list[np.ndarray], n_ids: int = 1 << 16) -> np.ndarray:
    """Hilbert keys of documents. A coordinate is the mean sign over the document's tokens, which word choice shifts by some
    hundredths whatever the length; the logistic curve spreads it over the cells."""
    axes = _directions(n_ids)
    mean = np.array([axes[x].mean(axis=0, dtype=np.float64) if len(x) else np.zeros(DIMS) for x in ids])
    share = 1 / (1 + np.exp(-12 * mean))
    return hilbert(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def tokenised(docs: DataFrame, id_col: str, text_col: str, end_id: int, added: bool = True) -> DataFrame:
    """doc_id, key, n, ids (little-endian 16-bit), with the end id after each document. Null texts are empty."""

    def run(batch: pa.RecordBatch) -> dict:
        encode = _encoder().encode_added if added else _encoder().encode
        ids = [np.append(encode(t or ""), np.array([end_id], dtype="<u2")) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "key": curve_key([x[:-1] for x in ids]), "n": [len(x) for x in ids], "ids": [x.tobytes() for x in ids]}

    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, key long, n long, ids binary")


def starts(rows: DataFrame) -> DataFrame:
    """row, start: where each row's tokens begin in the stream ordered by (key, row)."""
    spark = rows.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def sums(batches):
        at = 0
        part = None
        for batch in batches:
            if batch.num_rows:
                n = np.asarray(batch.column(1))
                part = batch.column(2)[0].as_py() if part is None else part
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(n), pa.int32()), "row": batch.column(0), "local": pa.array(at + np.cumsum(n) - n, pa.int64()), "n": batch.column(1)})
                at += int(n.sum())

    dealt = rows.select("key", "row", "n").repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row")
    local = stage(dealt.select("row", "n", F.spark_partition_id().alias("part")).mapInArrow(sums, "part int, row long, local long, n long"))
    totals = local.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a number for each partition
    ahead = list(accumulate([r.n for r in totals], initial=0))
    base = spark.createDataFrame([(r.part, a) for r, a in zip(totals, ahead)], "part int, base long")
    return local.join(F.broadcast(base), "part").select("row", (F.col("base") + F.col("local")).alias("start"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 1024, end_id: int = 0, added: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (binary). ``added``: the vocabulary's
    added token in a text is one id, as the tokenizer file has it; else it is the ids of its letters.

    Repeated rows and null ids are documents of their own; an empty table gives an empty result. Documents with equal keys follow one another
    in the order in which their rows were read, which may differ between runs."""
    rows = stage(tokenised(docs, id_col, text_col, end_id, added).withColumn("row", F.monotonically_increasing_id()))
    placed = rows.select("doc_id", "row", "ids").join(starts(rows), "row").select("doc_id", "ids", "start")

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
        for doc, raw, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            ids = np.frombuffer(raw, dtype="<u2")
            begin = 0
            while begin < len(ids):
                seq, off = divmod(at + begin, width)
                end = min(len(ids), begin + width - off)
                piece = ids[begin:end]
                for name, x in (("doc_id", doc), ("start", begin), ("length", end - begin), ("ids_crc32", zlib.crc32(piece.astype("<u4").tobytes())), ("doc_tokens", len(ids)), ("sequence_id", seq), ("offset", off), ("ids", piece.tobytes())):
                    out[name].append(x)
                begin = end
        return out

    return arrow_map(placed, cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary", "ids")
