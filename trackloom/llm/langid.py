"""Language identification by a linear-chain conditional random field over words.

A word's affixes, character n-grams and lexicon memberships give its label scores; learned transitions tie neighbours; forward-backward
gives each word's label probabilities, so text that switches language is labelled word by word. A document's language is the one with most
letters in expectation.

The field is fitted on the driver to a bounded, digest-ordered sample of labelled documents (``train_docs`` of them, ``train_words``
consecutive words of each). Sequences of sample segments from several documents teach the transitions what a switch costs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, map_rows, mix

#: Letters by their Unicode category, without numeric signs such as fractions, superscripts and Roman numerals.
WORD = regex.compile(r"\p{L}+")
#: Hashed features; the lexicon's come after them.
FEATURES = 1 << 16
#: Words of each language's lexicon.
LEXICON = 400
#: The label of texts without a letter.
UNDETERMINED = "und"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _hashed(kind: int, *codes: np.ndarray) -> np.ndarray:
    h = np.full(codes[0].shape, kind + 1, dtype=np.uint64)
    for c in codes:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c)
    return (h % np.uint64(FEATURES)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of non-empty words, and which word each is of: affixes of one to three characters, 2- and 3-grams of the word
    between marks, and the word itself."""
    codes = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    end = np.cumsum(size)
    begin = end - size
    of = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(codes)) - begin[of]
    whole = np.add.reduceat(mix(codes + (at.astype(np.uint64) << np.uint64(32))), begin)
    first = [codes[np.minimum(begin + k, end - 1)] for k in (1, 2, 3)]
    last = [codes[np.maximum(end - 1 - k, begin)] for k in (1, 2, 3)]
    two, three = np.flatnonzero(at < size[of] - 1), np.flatnonzero(at < size[of] - 2)
    each = np.arange(len(words))
    kinds = [(_hashed(0, whole), each), (_hashed(7, codes[two], codes[two + 1]), of[two]), (_hashed(8, codes[three], codes[three + 1], codes[three + 2]), of[three])]
    kinds += [(_hashed(k, *first[:k]), each) for k in (1, 2, 3)] + [(_hashed(3 + k, *last[:k]), each) for k in (1, 2, 3)]
    return np.concatenate([f for f, _ in kinds]), np.concatenate([o for _, o in kinds])


@dataclass
class Field:
    """labels; weight (FEATURES + labels, labels): of a word's features and of the lexicons that hold it; moves (labels, labels): of transitions."""

    labels: list[str]
    weight: np.ndarray
    moves: np.ndarray
    lexicon: dict[str, list[int]]

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``weight``, and the word that each counts for."""
        row, of = features(words)
        held = [(FEATURES + k, i) for i, ks in enumerate(map(self.lexicon.get, words)) if ks for k in ks]
        more = np.array(held, dtype=np.int64).reshape(-1, 2)
        return np.concatenate([row, more[:, 0]]), np.concatenate([of, more[:, 1]])

    def sums(self, row: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(of, self.weight[row, k], n) for k in range(len(self.labels))], axis=1)

    def scores(self, words: list[str]) -> np.ndarray:
        return self.sums(*self.rows(words), len(words)) if words else np.zeros((0, len(self.labels)))


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Local, forward and backward factors (each scaled) of every position of chains that lie one after another in ``scores``. Chains are stepped together, longest first, so that
    those still going are a prefix."""
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(moves - moves.max())
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    going = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    ahead, back = np.empty_like(local), np.ones_like(local)
    for t, k in enumerate(going):
        at = begin[:k] + t
        now = local[at] if not t else (ahead[at - 1] @ step) * local[at]
        ahead[at] = now / now.sum(axis=1, keepdims=True)
    for t in range(len(going) - 2, -1, -1):
        at = begin[: going[t + 1]] + t
        now = (local[at + 1] * back[at + 1]) @ step.T
        back[at] = now / now.sum(axis=1, keepdims=True)
    return local, ahead, back


def posteriors(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Label probabilities of every position."""
    _, ahead, back = forward_backward(scores, lengths, moves)
    both = ahead * back
    return both / both.sum(axis=1, keepdims=True)


def fit(segments: list[tuple[str, list[str]]], rounds: int = 40, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """The field of labelled word segments, by AdaGrad on the conditional likelihood. Chains join three segments in a seeded random order."""
    labels = sorted({lang for lang, _ in segments})
    place = {lang: k for k, lang in enumerate(labels)}
    often = {lang: Counter() for lang in labels}
    for lang, words in segments:
        often[lang].update(words)
    lexicon: dict[str, list[int]] = {}
    for lang in labels:
        for w, _ in sorted(often[lang].items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(w, []).append(place[lang])
    n = len(labels)
    field = Field(labels, np.zeros((FEATURES + n, n)), np.zeros((n, n)), lexicon)
    shuffled = [segments[i] for i in np.random.default_rng(11).permutation(len(segments))]
    chains = [shuffled[i : i + 3] for i in range(0, len(shuffled), 3)]
    words = [w for group in chains for _, part in group for w in part]
    truth = np.array([place[lang] for group in chains for lang, part in group for _ in part])
    lengths = np.array([sum(len(part) for _, part in group) for group in chains])
    kinds = sorted(set(words))
    code = {w: i for i, w in enumerate(kinds)}
    which = np.array([code[w] for w in words])
    flat, of = field.rows(kinds)
    inner = np.ones(len(words), dtype=bool)
    inner[np.cumsum(lengths) - lengths] = False
    inner = np.flatnonzero(inner)
    gold = np.eye(n)[truth]
    gold_moves = np.zeros((n, n))
    np.add.at(gold_moves, (truth[inner - 1], truth[inner]), 1)
    seen, seen_moves = np.full_like(field.weight, 1e-8), np.full_like(field.moves, 1e-8)
    for _ in range(rounds):
        scores = field.sums(flat, of, len(kinds))[which]
        local, ahead, back = forward_backward(scores, lengths, field.moves)
        p = ahead * back
        p /= p.sum(axis=1, keepdims=True)
        by_kind = np.stack([np.bincount(which, (gold - p)[:, k], len(kinds)) for k in range(n)], axis=1)
        slope = np.stack([np.bincount(flat, by_kind[of, k], len(field.weight)) for k in range(n)], axis=1) / len(words) - decay * field.weight
        joint = np.einsum("ti,ij,tj->tij", ahead[inner - 1], np.exp(field.moves - field.moves.max()), (local * back)[inner])
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        move = (gold_moves - joint.sum(axis=0)) / len(words) - decay * field.moves
        seen += slope**2
        seen_moves += move**2
        field.weight += rate * slope / np.sqrt(seen)
        field.moves += rate * move / np.sqrt(seen_moves)
    return field


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 2 by 4. A null id is not held out (nor learned from)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train_docs: int, train_words: int) -> list[tuple[str, list[str]]]:
    """Segments of the ``train_docs`` labelled documents that come first by their ids' digests."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    usable = named.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in ("doc_id", "lang", "words")}
        for doc, text, lang in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            words = words_of(text)
            at = zlib.crc32(str(doc).encode()) % max(1, len(words) - train_words + 1)
            out["doc_id"].append(doc)
            out["lang"].append(lang)
            out["words"].append(words[at : at + train_words])
        return out

    # ids alone are ordered; the texts of those few are then read
    first = usable.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(train_docs).select("doc_id").distinct()
    cut = arrow_map(usable.join(F.broadcast(first), "doc_id", "left_semi"), run, "doc_id long, lang string, words array<string>")
    rows = cut.orderBy("doc_id", "lang", "words").collect()  # train_docs segments, but for repeated ids
    return [(r.lang, list(r.words)) for r in rows if r.words]


def label(field: Field, texts: list[str | None]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words and their label probabilities, per text. A batch's distinct words are scored once."""
    split = [words_of(t) for t in texts]
    lengths = np.array([len(w) for w in split], dtype=np.int64)
    words = list(chain.from_iterable(split))
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    which = np.fromiter(map(code.__getitem__, words), dtype=np.int64, count=len(words))
    p = posteriors(field.scores(list(code))[which], lengths[lengths > 0], field.moves)
    for words, end in zip(split, np.cumsum(lengths), strict=True):
        yield words, p[end - len(words) : end]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 1500, train_words: int = 120) -> Field | None:
    """The fitted field, or None where nothing is labelled."""
    segments = sample(docs, id_col, text_col, lang_col, train_docs, train_words)
    return fit(segments) if segments else None


def judge(field: Field | None, texts: list[str | None]) -> Iterator[tuple[str, float]]:
    """Language and score of each text."""
    if field is None:
        yield from ((UNDETERMINED, 0.0) for _ in texts)
        return
    for words, p in label(field, texts):
        if words:
            size = np.fromiter(map(len, words), dtype=np.float64, count=len(words))
            share = size @ p / size.sum()
            k = int(share.argmax())
            yield field.labels[k], min(1.0, float(share[k]))
        else:
            yield UNDETERMINED, 0.0


def predict(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (its share of the letters in expectation, 0 to 1).

    Null texts and those without a letter are ``und`` with score 0, as are all where the field is None. Ties go to the first label."""
    held = docs.sparkSession.sparkContext.broadcast(field)  # FEATURES + labels rows

    def run(batch: pa.RecordBatch) -> dict:
        pred, score = zip(*judge(held.value, batch.column(1).to_pylist()), strict=True)
        return {"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": pred, "score": score}

    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    return arrow_map(named, run, "doc_id long, held_out boolean, lang_pred string, score double", rows=2048, limit=1_500_000)


def keep_identified(docs: DataFrame, field: Field | None, least: float, text_col: str = "text") -> DataFrame:
    """Documents, all columns as they are, whose language is determined with a score of ``least`` or more."""
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        return batch.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score in judge(held.value, texts)]))

    return map_rows(docs, run, text_col, 1_500_000)


def label_words(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, words, labels (a label for each word); both empty where there is no letter."""
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(batch: pa.RecordBatch) -> dict:
        pairs = list(label(held.value, batch.column(1).to_pylist()))
        return {"doc_id": batch.column(0), "words": [w for w, _ in pairs], "labels": [[held.value.labels[k] for k in p.argmax(axis=1)] for _, p in pairs]}

    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, words array<string>, labels array<string>")
