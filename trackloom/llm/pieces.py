"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi.

The automaton holds every piece. Reading a text once, it reports by its output links each piece that ends at the
current character, and each report relaxes the best score there: score[end] = max(score[end - len(piece)] + the piece's
score). What no piece covers falls back to byte pieces. Where no piece of the vocabulary crosses from a character into a
following meta space, the best segmentation of a text is that of its parts cut there, and so it is between two characters that
no piece has side by side; a part's ids are remembered.

In a unigram vocabulary a path's score is the sum of its pieces'. In a merge (BPE) vocabulary the pieces' scores are ranks
of merges, and their sum is not what the format maximises: there a path scores zero if every two neighbours on it stay
apart when they are merged by rank, and minus infinity otherwise. One path scores zero, and it is the merged encoding.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: The meta space, a fixed value of the format.
META = "▁"
#: How far below the worst piece an unknown character scores; a fixed value of the format.
UNKNOWN = 10.0
#: Texts' parts that a task remembers.
REMEMBERED = 300_000


class Pieces:
    """A vocabulary file, ready to encode and decode."""

    def __init__(self, model_file: str, kind: str = "bpe"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {int(name[3:5], 16): i for i, name in enumerate(self.names) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown_id = sp.unk_id()
        self.rank = {name: sp.get_score(i) for i, name in enumerate(self.names) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.machine = ahocorasick.Automaton()
        for i, name in enumerate(self.names):
            if name in self.rank and name:
                self.machine.add_word(name, (len(name), self.rank[name], i))
        self.machine.make_automaton()
        self.merging = kind == "bpe"
        self.single = {name for name in self.rank if len(name) == 1}
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else name.replace(META, " ").encode() for i, name in enumerate(self.names)]
        self.unknown = min(self.rank.values(), default=0.0) - UNKNOWN
        whole = not any(re.search(f"[^{META}]{META}", name) for name in self.rank)
        self.parts = re.compile(self.cuts() if whole else "(?s).+")
        self.known: dict[str, bytes] = {}
        self.apart: dict[tuple | int, bool] = {}

    def cuts(self) -> str:
        """A pattern of parts that no piece crosses: what meta spaces lead, cut again between letters and others. Characters that a piece has next to a letter
        are neither; a run that one follows stays with the rest of its word."""
        letters = {c for name in self.rank for c in name if c.isalpha()}
        near = {y for name in self.rank for pair in zip(name, name[1:]) for x, y in (pair, pair[::-1]) if x in letters} - letters - {META}
        plain, tied = ("".join(map(re.escape, sorted(x))) for x in (letters, near))
        alone = f"(?![{tied}])" if tied else ""
        runs = [f"[{plain}]++{alone}"] * bool(plain) + [f"[^{plain}{tied}{META}]++{alone}", f"[^{META}]+"]
        return "|".join(f"{META}*+{run}" for run in runs) + f"|{META}+"

    def merged(self, text: str) -> list[str]:
        """A short text merged by rank, the leftmost of equals first."""
        parts = list(text)
        while True:
            pairs = [(self.rank[x], -k) for k, x in enumerate(map("".join, zip(parts, parts[1:]))) if x in self.rank]
            if not pairs:
                return parts
            k = -max(pairs)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether merging leaves two neighbours as they are. Only a merge across the seam can change them."""
        return self.merged(left + right) == [left, right]

    def scoring_zero(self, text: str) -> list[int]:
        """Ids of the path that scores zero in a merge vocabulary that has every character of the text as a piece: each position has such a path, and no score needs to be held.
        Empty if there is none."""
        n = len(text)
        back, by = [0] * (n + 1), [-2] * (n + 1)
        apart, size_of = self.apart, len(self.names)
        for last, (size, _, i) in self.machine.iter(text):
            end = last + 1
            if by[end] >= 0:
                continue
            start = end - size
            if start:
                left = by[start]
                if left < 0:
                    continue
                key = left * size_of + i
                ok = apart.get(key)
                if ok is None:
                    if len(apart) >= REMEMBERED:
                        apart.clear()
                    ok = apart[key] = self.stay_apart(self.names[left], self.names[i])
                if not ok:
                    continue
            by[end], back[end] = i, start
        out: list[int] = []
        while n:
            if by[n] < 0:
                return []
            out.append(by[n])
            n = back[n]
        return out[::-1]

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best segmentation; of equal scores, the longest last piece stays."""
        if self.merging and self.single.issuperset(text) and (ids := self.scoring_zero(text)):
            return ids
        n = len(text)
        score, back, by = [0.0] + [-math.inf] * n, [0] * (n + 1), [-2] * (n + 1)
        merging, apart, none = self.merging, self.apart, -math.inf
        settled = 0

        def relax(start: int, end: int, value: float, i: int) -> None:
            if merging:
                # a step scores nothing if its piece and the one before it stay apart; one path does all along
                if score[end] == 0.0 or score[start] != 0.0:
                    return
                if start:
                    key = (by[start], i) if by[start] >= 0 <= i else (text[back[start] : start], text[start:end])
                    ok = apart.get(key)
                    if ok is None:
                        if len(apart) >= REMEMBERED:
                            apart.clear()
                        ok = apart[key] = self.stay_apart(text[back[start] : start], text[start:end])
                    if not ok:
                        return
                score[end], back[end], by[end] = 0.0, start, i
            elif score[start] + value > score[end]:
                score[end], back[end], by[end] = score[start] + value, start, i

        for last, (size, value, i) in self.machine.iter(text):
            while settled < last:  # every report for earlier ends has come
                settled += 1
                if score[settled] == none:
                    relax(settled - 1, settled, self.unknown, -1)
            relax(last + 1 - size, last + 1, value, i)
        while settled < n:
            settled += 1
            if score[settled] == none:
                relax(settled - 1, settled, self.unknown, -1)
        out: list[int] = []
        while n:
            start = back[n]
            if by[n] >= 0:
                out.append(by[n])
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(text[start:n].encode())]
            else:
                out.append(self.unknown_id)
            n = start
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; spaces become meta spaces, and one leads. An empty text has none."""
        if not text:
            return np.empty(0, dtype=np.uint32)
        parts = self.parts.findall(META + text.replace(" ", META))
        out = list(map(self.known.get, parts))
        if None in out:
            for k, part in enumerate(parts):
                if out[k] is None:
                    ids = self.known.get(part)
                    if ids is None:
                        ids = array("I", self.viterbi(part)).tobytes()
                        if len(part) <= 64:
                            if len(self.known) >= REMEMBERED:
                                self.known.clear()
                            self.known[part] = ids
                    out[k] = ids
        return np.frombuffer(b"".join(out), dtype=np.uint32)

    def decode(self, ids) -> str:
        """The text of ids: byte pieces joined as UTF-8, meta spaces as spaces, the leading one dropped."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def _loaded(model_file: str, kind: str) -> Pieces:
    return Pieces(model_file, kind)


def encode(docs: DataFrame, model_file: str, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array), decoded (the text that the ids give back). Null texts count as empty; a U+2581 in a text is
    read back as a space, as the format has it. An empty table gives an empty result. Every executor needs ``model_file``."""

    def run(batch: pa.RecordBatch) -> dict:
        model = _loaded(model_file, kind)
        ids = [model.encode(t or "") for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "ids": ids, "decoded": [model.decode(x) for x in ids]}

    return arrow_map(_named(docs, id_col, text_col), run, "doc_id long, ids array<int>, decoded string", rows=256)


def encode_digest(docs: DataFrame, model_file: str, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, n_bytes (ids of byte pieces), ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256, exact
    (decoding gave the text back): what a check of whole texts needs, without the ids themselves."""

    def run(batch: pa.RecordBatch) -> dict:
        model = _loaded(model_file, kind)
        low, high = min(model.byte_of, default=0), max(model.byte_of, default=-1)
        out: dict[str, list] = {n: [] for n in ("doc_id", "n_ids", "n_bytes", "ids_crc32", "decoded_sha256", "exact")}
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            ids = model.encode(text)
            back = model.decode(ids)
            for name, x in (("doc_id", doc), ("n_ids", len(ids)), ("n_bytes", int(((ids >= low) & (ids <= high)).sum())), ("ids_crc32", zlib.crc32(ids.tobytes())), ("decoded_sha256", hashlib.sha256(back.encode()).hexdigest()), ("exact", back == text)):
                out[name].append(x)
        return out

    return arrow_map(_named(docs, id_col, text_col), run, "doc_id long, n_ids long, n_bytes long, ids_crc32 long, decoded_sha256 string, exact boolean", rows=256)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
