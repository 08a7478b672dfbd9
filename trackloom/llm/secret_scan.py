"""Secret scan: base rules, and probabilistic automata inferred from the credentials that those rules label.

Grammar inference: the labelled strings of a kind form a prefix tree over symbol classes (digits, letters by case, each mark for itself), with the frequencies of the
characters in each state, of stopping there, and of how much of the string is still to come. States are merged, in breadth-first order, where
neither what follows nor what remains differs beyond Hoeffding's bound; a state that too few strings reach to tell joins the
nearest one. So credentials of a fixed length become a chain of states and those of free length a few loops. An automaton of ordinary tokens is
inferred likewise. Every token of credential characters that lies in no base span is a candidate, and scored: it is a secret if the likelihood of a kind's format
outweighs that of an ordinary token by more than ordinary tokens outnumber the labelled ones, is no less than most labelled strings reach, and mixes the
classes of symbols as they do: a bare number has likely steps in an automaton of hexadecimal digits, but no letters among many symbols.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, map_rows, release, slices, small_batches, stage

#: The base rules, in the order in which kinds are listed; fixed values.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")
#: A candidate: a run of the characters that values of assignments have, as long as those. A full stop at its end is the sentence's.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{5,}[A-Za-z0-9+/_=-]")
#: Classes of symbols, every other one being a class of its own, and how many symbols a class has; fixed values.
CLASSES = {"0123456789": "d", "abcdef": "a", "ghijklmnopqrstuvwxyz": "l", "ABCDEFGHIJKLMNOPQRSTUVWXYZ": "u"}
CLASS = {c: name for symbols, name in CLASSES.items() for c in symbols}
SIZES = {name: len(symbols) for symbols, name in CLASSES.items()}
#: Strings that must reach a state before it is told from others by test.
LEAST = 20
#: Candidates known to be none that a task remembers.
REMEMBERED = 200_000


def base(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) by the base rules, leftmost and non-overlapping within a kind; failing matches are
    dropped. The credential of an assignment is its value alone."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", m.start(), m.end(), m[1]) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]


def tokens(text: str, found: list[tuple[str, int, int, str]], known: set[str] = frozenset()) -> list[tuple[int, int]]:
    """Candidates that lie in no base span and are not ``known``. Linear in the text, whatever the number of spans."""
    if known and all(t in known for t in CANDIDATE.findall(text)):
        return []
    spans = [m.span() for m in CANDIDATE.finditer(text) if m[0] not in known]
    if not found:
        return spans
    starts, ends = zip(*sorted((s, e) for _, s, e, _ in found), strict=True)
    reach = list(accumulate(ends, max))
    return [(s, e) for s, e in spans if not (k := bisect_right(starts, s)) or reach[k - 1] < e]


@dataclass
class Automaton:
    """Per state: the log probability of each symbol and the state after it, and the log probability of stopping."""

    step: list[dict[str, tuple[float, int]]] = field(default_factory=list)
    stop: list[float] = field(default_factory=list)

    #: Log probability of what a state was never seen to do.
    FLOOR = -9.0

    def score(self, text: str) -> float:
        """Log probability of the text, its end included. A symbol never seen in a state leaves the state as it is."""
        at, total = 0, 0.0
        for c in text:
            found = self.step[at].get(c)
            if found:
                total, at = total + found[0], found[1]
            else:
                total += self.FLOOR
        return total + self.stop[at]


class _Tree:
    """A prefix tree over classes with frequencies, whose states can be folded together."""

    def __init__(self, strings: list[str]):
        self.kids: list[dict[str, int]] = []
        self.count: list[int] = []
        self.symbols: list[Counter] = []
        self.rest: list[Counter] = []  # how many symbols follow; 0 is stopping
        self.state()
        for s in sorted(strings):
            at = 0
            for k in range(len(s) + 1):
                self.count[at] += 1
                self.rest[at][len(s) - k] += 1
                if k < len(s):
                    self.symbols[at][s[k]] += 1
                    name = CLASS.get(s[k], s[k])
                    if name not in self.kids[at]:
                        self.kids[at][name] = self.state()
                    at = self.kids[at][name]

    def state(self) -> int:
        for part, new in ((self.kids, {}), (self.count, 0), (self.symbols, Counter()), (self.rest, Counter())):
            part.append(new)
        return len(self.count) - 1

    def classes(self, a: int) -> Counter:
        out: Counter = Counter()
        for c, n in self.symbols[a].items():
            out[CLASS.get(c, c)] += n
        return out

    def distance(self, a: int, b: int, width: float) -> float | None:
        """How far what remains differs between two states; None if that or what follows differs beyond the bound. States below, too, where enough strings reach both."""
        todo, out = [(a, b)], None
        while todo:
            x, y = todo.pop()
            n, m = self.count[x], self.count[y]
            bound = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            far = 0.0
            for p, q in ((self.rest[x], self.rest[y]), (self.classes(x), self.classes(y))):
                gaps = [abs(p[k] / n - q[k] / m) for k in p.keys() | q.keys()]
                if max(gaps, default=0.0) > bound:
                    return None
                far += sum(gaps)
            out = far if out is None else out
            todo += [(self.kids[x][c], self.kids[y][c]) for c in self.kids[x].keys() & self.kids[y].keys() if x != y and min(self.count[self.kids[x][c]], self.count[self.kids[y][c]]) >= LEAST]
        return out

    def fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            self.count[a] += self.count[b]
            self.symbols[a] += self.symbols[b]
            self.rest[a] += self.rest[b]
            for c, k in self.kids[b].items():
                if c in self.kids[a]:
                    todo.append((self.kids[a][c], k))
                else:
                    self.kids[a][c] = k


def infer(strings: list[str], alpha: float = 0.01) -> Automaton:
    """The automaton of a list of strings (repeats count). ``alpha``: the risk of keeping two like states apart."""
    tree, width = _Tree(strings), math.sqrt(0.5 * math.log(2 / alpha))
    red, done, depth = [0], {0}, {0: 0}
    for r in red:  # settled states; grows meanwhile
        for c in sorted(tree.kids[r]):
            b = tree.kids[r][c]
            if b in done:
                continue
            near = [(far, x) for x in red if (far := tree.distance(x, b, width)) is not None]
            if not near and tree.count[b] < LEAST:  # too few to stand alone: the settled state of its depth, or the deepest
                near = [(abs(depth[x] - depth[r] - 1), x) for x in red]
            if near:
                into = min(near)[1]
                tree.kids[r][c] = into
                tree.fold(into, b)
            else:
                red.append(b)
                done.add(b)
                depth[b] = depth[r] + 1
    # folding may have hung states under settled ones that were done already: they go where their class leads elsewhere
    place = {r: i for i, r in enumerate(red)}
    out = Automaton()
    for r in red:
        n, classes = tree.count[r] + 1, tree.classes(r)  # room for what was not seen
        step = {}
        for name, k in tree.kids[r].items():
            inside = next((symbols for symbols, x in CLASSES.items() if x == name), name)
            for c in inside:  # a class's symbols, those not seen too
                share = (tree.symbols[r][c] + 1) / (classes[name] + SIZES.get(name, 1))
                step[c] = (math.log(classes[name] / n * share), place.get(k, place[r]))
        out.step.append(step)
        out.stop.append(math.log(tree.rest[r][0] / n) if tree.rest[r][0] else Automaton.FLOOR)
    return out


@dataclass
class Mix:
    """Shares of the classes in a kind's strings, one more counted for each known class, and ``unseen`` for a class that none of them has."""

    shares: dict[str, float]
    unseen: float

    @classmethod
    def of(cls, strings: list[str]) -> Mix:
        counts = Counter(CLASSES.values())
        for s in strings:
            counts.update(CLASS.get(c, c) for c in s)
        n = counts.total() + 1
        return cls({c: k / n for c, k in counts.items()}, 1 / n)

    def surprise(self, text: str) -> float:
        """The log likelihood ratio of the text's own shares of classes to these: near 0 whatever the length where it is mixed alike."""
        n = len(text)
        return sum(k * math.log(k / (n * self.shares.get(c, self.unseen))) for c, k in Counter(CLASS.get(c, c) for c in text).items())


@dataclass
class Grammar:
    """By kind: the automaton, the least likelihood per symbol that its own strings reach, their mix of classes, and how far they depart from it at most. Besides, the
    automaton of ordinary tokens, and by how much a kind's likelihood must outweigh the ordinary one."""

    kinds: dict[str, tuple[Automaton, float, Mix, float]]
    ordinary: Automaton
    margin: float

    def accepts(self, token: str) -> bool:
        plain = None
        for a, least, mix, most in self.kinds.values():
            s = a.score(token)
            if s >= least * (len(token) + 1) and mix.surprise(token) <= most:
                plain = self.ordinary.score(token) if plain is None else plain
                if s - plain > self.margin:
                    return True
        return False


def learn(labelled: dict[str, list[str]], ordinary: list[str], odds: float = 1e-4, quantile: float = 0.02, least: int = 20) -> Grammar:
    """Automata and mixes from half of each kind's strings, thresholds from the other half: ``quantile`` of them fall below the likelihood, and as many depart
    further from the mix. A kind with fewer than ``least`` strings gets none. ``odds``: of labelled strings to ordinary tokens."""
    kinds = {}
    for kind, strings in labelled.items():
        if len(strings) >= least:
            a, mix = infer(strings[::2]), Mix.of(strings[::2])
            scores = sorted(a.score(s) / (len(s) + 1) for s in strings[1::2])
            away = sorted((mix.surprise(s) for s in strings[1::2]), reverse=True)
            out = int(quantile * len(scores))
            kinds[kind] = (a, scores[out], mix, away[out])
    return Grammar(kinds, infer(ordinary) if ordinary else Automaton([{}], [0.0]), max(math.log(1 / min(max(odds, 1e-12), 1.0)), 7.0))


def sample_tokens(docs: DataFrame, text_col: str, most: int) -> tuple[dict[str, list[str]], float]:
    """At most ``most`` distinct labelled strings of each kind, and of ordinary tokens (kind ``word``): those of least digests, so the sample is the same
    however the rows are dealt; each task keeps its least ones, and the least of those are the table's. And how many labelled strings there are for each
    ordinary token, counted over all texts."""
    kinds = ("assign", "access", "hex", "word")

    def run(batches):
        best: dict[str, dict[str, int]] = {k: {} for k in kinds}
        bound = dict.fromkeys(kinds, 1 << 32)
        count = dict.fromkeys(kinds, 0)
        for piece in slices(batches, "text", 2048, 2_000_000):
            found: dict[str, set[str]] = {k: set() for k in kinds}
            for text in piece.column(0).to_pylist():
                if text:
                    own = base(text)
                    for kind, _, _, value in own:
                        found[kind].add(value)
                        count[kind] += 1
                    spans = tokens(text, own)
                    count["word"] += len(spans)
                    found["word"].update([text[s:e] for s, e in spans])
            for kind, values in found.items():
                held = best[kind]
                for v in values:
                    if (h := zlib.crc32(v.encode())) <= bound[kind]:
                        held[v] = h
                if len(held) > most:
                    best[kind] = dict(sorted(held.items(), key=lambda x: (x[1], x[0]))[:most])
                    bound[kind] = max(best[kind].values())
        for kind in kinds:
            rows = [(kind, v, h) for v, h in best[kind].items()] + [(f"n_{kind}", "", count[kind])]
            yield pa.RecordBatch.from_pydict(dict(zip(("kind", "value", "h"), map(list, zip(*rows, strict=True)), strict=True)))

    small_batches(docs.sparkSession)
    told = stage(docs.select(F.col(text_col).alias("text")).mapInArrow(run, "kind string, value string, h long"))
    counts = dict(told.groupBy("kind").agg(F.sum("h")).where("kind LIKE 'n\\_%'").collect())
    out = {}
    for kind in kinds:
        rows = told.where(F.col("kind") == kind).select("h", "value").distinct().orderBy("h", "value").limit(most)
        out[kind] = [r.value for r in rows.collect()]  # `most` strings
    release(told)
    return out, sum(counts.get(f"n_{k}", 0) for k in kinds[:3]) / max(1, counts.get("n_word", 0))


def grammar_of(docs: DataFrame, text_col: str, most: int) -> Grammar:
    told, odds = sample_tokens(docs, text_col, most)
    return learn({k: told[k] for k in ("assign", "access", "hex")}, told["word"], odds)


def all_spans(text: str, grammar: Grammar, known: set[str] | None = None) -> list[tuple[str, int, int]]:
    """Base spans and those that the grammar adds. ``known`` keeps candidates that are none."""
    known = set() if known is None else known
    found = base(text)
    out = [x[:3] for x in found]
    for s, e in tokens(text, found, known):
        token = text[s:e]
        if token in known:
            continue
        if grammar.accepts(token):
            out.append(("format", s, e))
        elif len(token) <= 64:
            if len(known) >= REMEMBERED:
                known.clear()
            known.add(token)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2000) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format.

    ``most`` bounds the sample of strings that each automaton is inferred from. Spans are code points, end exclusive; those that the automata add are of kind
    ``format``. Nulls count as empty texts, repeated rows and null ids are rows of their own, other columns are not read. An empty table gives an empty
    result. Where few strings are labelled (below ``learn``'s ``least``), nothing is added."""
    held = docs.sparkSession.sparkContext.broadcast(grammar_of(docs, text_col, most))  # at most as many states as the sample has characters
    known: set[str] = set()  # a task's own copy

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format")}
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = all_spans(text or "", held.value, known)
            own = [x for x in found if x[0] != "format"]
            out["doc_id"].append(doc)
            for n, kind in enumerate(KINDS):
                out[f"n_{kind}"].append(sum(k == kind for k, _, _ in found))
            out["base_sha256"].append(hashlib.sha256(joined(own).encode()).hexdigest())
            out["spans"].append(joined(found))
        return out

    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")


def held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2000, parts: int = 4) -> DataFrame:
    """How the automata do on credentials whose labels they don't see: kind, n, accepted (long). They are inferred from the documents whose crc32 of the id, modulo ``parts``, is
    not 0; in the others, every value that a base rule labels is scored as a bare token (its kind's row), and so is every candidate beside them (kind ``word``).
    Accepted of a labelled kind to its n is recall; accepted of the labelled kinds to all accepted is precision, at least, as an unlabelled token may be a
    credential too. Each occurrence counts. Null texts are empty, null ids are learned from; kinds that don't occur, as in an empty table, have rows of 0."""
    rest = F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")), F.lit(parts)), F.lit(1))
    held = docs.sparkSession.sparkContext.broadcast(grammar_of(docs.where(rest != 0), text_col, most))
    kinds = (*KINDS[:3], "word")

    def run(batches):
        n, taken = Counter(), Counter()
        for piece in slices(batches, "text", 2048, 2_000_000):
            for text in piece.column(0).to_pylist():
                own = base(text or "")
                for kind, value in [(k, v) for k, _, _, v in own] + [("word", text[s:e]) for s, e in tokens(text or "", own)]:
                    n[kind] += 1
                    taken[kind] += held.value.accepts(value)
        yield pa.RecordBatch.from_pydict({"kind": list(kinds), "n": [n[k] for k in kinds], "accepted": [taken[k] for k in kinds]})

    small_batches(docs.sparkSession)
    counts = docs.where(rest == 0).select(F.col(text_col).alias("text")).mapInArrow(run, "kind string, n long, accepted long")
    none = docs.sparkSession.createDataFrame([(k, 0, 0) for k in kinds], counts.schema)
    return counts.unionByName(none).groupBy("kind").agg(F.sum("n").alias("n"), F.sum("accepted").alias("accepted"))


def joined(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then by kind as listed."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))))


def mask(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with what lies under any span replaced; spans that overlap become one mark."""
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda x: x[1:]):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2000) -> DataFrame:
    """The documents with every found secret masked, all columns as they are; n_chars, where there is such a column, follows. Null texts stay null; repeated rows stay. An
    empty table gives an empty result."""
    held = docs.sparkSession.sparkContext.broadcast(grammar_of(docs, text_col, most))
    known: set[str] = set()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        new = [t and mask(t, all_spans(t, held.value, known)) for t in texts]
        columns = {f.name: batch.column(k) for k, f in enumerate(batch.schema)}
        columns[text_col] = pa.array(new, pa.string())
        if "n_chars" in columns:
            sizes = columns["n_chars"].to_pylist()
            columns["n_chars"] = pa.array([n if a == b else len(b) for n, a, b in zip(sizes, texts, new, strict=True)], columns["n_chars"].type)
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return map_rows(docs, run, text_col)
