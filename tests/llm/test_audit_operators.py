"""Token counts, source divergence and the manifest against brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trackloom.llm import divergence, manifest, token_counts

FILE = public_tokenizers.path("byte_bpe_50k.json")


def key(rows):
    return sorted(map(repr, map(tuple, rows)))


# token counts


def plain_counts(texts, file=FILE):
    model = Tokenizer.from_file(file)
    return [len(model.encode(t or "", add_special_tokens=False).ids) for t in texts]


def odd_texts(rnd, n, most):
    bits = ["the ", "Hello", " world", "'s", "'re ", "''", " \n", "\n\n  ", "   ", "<|endoftext|>", "<|endof", "|>", "é", "ß日本語", "🙂", "12345", "!!", " -- ", "\t", "　", "\x1c", "a" * 40, "<", " <|endoftext|>x"]
    return ["".join(rnd.choices(bits, k=rnd.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (200, 40), (1 << 16, 1 << 9)])
def test_counts_equal_the_library_whatever_the_chunks(spark, chunk, overlap):
    rnd = random.Random(chunk)
    texts = [None, "", " ", "x" * 5000, " " * 3000, "ab " * 900 + "y" * 700 + " z" * 500, "<|endoftext|>" * 60, *odd_texts(rnd, 120, 300)]
    rows = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(rows, FILE, chunk=chunk, overlap=overlap).collect()}
    want = plain_counts(texts)
    assert got == {i: (len((t or "").encode()), n, n > 1024) for i, (t, n) in enumerate(zip(texts, want, strict=True))}


def test_counts_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    assert key(token_counts.count_tokens(rows, FILE).collect()) == key([(None, 3, 2, False), (1, 3, 2, False), (1, 3, 2, False), (1, 0, 0, False)])
    assert token_counts.count_tokens(rows.limit(0), FILE).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert token_counts.count_tokens(rows.limit(0), FILE).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(rows, FILE, chunk=10, overlap=5)


def test_a_tokenizer_without_provable_seams_encodes_whole_documents(spark):
    file = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Hello  World " * 50, "ÀB'S c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = Tokenizer.from_file(file)
    assert not token_counts.counter(file).by_words
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(rows, file, chunk=64, overlap=16).collect()} == {i: len(model.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_words_equal_the_library_on_each_character():
    count = token_counts.Counter(FILE)
    texts = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}'s" for c in [*range(1, 0x300), 0x1680, 0x2003, 0x2028, 0x4E00, 0x1F600]]
    assert count.counts(texts) == plain_counts(texts)
    assert count.counts(texts) == plain_counts(texts)  # from memory


# divergence


def plain_audit(rows, min_df=3, ranks=200):
    rows = [(lang or "", source or "", text or "") for lang, source, text in rows]
    words = [re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for _, _, t in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for (lang, source, _), w in zip(rows, words, strict=True):
        docs[lang].update(set(w))
        counts[lang, source].update(w)
        groups.add((lang, source))
    out = []
    for lang in {k for k, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_df]
        own = {s: counts[lang, s] for k, s in groups if k == lang}

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(sum(own.values(), Counter()))
        gap = lambda a, b: (a - b) * (a - b) // b
        for s in own:
            pairs = sorted((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s)
            told = sorted((-gap(p[s][t], q[t]), t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t])[:ranks]
            out += [(lang, s, part, o, -v, i + 1) for part, found in (("pair", pairs), ("term", told)) for i, (v, _, o) in enumerate(found)]
    return out


def odd_documents():
    rnd = random.Random(2)
    vocab = ["the", "The", "é", "É", "ab-cd", "x1y", "日本", "zeta", "q"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    rows = [(rnd.choice(["en"] * 5 + ["de", None, "", " x y"]), rnd.choice(["s1", "s2", "s3", "S é", None, ""]), rnd.choice([None, "", "12 34"]) if rnd.random() < 0.1 else " ".join(rnd.choices(vocab, weights, k=rnd.randint(1, 30)))) for _ in range(300)]
    return [*rows, rows[0], rows[0], ("en", "long", "the w " * 60_000), ("xx", "a", "rare once"), ("xx", "b", None), ("yy", "z", "one one one")]


@pytest.mark.parametrize(("most", "ranks"), [(1 << 21, 200), (40, 5)])
def test_audit_equals_brute_force_with_one_vocabulary_or_more(spark, most, ranks):
    rows = odd_documents()
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], "lang string, source string, text string, value int, term string").repartition(5)
    got = divergence.audit(table, most=most, ranks=ranks).select("lang", "source", "part", "item", "value", "rank").collect()
    assert key(got) == key(plain_audit(rows, ranks=ranks))


def test_task_documents_keep_who_is_in_enough_documents(spark):
    rows = [("en", "s", " ".join(w for w in "abcdefgh" if random.Random(f"{i}{w}").random() < 0.12)) for i in range(40)]
    table = spark.createDataFrame(rows, "lang string, source string, text string").repartition(9)
    often = Counter(w for _, _, t in rows for w in set(t.split()))
    got = divergence.vocabulary(divergence.task_sums(table, 3), 3, 4).collect()
    assert sorted((r.lang, r.term) for r in got) == sorted(("en", w) for w, n in often.items() if n >= 3)


def test_slices_meet_before_terms_become_rows(spark, monkeypatch):
    for name, value in (("TEXTS", 7), ("CHUNK", 3), ("ROW", 2), ("AT_ONCE", 5)):
        monkeypatch.setattr(divergence, name, value)
    rows = odd_documents()
    table = spark.createDataFrame(rows, "lang string, source string, text string").na.fill("").repartition(9)
    got = divergence.task_sums(table, 3).collect()
    terms = [Counter(), Counter()]
    for lang, source, text in rows:
        w = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        terms[0].update((lang or "", t, source or "") for t in w)
        terms[1].update(f"{lang or ''} {t}" for t in set(w))
    # a source's count of a term comes once, and a term once a level, however many slices have it
    assert sorted((r.lang, r.term, x["source"], x["count"]) for r in got if r.level is None for x in r.sources) == sorted((*k, n) for k, n in terms[0].items())
    assert sorted((r.level, t) for r in got if r.level for t in r.tokens) == sorted((k, t) for t, n in terms[1].items() for k in (1, 2, 3) if n >= k)
    assert max(len(r.sources) for r in got if r.level is None) == 2 and max(len(r.tokens) for r in got if r.level) == 3
    audited = divergence.audit(table, most=10).select("lang", "source", "part", "item", "value", "rank").collect()
    assert key(audited) == key(plain_audit(rows))


def test_vectors_equal_counters():
    texts = ["", " a B a", "b", "é-É a\tzz", "12", "zz zz zz "]
    names, doc, term, count = divergence.vectors(texts)
    got = [Counter({names[int(t)].as_py(): int(c) for d, t, c in zip(doc, term, count, strict=True) if d == i}) for i in range(len(texts))]
    assert got == [Counter(), Counter(a=2, b=1), Counter(b=1), Counter({"é": 1, "É": 1, "a": 1, "zz": 1}), Counter(), Counter(zz=3)]
    assert [len(x) for x in divergence.vectors([])] == [0, 0, 0, 0]


def test_audit_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(empty).count() == 0


# manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_manifest(rows, fan=2):
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest("".join(levels[-1][i : i + fan])) for i in range(0, len(levels[-1]), fan)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            a = i - i % fan
            out.append(("".join(level[a:i]), "".join(level[i + 1 : a + fan])))
            i //= fan
        return out

    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    held = [sorted(langs[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in order]
    trees = [tree([leaf(r) for r in rs]) for rs in held]
    upper = tree([t[-1][0] for t in trees])
    out = []
    for g, (rs, levels) in enumerate(zip(held, trees, strict=True)):
        for i, r in enumerate(rs):
            steps = path(levels, i) + path(upper, g)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            node = leaf((*r[:3], r[3] + 1, r[4])) if hit else leaf(r)
            for a, b in steps:
                node = digest(a + node + b)
            out.append((r[0], leaf(r), levels[-1][0], upper[-1][0], digest("".join(a + b for a, b in steps)), node, node == upper[-1][0]))
    return out


@pytest.mark.parametrize(("block", "fan"), [(4, 2), (256, 2), (9, 3)])
def test_manifest_equals_brute_force(spark, block, fan):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, *range(-5, 400)]) if rnd.random() < 0.3 else i, rnd.choice(["a", "b", None, ""]), rnd.choice(["en"] * 8 + ["de", None, "", "é"]), rnd.choice([None, 5, 2**63 - 1]), rnd.choice([None, "", "x", "yé" * 50])) for i in range(500)]
    rows += [rows[3]] * 20 + [(9999, None, "en", 1, "long " * 100_000)]
    table = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string").repartition(5)
    assert key(manifest.manifest(table, fan=fan, block=block).collect()) == key(plain_manifest(rows, fan))


def test_manifest_of_few_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert manifest.manifest(spark.createDataFrame([], schema)).count() == 0
    one = [(5, "a", None, 1, None)]
    assert key(manifest.manifest(spark.createDataFrame(one, schema)).collect()) == key(plain_manifest(one))
    with pytest.raises(ValueError):
        manifest.manifest(spark.createDataFrame(one, schema), block=100)
