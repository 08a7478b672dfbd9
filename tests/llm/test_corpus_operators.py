"""Operators across documents against brute-force versions, and the pipeline against its stages done by hand."""

import hashlib
import random
import re
import unicodedata
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trackloom.llm import dedup, jaccard, packing, queries, repeats

DATA = Path("/root/testdata/sf0.001")


def docs(spark, texts, ids=None):
    return spark.createDataFrame(list(zip(ids or range(len(texts)), texts)), "doc_id long, text string")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# exact copies


def test_exact_dedup_equals_brute_force(spark):
    texts = ["A b", "a B", None, "", "É", "é", "x" * 100_000, "X" * 100_000, "a b"]
    got = {r.doc_id: r for r in dedup.exact_dedup(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        same = [k for k, u in enumerate(texts) if fold(u) == fold(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].digest) == (max(same), len(same), i == max(same), hashlib.sha256(fold(t).encode()).hexdigest())
    assert dedup.exact_dedup(docs(spark, [])).count() == 0


def test_digests_that_clash_are_told_apart(spark):
    texts = ["ab", "ac", "ab", "b", "AC", "ad"]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in dedup.exact_dedup(docs(spark, texts), digest=lambda t: t.substr(1, 1)).collect()}
    assert got == {0: (2, 2, False), 1: (4, 2, False), 2: (2, 2, True), 3: (3, 1, True), 4: (4, 2, True), 5: (5, 1, True)}


def test_state_lives_on_between_runs(spark, tmp_path):
    schema = "doc_id long, digest string, locator long"
    for k, rows in enumerate([[(1, "a", 1), (2, "b", 2)], [(3, "a", 3)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = {r.digest: (r.keep_id, r.group_size) for r in dedup.run_state(stream, f"file://{tmp_path}/cp").collect()}
        assert got == ({"a": (1, 1), "b": (2, 1)}, {"a": (3, 2), "b": (2, 1)})[k]


def test_drop_copies_keeps_columns_and_handles_repeated_ids(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, "A", 6), (None, "z", 7), (2, "z", 8), (3, None, 9), (4, "", 1)], "doc_id long, text string, kept int")
    got = dedup.drop_copies(rows)
    assert got.columns == rows.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "4"]


def test_copies_of_rows_that_share_ids_go_through_the_state(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice(["a", "A", "b", "", None, "c c", "C c", "x" * 50_000])) for _ in range(120)]
    got = dedup.drop_copies(spark.createDataFrame([(*r, k, k) for k, r in enumerate(rows)], "doc_id long, text string, row int, locator int").repartition(5)).collect()
    want = {}
    for i, t in rows:
        want[fold(t)] = max(want.get(fold(t), -1), -1 if i is None else i)
    assert {fold(r.text): r.doc_id if r.doc_id is not None else -1 for r in got} == want and len(got) == len(want)
    assert all((rows[r.row][0], rows[r.row][1] or "") == (r.doc_id, r.text or "") and r.row == r.locator for r in got)


def test_clashing_digests_are_located_in_the_given_rows(spark):
    texts = ["ab", "ac", "AB", "b", "ac"]
    rows = spark.createDataFrame([(7, t, 100 + k) for k, t in enumerate(texts)], "doc_id long, text string, at long")
    got = {r.locator: (r.group_size, r.kept) for r in dedup.exact_dedup(rows, row_col="at", digest=lambda t: t.substr(1, 1)).collect()}
    assert got == {100: (2, False), 101: (2, False), 102: (2, True), 103: (1, True), 104: (2, True)}


# near copies


def brute_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_classes(texts, ids):
    sets, root = brute_sets(texts), list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(top(i), []).append(ids[i])
    return [(ids[i], len(sets[i]), min(groups[top(i)])) for i in range(len(texts))]


def test_join_equals_brute_force(spark):
    random.seed(1)
    words = [f"w{k}" for k in range(400)]
    passage = [random.choice(words) for _ in range(60)]
    texts = [None, "", " \t", "Two words", "two WORDS", "a b c d", "é è", "É è"]
    for _ in range(8):
        base = [random.choice(words) for _ in range(random.randint(6, 150))]
        for _ in range(random.randint(2, 30)):
            copy = list(base)
            for _ in range(random.randint(0, max(1, len(base) // 25))):
                copy[random.randrange(len(copy))] = random.choice(words)
            texts.append(" ".join(copy))
    texts += [" ".join(passage + [random.choice(words) for _ in range(random.randint(0, 90))]) for _ in range(40)]
    ids = random.sample(range(1000), len(texts))
    for short in (16, 2):  # few lists and all that become rebased
        got = sorted(tuple(r) for r in jaccard.near_duplicates(docs(spark, texts, ids), short=short).collect())
        assert got == sorted(brute_classes(texts, ids))


def test_join_links_texts_one_word_apart_beside_a_larger_group(spark):
    texts = []
    for s in range(40):  # 10 and 9 shingles that share 9; the group opens with 12 of their words, and is not similar to them
        w = [f"{s}w{k}" for k in range(14)]
        texts += [" ".join(w), " ".join(w[:13])] + [" ".join([*w[:12], f"{s}t", f"{s}c{i}"]) for i in range(6)]
    got = sorted(tuple(r) for r in jaccard.near_duplicates(docs(spark, texts)).collect())
    assert got == sorted(brute_classes(texts, range(len(texts))))


def test_join_links_sets_of_which_one_was_matched_on_its_dear_tokens(spark):
    texts = []
    for s in (452, 1094, 1847, 4388):  # 19 and 16 shingles that share 16, in prefixes one dear and one not; the smaller has six near copies
        w = [f"{s}w{k}" for k in range(23)]
        texts += [" ".join(w), " ".join(w[:20])] + [" ".join([f"{s}c{i}", *w[1:20]]) for i in range(6)]
    got = sorted(tuple(r) for r in jaccard.near_duplicates(docs(spark, texts), short=3).collect())
    assert got == sorted(brute_classes(texts, range(len(texts))))


def test_join_of_groups_whose_members_are_just_not_similar(spark):
    rng = random.Random(8)
    base = [f"b{k}" for k in range(34)]
    texts = []
    for i in range(300):  # one or two words changed somewhere: 25 to 29 of 30 shingles shared, some pairs are similar and most are not
        copy = list(base)
        for p in rng.sample(range(34), rng.choice((1, 1, 2))):
            copy[p] = rng.choice(("x", "y", f"n{i}"))
        texts.append(" ".join(copy[: rng.choice((34, 34, 33, 30))]))
    want = sorted(brute_classes(texts, range(len(texts))))
    for short in (16, 2):
        got = sorted(tuple(r) for r in jaccard.near_duplicates(docs(spark, texts), short=short).collect())
        assert got == want


def test_bounds_of_prefixes_hold_for_all_sizes():
    """Of sets of sizes n and m that are just similar, in the worst order of their tokens: the shared tokens within both prefixes."""
    for n in range(1, 330):
        for m in range(-(-80 * n // 100), n + 1):
            inter = -(-80 * (n + m) // 180)
            assert jaccard.similar(inter, n, m) and inter >= max(jaccard.needed(n), jaccard.needed(m))
            for part in (1, 7, 40):
                l = max(1, min(n * part // 100, m * (47 - part) // 100, jaccard.needed(m)))
                # all that is beyond either prefix is shared
                assert inter - max(jaccard.needed(n) - l, jaccard.needed(m) - l) >= l
            apart = n + m - 2 * inter
            for own, size in ((n, apart), (m, apart), (n, apart + 5), (m, 2 * apart + 3)):
                first, every = jaccard.prefixes_of_difference(size, own, own, False)
                for other in range(size, size + apart + 1):  # sizes of the other difference, from which the overlap follows
                    both = max(1, -(-(size + other - apart) // 2))
                    assert both > size or size - both + 1 <= first
                for other in range(max(1, size - apart), size + 1):
                    both = max(1, -(-(size + other - apart) // 2))
                    assert both > size or size - both + 1 <= every


def test_bounds_for_sets_similar_to_the_pivot():
    """x is similar to the pivot and y is not: the tokens that their differences share if x and y are similar, from the sizes of all three."""
    for n in range(1, 90):
        for q in range(-(-80 * n // 100), 100 * n // 80 + 1):
            for size in range(abs(n - q), (n + q) // 9 + 1, 2):
                first, every = jaccard.prefixes_of_difference(size, n, q, True)
                for m in range(-(-80 * n // 100), 100 * n // 80 + 1):
                    far = (m + q) // 9 + 1  # the least difference of a set of m that is not similar to the pivot
                    both = max(1, -(-(size + far - (n + m) // 9) // 2))
                    assert both > size or size - both + 1 <= first == every


def test_prefixes_follow_the_cost_of_candidates():
    rare, hot = np.ones(200), np.concatenate([np.ones(45), np.full(155, 4000.0)])
    assert jaccard.matches_wanted(200, hot) < jaccard.matches_wanted(200, rare) < jaccard.matches_wanted(200, np.full(200, 5.0))


def test_join_of_odd_rows(spark):
    same = "one two three four five six seven"
    rows = docs(spark, [same, same, same.upper(), None, None], [7, 7, None, 3, 3])
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.near_duplicates(rows).collect()) == [("3", 0, 3), ("3", 0, 3), ("7", 3, 7), ("7", 3, 7), ("None", 3, 7)]
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0


def test_shingle_hashes_separate_what_differs():
    assert len(jaccard.shingles("a b c d e f")) == 2
    assert jaccard.shingles("A\tB\x0bC") .tolist() == jaccard.shingles(" a b c\n").tolist() != jaccard.shingles("a bc").tolist()


# repeats


def brute_repeats(texts, length=100):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(raw[i : i + length])
        left = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


def corpus(rng):
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(60, 260))) for _ in range(12)]
    texts = ["".join(rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choice("abc") for _ in range(rng.randint(1, 150))) for _ in range(rng.randint(0, 6))) for _ in range(60)]
    return texts + [None, "", "a" * 99, "a" * 100, "a" * 450, "ab" * 300, texts[0], texts[3]]


def test_repeats_equal_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(random.Random(seed))
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs(spark, texts)).collect()}
        assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def common_passage(n):
    rng = random.Random(6)
    passage, own = "".join(rng.choice("abcdé ") for _ in range(260)), lambda: "".join(rng.choice("abcdefghij") for _ in range(90))
    return [own() + passage[rng.randint(0, 3) :] + own() for _ in range(n)]


def test_a_common_passage_is_dealt_to_all_parts_and_cut_right(spark):
    texts = common_passage(9000)
    table = docs(spark, texts).repartition(4)
    places = repeats.repeated_anchors(table, 100, 64).groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    packed = repeats.contexts(table.join(places, "doc_id").select("doc_id", "text", "places"), 100, 64)
    by_part = packed.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.length("sizes")).alias("n")).toPandas().n
    assert by_part.max() * 8 < by_part.sum()  # no part has an anchor's contexts of all documents
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(table).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_repeats_beside_short_texts_in_any_partition(spark):
    rnd = random.Random(6)
    long = "".join(rnd.choice("abcdefgh") for _ in range(2000))
    rows = spark.createDataFrame([(0, long), (1, None), (2, "short")], "doc_id long, text string").coalesce(1).union(spark.createDataFrame([(3, long)], "doc_id long, text string").coalesce(1))
    assert {r.doc_id: r.n_removed for r in repeats.remove_repeats(rows).collect()} == {0: 0, 1: 0, 2: 0, 3: 2000}
    assert all(x.dtype == y.dtype for x, y in zip(repeats.anchors(b""), repeats.anchors(long.encode()), strict=True))
    pool = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(60, 400))) for _ in range(25)]
    texts = [rnd.choice([None, "", "tiny"]) if rnd.random() < 0.3 else "".join(rnd.choices(pool, k=rnd.randint(1, 4))) for _ in range(80)]
    want = brute_repeats(texts)
    for parts in (1, 2, 7):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs(spark, texts).repartition(parts)).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_repeats_across_the_seams_of_a_very_long_text(spark):
    rnd = random.Random(8)
    text = rnd.randbytes(900_000).hex()  # over a megabyte
    passage = text[repeats.CHUNK - 700 : repeats.CHUNK + 900]
    other = "x" * 99 + passage + "y" * 50 + text[100:350]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.remove_repeats(docs(spark, [text, other, None])).collect()}
    assert got == {0: (0, 0), 1: (len(passage) + 250, 2), 2: (0, 0)}


def test_repeats_with_repeated_and_missing_ids(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abc") for _ in range(150))
    got = sorted((str(r.doc_id), r.n_removed) for r in repeats.remove_repeats(docs(spark, [text, text, text], [5, 5, None])).collect())
    assert got == [("5", 150), ("5", 150), ("None", 0)]
    assert repeats.remove_repeats(docs(spark, [])).count() == 0


def test_streamed_statistics_equal_direct_comparison():
    rng = random.Random(4)
    pool = [bytes(rng.choice(b"ab") for _ in range(40)) for _ in range(4)]
    distinct = list({b"".join(rng.choice(pool) for _ in range(3))[: rng.randint(100, 120)]: 0 for _ in range(40)})
    order, group = repeats.same_strings(distinct, 100)
    joined = b"".join(c + b"\x00" for c in distinct)
    strings = [joined[i : i + 100] for i in order]
    full = [len(s) == 100 and b"\x00" not in s for s in strings]
    own = {}
    for s, g, ok in zip(strings, group.tolist(), full):
        if ok:
            assert own.setdefault(s, g) == g
    assert len(set(own.values())) == len(own)


# SQL


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = queries.QUERIES[name](spark, str(DATA))
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want))


# the pipeline


def test_near_copies_go_by_row_where_ids_repeat(spark):
    long = " ".join(f"w{k}" for k in range(60))
    table = spark.createDataFrame([(3, long, 1, 2, 3), (9, long, 1, 2, 3), (9, "an unrelated text of six words", 1, 2, 3), (None, long + " more", 1, 2, 3), (None, None, 1, 2, 3)], "doc_id long, text string, gone int, row int, stay int")
    got = corpus_pipeline.near_copies(spark, table, "")
    assert got.columns == table.columns
    assert sorted((str(r.doc_id), (r.text or "")[:2]) for r in got.collect()) == [("3", "w0"), ("9", "an"), ("None", "")]
    same = table.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    for step in (corpus_pipeline.near_copies, corpus_pipeline.exact_copies, corpus_pipeline.secrets):
        assert step(spark, same, "").columns == table.columns
    assert corpus_pipeline.near_copies(spark, same.where("false"), "").count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
def test_pipeline_against_its_stages_by_hand(spark):
    given = spark.read.parquet(f"{DATA}/documents.parquet").toPandas().sort_values("doc_id")
    rows = [(i, t) for i, t in zip(given.doc_id.tolist(), given.text.tolist()) if any(unicodedata.category(c)[0] == "L" for c in t or "")]
    last = {fold(t): i for i, t in rows}
    rows = [(i, t) for i, t in rows if last[fold(t)] == i]
    stays = {i for i, _, c in brute_classes([t for _, t in rows], [i for i, _ in rows]) if i == c}
    got = corpus_pipeline.run(spark, str(DATA)).toPandas()
    assert set(got.doc_id) == stays
    assert (got.sort_values(["doc_id", "start"]).groupby("doc_id").length.sum() == got.groupby("doc_id").doc_tokens.max()).all()
    assert (got.groupby("sequence_id").length.sum().sort_index()[:-1] == 1024).all()
    e = packing._encoder()
    clean = [(i, t) for i, t in rows if i in stays and not re.search(r"(?i)password|passwd|secret|token|api_?key|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/_=-]{16}", t)]
    whole = got.groupby("doc_id").doc_tokens.max()
    assert all(whole[i] == len(e.encode(t)) + 1 for i, t in clean) and clean
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_copies", "near_copies", "secrets", "packed"]


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
def test_a_second_run_leaves_the_first_result_readable(spark):
    first = corpus_pipeline.run(spark, str(DATA))
    second = corpus_pipeline.run(spark, str(DATA))
    digests = lambda df: sorted(map(tuple, df.select("doc_id", "start", "length", "ids_crc32").groupBy("doc_id").agg(F.max("start"), F.sum("length")).collect()))
    assert digests(first) == digests(second) != []
