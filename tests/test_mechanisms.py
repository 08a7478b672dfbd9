"""Folds, ranks, lookups, trees, lines, tables and signatures against plain Python, on odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from trackloom.functions import shown, text
from trackloom.operators import folds, groups, lookups, queues, ranks, tracks
from trackloom.plans import commands
from trackloom.sources import scratch, signatures
from trackloom.streaming import lines, queue, table


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ranks and trees


def test_numbered_and_running_over_groups_of_any_size(spark):
    rnd = random.Random(3)
    data = [(rnd.choice(["hot"] * 8 + ["a", None, "b"]), i, rnd.choice([None, 1, 5])) for i in range(500)]
    rnd.shuffle(data)
    df = spark.createDataFrame(data, "g string, n long, v long").repartition(7)
    want_place, want_sum, seen, total = [], [], {}, {}
    for g, n, v in sorted(data, key=lambda r: r[1]):
        want_place.append((g, n, v, seen.setdefault(g, 0)))
        want_sum.append((g, n, v, total.setdefault(g, 0)))
        seen[g] += 1
        total[g] += v or 0
    assert rows(ranks.numbered(df, ["g"], ["n"])) == sorted(want_place, key=repr)
    assert rows(ranks.running(df, ["g"], ["n"], "v")) == sorted(want_sum, key=repr)
    assert sorted(r.place for r in ranks.numbered(df, [], ["g", "n"]).collect()) == list(range(500))
    assert rows(ranks.numbered(df.limit(0), ["g"], ["n"])) == []


def test_entries_need_no_task_with_all_of_them(spark):
    units = spark.createDataFrame([("u", 0, True), ("v", 1, True), ("w", 2, False), ("x", 3, True)], "unit string, position long, loaded boolean")
    keyed = spark.createDataFrame([("u", "k"), ("v", "l"), ("x", "k")], "unit string, key string")
    out = groups.entries(units, keyed)
    assert rows(out) == [("u", 0, "group", "k"), ("v", 1, "single", "l"), ("w", 2, "single", None), ("x", 0, "group", "k")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    single = [i for i, line in enumerate(plan.splitlines()) if "SinglePartition" in line]
    assert single and all("HashAggregate(keys=[_part" in plan.splitlines()[i + 1] for i in single)  # one row for each partition, and nothing else


def test_preorder_lists_parents_before_children(spark):
    # 1(4(6), 2(3)), 7 alone; 5 has an unknown parent; 8 and 9 are a circle
    nodes = [(1, None, 0, True), (2, 1, 2, False), (3, 2, 0, True), (4, 1, 1, True), (6, 4, 0, True), (7, None, 0, True), (5, 99, 0, True), (8, 9, 0, True), (9, 8, 0, True)]
    df = spark.createDataFrame(nodes, "node long, parent long, ord int, named boolean")
    got = rows(ranks.preorder(df, "node", "parent", "ord", "named").select("root", "place", "node", "depth"))
    assert got == [(1, 0, 1, 0), (1, 1, 4, 1), (1, 2, 6, 2), (1, 3, 3, 2), (5, 0, 5, 0), (7, 0, 7, 0)]
    chain = spark.range(40).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(0).alias("ord"))
    assert rows(ranks.preorder(chain, "node", "parent", "ord").select("place", "node", "depth")) == sorted([(i, i, i) for i in range(40)], key=repr)
    assert rows(ranks.preorder(df.limit(0), "node", "parent", "ord")) == []


# folds


def plain_corrected(times, delay):
    out, last = [], 0
    for t in times:
        if t is None:
            out.append(None)
            continue
        now = t + delay
        if delay < 0 and last != 0 and now < last:
            delay += last - now
            now = last
        if now < 0:
            out.append(None)
            continue
        last = now
        out.append(now)
    return out


@pytest.mark.parametrize("delay", [-40, 0, 25])
def test_corrected_times_carry_their_delay_on(spark, delay):
    rnd = random.Random(delay)
    data = [(k, i, rnd.choice([None, *range(0, 120, 3)]), "x") for k in ("a", "b", None) for i in range(60)]
    got = {(r.k, r.i): r.corrected for r in folds.corrected_times(spark.createDataFrame(data, "k string, i int, t long, corrected string").repartition(3), "k", ["i"], "t", delay).collect()}
    want = {(k, i): x for k in ("a", "b", None) for i, x in enumerate(plain_corrected([t for q, _, t, _ in data if q == k], delay))}
    assert got == want
    assert rows(folds.corrected_times(spark.createDataFrame([], "k string, i int, t long"), "k", ["i"], "t", 0)) == []


def plain_least(blocks, videos, probe, reach):
    active, least, first = dict(videos), {}, None
    for track, t in blocks:
        if t is None:
            continue
        first = t if first is None else first
        if t - first >= probe:
            break
        if track not in active:
            continue
        least[track] = min(least.get(track, t), t)
        if active[track] and t - least[track] < reach:
            continue
        del active[track]
    return least


def test_least_times_end_early(spark):
    rnd = random.Random(4)
    videos, data, want = {"v": True, "w": True, "a": False, "s": False}, [], []
    for unit in range(40):
        at, blocks = rnd.randint(0, 5), []
        for _ in range(rnd.randint(0, 40)):
            at += rnd.randint(-3, 6)
            blocks.append((rnd.choice(["v", "w", "a", "s", None]), rnd.choice([at, at, at, None])))
        data += [(unit, i, track, t) for i, (track, t) in enumerate(blocks)]
        want += [(unit, track, t) for track, t in plain_least(blocks, videos, 50, 8).items()]
    df = spark.createDataFrame(data, "unit int, seq int, track string, t long").repartition(4)
    assert rows(folds.least_times(df, "unit", "track", "seq", "t", F.col("track").isin("v", "w"), 50, 8)) == sorted(want, key=repr)


# lookups


@pytest.mark.parametrize("most", [0, 50])
def test_catalogue_by_id_then_by_longest_prefix(spark, most):
    entries = spark.createDataFrame([("A_AAC", True, "AAC"), ("A_AAC/MPEG4", True, "AAC 4"), ("A_MP3", False, "MP3"), ("A", True, "any"), ("", False, "none")], "id string, prefix boolean, name string")
    codes = spark.createDataFrame([("A_AAC",), ("A_AAC/MPEG4/LC",), ("A_AAC/x",), ("A_MP3",), ("A_MP3/y",), ("B",), (None,), ("",), ("A_AAC",)], "code string")
    got = rows(lookups.catalogued(codes, "code", entries, most).select("code", "name"))
    assert got == sorted([("A_AAC", "AAC"), ("A_AAC/MPEG4/LC", "AAC 4"), ("A_AAC/x", "AAC"), ("A_MP3", "MP3"), ("A_MP3/y", "any"), ("B", None), (None, None), ("", "none"), ("A_AAC", "AAC")], key=repr)
    assert rows(lookups.catalogued(codes, "code", entries.limit(0), most).select("name").distinct()) == [(None,)]


@pytest.mark.parametrize(("low", "high"), [(190, 210), (100, 100), (40, 60), (95, 300)])
def test_band_pairs_equal_all_pairs_tried(spark, low, high):
    rnd = random.Random(low)
    data = [(rnd.choice(["k", "l", None]), i, rnd.choice([None, 0, -4, *range(1, 60), 10**9, 2 * 10**9 + 3])) for i in range(150)]
    df = spark.createDataFrame(data, "k string, id int, size long")
    want = [(k, i, j) for k, i, a in data for q, j, b in data if k and k == q and i != j and a and b and a > 0 and b > 0 and a * low <= 100 * b <= a * high]
    assert rows(lookups.band_pairs(df, ["k"], "size", low, high, "id")) == sorted(want, key=repr)
    assert "NestedLoop" not in lookups.band_pairs(df, ["k"], "size", low, high, "id")._jdf.queryExecution().executedPlan().toString()


def test_hidden_layers(spark):
    schema = "unit int, place int, pid int, codec string, profile int, base_pid int, width int, height int, keep boolean"
    data = [
        (1, 0, 10, "hevc", None, None, 3840, 2160, True), (1, 1, 11, "hevc", 7, None, 1920, 1080, True),
        (2, 0, 10, "hevc", None, None, 1920, 1080, True), (2, 1, 11, "hevc", 4, None, 960, 540, True), (2, 2, 12, "avc", 4, None, 960, 540, True),
        (3, 0, 10, "hevc", 7, 11, 10, 10, True), (3, 1, 11, "avc", None, None, 5, 5, True), (3, 2, 13, "avc", 7, 13, 1920, 1080, True),
        (4, 0, 10, "hevc", 7, None, 1920, 1080, True), (5, 0, 1, "x", 7, 2, 1, 1, False), (5, 1, 2, "x", None, None, None, None, True),
    ]
    got = {(r.unit, r.place) for r in lookups.hidden_layers(spark.createDataFrame(data, schema)).where("hidden").collect()}
    assert got == {(1, 1), (2, 1), (3, 0)}


LANGUAGES = [(0, "eng", "English (en; eng)"), (1, "fre", "French (fr; fre)"), (2, "mis", "Uncoded (note) (x)"), (3, "en", "Wrong"), (4, "mul", "Multiple")]


def test_aliases_and_presets(spark):
    names = lookups.aliases(spark.createDataFrame(LANGUAGES, "place int, code string, label string"))
    said = spark.createDataFrame([(" ENG",), ("french",), ("French (fr; fre)",), ("en",), ("Klingon ",), (None,), ("Uncoded (note)",)], "language string")
    got = rows(lookups.by_alias(said, "language", names))
    assert got == sorted([(" ENG", "en", "eng"), ("french", "fr", "fre"), ("French (fr; fre)", "fr", "fre"), ("en", "en", "eng"), ("Klingon ", "Klingon", "Klingon"), (None, None, None), ("Uncoded (note)", "mis", "mis")], key=repr)
    presets = spark.createDataFrame([("audio", "eng", " Stereo\n\nSTEREO \nCommentary\n"), ("audio", "fre", None)], "kind string, code string, names string")
    tracks = spark.createDataFrame([("audio", "English"), ("audio", "fr"), ("video", "en"), ("audio", None)], "kind string, language string")
    assert rows(lookups.preset_names(tracks, presets, names)) == sorted([("audio", "English", ["Stereo", "Commentary"]), ("audio", "fr", []), ("video", "en", []), ("audio", None, [])], key=repr)


CODES = [("eng", None, "en", "English"), ("fra", "fre", "fr", "French"), ("und", None, None, "Undetermined"), ("zho", "chi", "zh", "Chinese")]


def test_languages_are_resolved_in_order(spark):
    codes = spark.createDataFrame(CODES, "code string, bib string, alpha2 string, name string")
    data = [("en-us", "fre"), ("", " FRE "), (None, "fra"), ("not a tag", "xxx"), ("ja-JP", "eng"), ("ZH-hant-hk", None), ("z", None), ("x-own", "eng"), ("fre-x-Foo", None), ("en-a-bbb-us", None)]
    df = spark.createDataFrame(data, "tag string, iso string")
    got = {(r.tag, r.iso): tuple(r)[2:] for r in lookups.resolved_language(df, "tag", "iso", codes).collect()}
    english, french, none = ("eng", None, "en"), ("fra", "fre", "fr"), ("und", None, None)
    assert got == {
        ("en-us", "fre"): (*english, "en-US", "English"), ("", " FRE "): (*french, None, "French"), (None, "fra"): (*french, None, "French"), ("not a tag", "xxx"): (*none, None, "Undetermined"),
        ("ja-JP", "eng"): (*none, "ja-JP", None), ("ZH-hant-hk", None): ("zho", "chi", "zh", "zh-Hant-HK", "Chinese"), ("z", None): (*none, None, "Undetermined"), ("x-own", "eng"): (*none, "x-own", None),
        ("fre-x-Foo", None): (*french, "fre-x-foo", "French"), ("en-a-bbb-us", None): (*english, "en-a-bbb-us", "English"),
    }
    assert {tuple(r)[2:] for r in lookups.resolved_language(df.where("tag = 'z'"), "tag", "iso", codes, "eng").collect()} == {(*english, None, "English")}


# units apart, text


def test_a_bad_unit_stops_no_other(spark):
    df = spark.createDataFrame([("u", 0, "5"), ("u", 1, "7"), ("v", 0, "x"), ("v", 1, None), ("w", 0, None), ("z", 0, "-1")], "unit string, ord int, size string")
    checks = {"no size": F.col("size").isNotNull(), "no number": F.col("size").rlike("^-?[0-9]+$")}
    make = lambda good: good.groupBy("unit").agg(F.sum(F.col("size").cast("int")).alias("total")).where("total > 0")
    assert rows(queues.apart(df, "unit", "ord", checks, make)) == [("u", 12, None), ("v", None, "no number"), ("w", None, "no size"), ("z", None, None)]


def test_doubles_in_units(spark):
    data = [1234.5, 1000.0, 1005.0, 999.5, 512.0, 0.0, -1.0, None, float("inf"), float("nan"), 2.5e6, 1048577.0, 1e15]
    df = spark.createDataFrame([(x,) for x in data], "n double")
    shown = [r[0] for r in df.select(text.double_in_units(F.col("n"), "bps", "KMiGi")).collect()]
    assert shown == ["1.23Kibps", "1000bps", "1Kibps", "999.5bps", "512bps", "0bps", "", "", "", "", "2.5Mibps", "1.05Mibps", "1000000Gibps"]


def test_lists_are_trimmed_of_all_white_space(spark):
    df = spark.createDataFrame([("\tDE , fr﻿,, \n",)], "x string")
    assert df.select(text.language_list(F.col("x"))).first()[0] == ["de", "fr"]
    assert df.select(text.distinct_folded(F.array(*map(F.lit, ("B", "a", "b", "A"))))).first()[0] == ["B", "a"]


# streams


def drain(stream, checkpoint, sink):
    q = stream.writeStream.format("memory").queryName(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def test_lines_over_chunks_as_stream_and_as_table(spark, tmp_path):
    rnd = random.Random(5)
    raw = {"a": "Progress: 1%\rProgress: 20%\r\n\ndöne 日本\nno end".encode(), "b": b"\n\n\r", "c": b"x" * 50 + b"\xff\ny", "d": b""}
    chunks = []
    for k, data in raw.items():
        at, n = 0, 0
        while at < len(data) or n == 0:
            size = rnd.randint(1, 7)
            chunks.append((k, n, bytearray(data[at : at + size]), at + size >= len(data)))
            at, n = at + size, n + 1
    want = {k: [x.decode("utf-8", "replace") for x in data.replace(b"\r", b"\n").split(b"\n") if x] for k, data in raw.items()}
    got = {}
    for r in sorted(lines.split_lines(spark.createDataFrame(chunks, lines.CHUNKS).repartition(3), "program", "seq", "data").collect()):
        got.setdefault(r.program, []).append(r.text)
    assert got == {k: v for k, v in want.items() if v}
    for i in range(3):  # three batches
        spark.createDataFrame([c for c in chunks if c[1] % 9 // 3 == i and c[1] < 9] if i < 2 else [c for c in chunks if c[1] >= 6], lines.CHUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.CHUNKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = lines.lines(stream).writeStream.format("memory").queryName("told_lines").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    told = {}
    for r in sorted(spark.table("told_lines").collect()):
        told.setdefault(r.program, []).append(r.text)
    assert told == {k: v for k, v in want.items() if v}


def test_the_state_knows_of_silent_cancels(spark, tmp_path):
    events = [("d", 1, "enqueue", "a", None), ("d", 2, "enqueue", "b", None), ("d", 3, "cancel", "b", None), ("e", 4, "enqueue", "c", None), ("e", 5, "exited", "c", 0)]
    spark.createDataFrame(events, queue.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = queue.track(spark.readStream.schema(queue.EVENTS).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("changes_told").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(queue.live(spark, str(tmp_path / "cp"))) == [("d", "a", "merging")]


def test_upserts_replay_and_compact(spark, tmp_path):
    schema = spark.createDataFrame([], "file string, seq long, status string, progress int, error string").schema
    path = f"file://{tmp_path}/t"
    read = lambda: rows(table.current(spark, path, schema, "file", "seq"))
    assert read() == []
    one = spark.createDataFrame([("a", 1, "waiting", 0, None), ("b", 2, "waiting", 0, None), ("a", 3, "merging", None, None), (None, 9, "waiting", 0, None)], schema)
    two = spark.createDataFrame([("a", 4, None, 40, None), ("b", 5, "failed", None, "disk"), ("c", 6, "completed", 100, None)], schema)
    table.upsert(one, 0, path)
    assert read() == [("a", 3, "merging", 0, None), ("b", 2, "waiting", 0, None)]
    for _ in range(2):  # a batch that is run again
        table.upsert(two, 1, path)
    want = [("a", 4, "merging", 40, None), ("b", 5, "failed", 0, "disk"), ("c", 6, "completed", 100, None)]
    assert read() == want
    for _ in range(2):
        table.compact(spark, path, schema, "file", "seq")
        assert read() == want
    table.upsert(two, 1, path)  # even after it was compacted
    table.upsert(spark.createDataFrame([("a", 7, "completed", 100, None)], schema), 2, path)
    assert read() == [("a", 7, "completed", 100, None), *want[1:]]


def test_a_stream_is_merged_into_a_table(spark, tmp_path):
    schema = spark.createDataFrame([], "file string, seq long, status string").schema
    for n, status in enumerate(["waiting", "merging", "completed"]):
        spark.createDataFrame([("a", n, status), (f"f{n}", n, status)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table.upserting(stream, f"file://{tmp_path}/t", str(tmp_path / "cp")).awaitTermination()
    got = rows(table.current(spark, f"file://{tmp_path}/t", schema, "file", "seq"))
    assert [r[0] for r in got] == ["a", "f0", "f1", "f2"]


# sources


def test_signatures(spark, tmp_path):
    files = {"a.aac": b"ADIF....", "b.wmv": b"\x30\x26\xb2\x75" + b"x" * 99, "c.dat": b"RIFF1234CDXA", "d.avi": b"RIFF1234AVI ", "e.sup": b"SP", "f": b".R1M", "g": bytes.fromhex("b7d800203749da11a64e0007e95ead8d"), "h": b"", "i": b"S"}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rpartition("/")[2]: r.format for r in signatures.unsupported(spark, str(tmp_path)).collect()}
    assert got == {"a.aac": "aac", "b.wmv": "asf", "c.dat": "cdxa", "e.sup": "hdsub", "f": "unknown", "g": "unknown"}


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://somewhere:7077"

            class _jsc:
                sc = staticmethod(lambda: type("C", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isEmpty": staticmethod(lambda: True)}))}))

    with pytest.raises(ValueError):
        scratch.settled(type("D", (), {"sparkSession": Cluster}))


# what is shown, gates and flags


def test_descriptions_types_and_errors(spark):
    one = spark.range(1)
    null = F.lit(None).cast("string")
    get = lambda c: one.select(c).first()[0]
    assert get(shown.subtitle_description(F.lit(True), F.lit("SDH"), F.lit(""), F.lit(888))) == "Text SDH p888"
    assert get(shown.subtitle_description(F.lit(None).cast("boolean"), null, F.lit("UTF-8"), F.lit(None).cast("int"))) == "Image UTF-8"
    assert get(shown.described((null, F.lit("v")), (F.lit(1), null), (F.lit(1), F.lit("s")))) == ""
    assert get(shown.described((null, F.lit("v")))) == "" and get(shown.codec_shown(null, F.lit("A_AAC"))) == "A_AAC"
    assert [get(shown.value_by_type(F.lit(1536.0), F.lit(k), "B", {"video": ("K", 0), "attachment": ("K", 0)})) for k in ("video", "attachment", "audio")] == ["2KB", "1.5KB", "1.5KB"]
    assert [get(shown.font_type(F.lit(x))) for x in ("application/x-font-ttf", "text/plain")] == ["font/ttf", "text/plain"]
    heads = {b"OTTO..": "font/otf", b"\x00\x01\x00\x00": "font/sfnt", b"\x89PNG\r\n\x1a\n..": "image/png", b"\xff\xd8\xff": "image/jpeg", b"GIF89a": "image/gif", b"BM": "image/bmp", b"B": "application/octet-stream", b"": "application/octet-stream"}
    assert {raw: get(shown.guessed_type(F.lit(raw))) for raw in heads} == heads
    assert [get(shown.image_extension(F.lit(x))) for x in ("IMAGE/PJPEG", "image/x-icon", "font/otf")] == ["jpg", "ico", ""]
    assert get(shown.error_text(F.lit("timeout"), F.lit("?"), detail=F.lit("a {stage}"), budget_ms=F.lit(5), stage=null)) == "Reading took more than 5 ms at : a "
    assert get(shown.error_text(F.lit("odd"), F.lit("raw"), detail=F.lit("d"))) == "raw"
    assert get(shown.clock_time(F.lit(86_399_999), "+01:00")) == "00:59:59" and get(shown.clock_time(F.lit(None).cast("long"), "UTC")) == "--:--:--"
    assert get(text.eta(F.lit(10.0), F.lit(50), F.lit("merging"))) == 10.0 and get(text.eta(F.lit(10.0), F.lit(50), F.lit("failed"))) is None
    assert [get(text.overridden_path(F.lit(o), F.lit("/in/a.mkv"), F.lit(f))) for o, f in (("/out", True), ("/out/", False), ("/out", False), ("/out", None))] == ["/out/a.mkv", "/out/a.mkv", "/out", "/out"]


def test_gates_and_flags(spark):
    data = [("u", 0, 1, None, "V"), ("u", 1, 1, "video", "V"), ("u", 2, None, "audio", "A"), ("u", 3, 2, "audio", ""), ("u", 4, 3, "audio", None), ("u", 5, 4, "audio", "A"), ("v", 0, 4, "audio", "A"), ("v", 1, 4, "audio", "B")]
    df = spark.createDataFrame(data, "unit string, pos int, number int, kind string, codec string")
    assert rows(tracks.gated(df, "unit", "pos", "number", "kind", "codec").select("unit", "pos")) == [("u", 5), ("v", 0)]
    data = [("u", "audio", 2, True, "true", "true"), ("u", "audio", 1, True, "false", "unspecified"), ("u", "audio", 0, False, "true", "true"), ("u", "video", 5, None, "true", "true"), ("u", "attachment", 6, True, "unspecified", "unspecified"), ("u", "subtitles", 7, True, "false", "true")]
    df = spark.createDataFrame(data, "unit string, kind string, place int, checked boolean, default_track string, forced string")
    got = {r.place: (r.default_track, r.forced) for r in tracks.unit_flags(df, "unit", "kind", "place", "checked").collect()}
    assert got == {2: ("false", "false"), 1: ("true", "false"), 0: ("true", "true"), 5: ("true", "true"), 6: ("unspecified", "unspecified"), 7: ("true", "false")}
    assert rows(tracks.unit_flags(df, "unit", "kind", "place", "checked", False, False)) == rows(df)


def test_units_are_dispatched_by_their_members(spark):
    schema = "unit string, output string, file string, file_index long, seq long, id long, type string, language string, track_name string, default_track string, forced string"
    row = lambda unit, file, index, seq: (unit, f"/o/{unit}", file, index, seq, seq, "video", "en", "", "unspecified", "unspecified")
    data = spark.createDataFrame([row("s", "s", 0, 0), row("m", "m", 0, 0), row("m", "n", 1, 0), row("h", "h", 0, 0)], schema)
    members = spark.createDataFrame([("s", "s"), ("m", "m"), ("m", "n"), ("h", "h"), ("h", "i")], "unit string, file string")
    want = rows(commands.arguments(data.where("unit = 's'"))) + rows(commands.arguments_of_many(data.where("unit <> 's'")))
    assert rows(commands.dispatched(data, members)) == sorted(want, key=repr)


def test_finished_and_group_state(spark):
    changes = spark.createDataFrame([("d", 1, "a", "merging"), ("d", 2, "a", "failed"), ("d", 3, "b", "completed")], queue.CHANGES)
    assert rows(queue.finished(changes)) == [("d", 2, "a", "failed"), ("d", 3, "b", "completed")]
    units = spark.createDataFrame([("g", "a", "a"), ("g", "a", "b"), ("h", "c", "c"), ("i", "d", "d")], "group string, root string, file string")
    selected = spark.createDataFrame([("b",), ("b",), ("c",)], "file string")
    items = spark.createDataFrame([("c", "waiting"), ("d", "failed")], "file string, status string")
    assert rows(queues.group_state(units, selected, items)) == [("g", True, True, True, False), ("h", False, True, False, True), ("i", False, False, True, False)]
