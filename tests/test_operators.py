from pyspark.sql import functions as F

from trackloom.functions import text
from trackloom.operators import groups, joins, tracks
from trackloom.plans import commands
from trackloom.sources import discovery
from trackloom.streaming import queue


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_paths_and_drives(spark):
    assert one(spark, text.parent_dir(F.lit("/a/b\\c.mkv"))) == "/a/b"
    assert one(spark, text.parent_dir(F.lit("c.mkv"))) == ""
    assert one(spark, text.file_name(F.lit("/a/b\\c.mkv"))) == "c.mkv"
    assert [one(spark, text.drive_key(F.lit(p))) for p in ("c:\\x", "\\\\srv\\share\\x", "/home/x")] == ["C:", "\\\\SRV\\SHARE", "default"]


def test_quoting_and_clocks(spark):
    assert [one(spark, text.shell_quoted(F.lit(p))) for p in ("", "plain", "a b", 'a"b')] == ['""', "plain", '"a b"', '"a\\"b"']
    assert one(spark, text.clock_ns(F.lit(3_661_000_000_007))) == "01:01:01.000000007"
    assert one(spark, text.clock_ms(F.lit(360_000_000))) == "100:00:00"
    assert one(spark, text.clock_ms(F.lit(-1))) == "--:--:--"
    assert one(spark, text.eta(F.lit(30.0), F.lit(25))) == 90.0
    assert one(spark, text.eta(F.lit(30.0), F.lit(0))) is None


def test_languages(spark):
    assert one(spark, text.display_language(F.lit(""), F.lit(None).cast("string"), F.lit("fre"))) == "fre"
    assert one(spark, text.equivalent_codes(F.lit("FRA"), F.lit("fre"), F.lit("fra"))) == ["fra", "fre"]
    assert one(spark, text.equivalent_codes(F.lit(""))) == ["und"]
    assert one(spark, text.language_list(F.lit(" EN, ,fr"))) == ["en", "fr"]
    assert one(spark, text.language_list(F.lit(" , "))) is None


def test_selection(spark):
    rows = spark.createDataFrame([("video", ["eng"]), ("audio", ["jpn"]), ("audio", ["eng"]), ("chapters", ["und"]), ("other", ["eng"])], "kind string, codes array<string>")
    checked, languages = {"video": False, "audio": True, "chapters": True, "attachment": False}, {"video": "jpn", "audio": "jpn"}
    got = rows.where(tracks.selected(F.col("kind"), F.col("codes"), checked, languages)).collect()
    assert [(r.kind, r.codes[0]) for r in got] == [("video", "eng"), ("audio", "jpn"), ("chapters", "und")]


def test_unseen_rows_keep_null_keys(spark):
    a = spark.createDataFrame([(1, "a")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    assert sorted(r.v for r in joins.append_unseen(a, b, "k").collect()) == ["a", "y", "z"]


def test_covering_run(spark):
    points = spark.createDataFrame([("f", 0), ("f", 3), ("f", 5), ("g", 1)], "file string, chunk int")
    runs = spark.createDataFrame([("f", 1, 10), ("f", 4, 20)], "file string, first int, per int")
    got = joins.covering_run(points, runs, "file", "chunk", "first", ["per"]).collect()
    assert sorted((r.file, r.chunk, r.per) for r in got) == [("f", 0, None), ("f", 3, 10), ("f", 5, 20), ("g", 1, None)]


def test_roots_of_long_chain(spark):
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 40)], "child long, parent long")
    got = joins.roots(edges, "child", "parent").collect()
    assert {r.node: r.root for r in got} == dict.fromkeys(range(40), 0)


def test_signatures_and_buckets(spark):
    rows = spark.createDataFrame([("a", "eng"), ("a", "jpn"), ("b", "jpn"), ("b", "eng"), ("c", "eng")], "file string, lang string")
    got = {r.signature: (r.n_units, r.first_unit, r.grouped) for r in groups.buckets(groups.language_signature(rows, "file", F.col("lang")), "signature", "file").collect()}
    assert got == {"eng:1,jpn:1": (2, "a", True), "eng:1": (1, "c", False)}


ROW = "unit string, output string, file string, file_index int, seq long, type string, id long, language string, track_name string, default_track string, forced string"


def test_arguments(spark):
    rows = spark.createDataFrame(
        [
            ("o", "o.mkv", "x.avi", 0, 0, "audio", 1, "jpn", "", "unspecified", "false"), ("o", "o.mkv", "x.avi", 0, 1, "video", 0, "eng", "Main", "true", "unspecified"), ("o", "o.mkv", "x.avi", 0, 2, "attachment", 1, "", "", "unspecified", "unspecified"),
        ], ROW)
    block = ["-d", "0", "-a", "1", "--no-subtitles", "--language", "0:eng", "--track-name", "0:Main", "--default-track-flag", "0:1", "--language", "1:jpn", "--forced-display-flag", "1:0", "--no-chapters", "--no-global-tags", "--attachments", "1", "x.avi"]
    assert commands.arguments(rows).first().argv == ["-o", "o.mkv", *block, "--track-order", "0:1,0:0"]
    more = spark.createDataFrame([("o", "o.mkv", "y.avi", 1, 0, "video", 4, "", "", "unspecified", "unspecified"), ("o", "o.mkv", "y.avi", 1, 1, "chapters", 0, "", "", "unspecified", "unspecified")], ROW)
    other = ["-d", "4", "--no-audio", "--no-subtitles", "--no-global-tags", "--no-attachments", "y.avi"]
    both = rows.unionByName(more)
    assert commands.arguments_of_many(both).first().argv == ["-o", "o.mkv", *block, *other, "--track-order", "0:0,1:4,0:1"]
    placed = both.withColumn("place", F.when(F.col("file") == "y.avi", 1).otherwise(F.col("seq") * 2))
    assert commands.arguments_of_many(placed).first().argv[-2:] == ["--track-order", "0:1,1:4,0:0"]
    assert one(spark, commands.command_text(F.lit("/a b/tool"), F.array(F.lit("-o"), F.lit('x"y'))).alias("x")) == '"/a b/tool" -o "x\\"y"'


def test_sizes_versions_and_progress(spark):
    sizes = {0: "0B", 1024: "1024B", 1025: "1KB", 1536: "1.5KB", 1 << 20: "1024KB", (1 << 20) * 5 // 4: "1.25MB", 5 << 40: "5TB", -1: ""}
    assert {n: one(spark, text.in_units(F.lit(n).cast("long"), "B")) for n in sizes} == sizes
    assert one(spark, text.in_units(F.lit(1999).cast("long"), "bps", "KMi", 1)) == "2Kibps" and one(spark, text.in_units(F.lit(1999).cast("long"), "B", "K", 0)) == "2KB"
    assert [one(spark, text.frame_rate(F.lit(n))) for n in (41708333, 40000000, 0)] == ["23.976fps", "25fps", None]
    assert [one(spark, text.sample_rate(F.lit(n))) for n in (48000, 44100)] == ["48kHz", "44.1kHz"]
    assert [one(spark, text.progress(F.lit(x))) for x in (" Progress: 42% ", "Progress:7", "Progress: %", "other 3%")] == [42, 7, None, None]
    versions = {("v1.2.0", "1.1.9"): True, ("1.2", "1.2.0"): False, ("2", "10.0"): False, ("1.0.1", "1.0"): True, ("1.x.3", "1.2"): True}
    assert {v: one(spark, text.newer(F.lit(v[0]), F.lit(v[1]))) for v in versions} == versions


def test_moves_edits_and_free_numbers(spark):
    rows = spark.createDataFrame([("f", i, c) for i, c in enumerate("abcd")], "file string, seq long, name string")
    for a, z, want in ((0, 2, "bcad"), (3, 1, "adbc"), (1, 1, "abcd"), (0, 9, "abcd")):
        moves = spark.createDataFrame([("f", a, z)], "file string, from_place long, to_place long")
        assert "".join(r.name for r in tracks.moved(rows, "file", "seq", moves).orderBy("seq").collect()) == want
    edits = spark.createDataFrame([("f", 1, "X"), ("f", 2, None), ("g", 0, "Y")], "file string, seq long, name string")
    assert [r.name for r in tracks.edited(rows, edits, ["file", "seq"], ["name"]).orderBy("seq").collect()] == ["a", "X", "c", "d"]
    used = spark.createDataFrame([("a", 0), ("a", 1), ("a", 3), ("b", 2), ("b", 2)], "k string, n long")
    assert sorted(map(tuple, tracks.first_free(used, "k", "n").collect())) == [("a", 2), ("b", 0)]


def test_roots_of_very_long_chains_and_circles(spark):
    chain = [(i, i - 1) for i in range(1, 1000)]
    circle, tail = [(2000 + i, 2000 + (i + 1) % 7) for i in range(7)], [(1000 + i, 1001 + i) for i in range(299)] + [(1299, 2003)]
    got = {r.node: r.root for r in joins.roots(spark.createDataFrame(chain + circle + tail, "child long, parent long"), "child", "parent").collect()}
    assert got == dict.fromkeys(range(1000), 0) | dict.fromkeys([*range(2000, 2007), *range(1000, 1300)], 2000)


def test_listing(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("b.MKV", "a.mp4", "notes.txt", "deep/c.mkv"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r.name for r in discovery.listed(spark, str(tmp_path)).collect()) == ["a.mp4", "b.MKV"]
    named = [str(tmp_path / "b.MKV"), str(tmp_path / "missing"), str(tmp_path / "deep"), str(tmp_path / "notes.txt")]
    assert [(r.input, r.name) for r in discovery.listed(spark, named).orderBy("input", "path").collect()] == [(0, "b.MKV"), (2, "c.mkv")]
    found, held = discovery.listed(spark, str(tmp_path)), discovery.listed(spark, named)
    assert [r.name for r in discovery.unseen(found, held).collect()] == ["a.mp4"]
    assert sorted(r.name for r in discovery.listed(spark, str(tmp_path), deep=True).collect()) == ["a.mp4", "b.MKV", "c.mkv"]


def test_queue_stream(spark, tmp_path):
    events = [
        ("C:", 1, "enqueue", "x", None), ("C:", 2, "enqueue", "y", None), ("D:", 3, "enqueue", "z", None), ("C:", 4, "enqueue", "x", None), ("C:", 5, "enqueue", "w", None), ("C:", 6, "enqueue", "v", None), ("C:", 7, "cancel", "w", None),
        ("C:", 8, "exited", "x", 0), ("C:", 9, "cancel", "y", None), ("C:", 10, "exited", "y", 0), ("D:", 11, "exited", "z", 2), ("D:", 12, "exited", "z", 0), ("C:", 13, "enqueue", "x", None),
    ]
    spark.createDataFrame(events, queue.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = queue.track(spark.readStream.schema(queue.EVENTS).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.seq, r.file, r.status) for r in spark.table("changes").collect())
    assert got == [
        (1, "x", "merging"), (2, "y", "waiting"), (3, "z", "merging"), (5, "w", "waiting"), (6, "v", "waiting"), (8, "x", "completed"), (8, "y", "merging"), (10, "v", "merging"), (10, "y", "cancelled"), (11, "z", "failed"), (13, "x", "waiting"),
    ]
    assert {(r.file, r.status) for r in queue.snapshot(spark.table("changes")).collect()} >= {("v", "merging"), ("x", "waiting")}
