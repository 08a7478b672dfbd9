"""Queue tables, selections and normal forms on odd rows."""

from pyspark.sql import functions as F

from trackloom.functions import normal
from trackloom.operators import queues


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ITEM = "file string, status string, progress int, cancel_requested boolean"


def test_reconciled_covers_every_case(spark):
    items = spark.createDataFrame([("a", "merging", 5, False), ("b", "waiting", 6, True), ("c", "failed", 7, True), ("d", "failed", 8, True), ("e", "waiting", 9, None), ("f", "merging", 1, True)], ITEM)
    snap = spark.createDataFrame([("d", "waiting", 0), ("f", "merging", 2), ("new", "merging", 3)], "file string, status string, progress int")
    assert rows(queues.reconciled(items, snap)) == [
        ("a", "completed", 100, False), ("b", "cancelled", 6, True), ("c", "failed", 7, True), ("d", "waiting", 0, False),
        ("e", "completed", 100, False), ("f", "merging", 2, True), ("new", "merging", 3, False),
    ]
    assert rows(queues.reconciled(items.limit(0), snap.limit(0))) == []


def test_requeued_keeps_places(spark):
    items = spark.createDataFrame([("a", "failed", 5, 0), ("b", "waiting", 6, 1), ("c", "completed", 100, 2)], "file string, status string, progress int, ord int")
    asked = spark.createDataFrame([("c", 0), ("b", 1), ("z", 2), ("y", 3)], "file string, ord int")
    out = queues.requeued(items, asked).orderBy("place").select("file", "status", "progress")
    assert [tuple(r) for r in out.collect()] == [("a", "failed", 5), ("b", "waiting", 6), ("c", "waiting", 0), ("z", "waiting", 0), ("y", "waiting", 0)]


def test_flags_and_common_values_with_nulls(spark):
    items = spark.createDataFrame([("g", None, "x"), ("g", "failed", "x"), ("h", "waiting", None), ("h", "waiting", "y"), ("i", None, "")], "k string, status string, dir string")
    assert rows(queues.flags(items, "k")) == [("g", True, False, True), ("h", False, True, False), ("i", False, False, False)]
    assert rows(items.groupBy("k").agg(queues.common_value(F.col("dir")))) == [("g", "x"), ("h", None), ("i", None)]


def test_inputs_without_picked_tracks_take_no_number(spark):
    members = spark.createDataFrame([("u", "u", 0), ("u", "v", 1), ("u", "w", 2), ("s", "s", 0), ("t", "t", 0), ("n", "n", 0)], "unit string, file string, ord int")
    picked = spark.createDataFrame([("v",), ("w",), ("w",), ("s",), ("t",)], "file string")
    items = spark.createDataFrame([("t", "merging"), ("s", "failed")], "file string, status string")
    out = queues.unit_inputs(members, picked, items).select("unit", "file", "form", "file_index")
    assert rows(out) == [("s", "s", "single", 0), ("u", "v", "multi", 0), ("u", "w", "multi", 1)]


def test_removal_and_flips(spark):
    merges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), (None, "d")], "s string, t string")
    gone = spark.createDataFrame([("b",), ("b",), (None,)], "f string")
    assert rows(queues.without_files(merges, gone, "s", "t")) == [("c", "d"), (None, "d")]
    one = spark.range(1).select(queues.flipped(F.array(*map(F.lit, "xyz")), F.array(*map(F.lit, "yw"))).alias("f"), queues.first_match(F.array().cast("array<string>"), lambda x: x == "a").alias("m"))
    assert rows(one) == [(["x", "z", "w"], None)]


def test_custom_order_without_a_list(spark):
    t = spark.createDataFrame([("k", "a", 0, ["c", "a"]), ("k", "b", 1, ["c", "a"]), ("k", "c", 2, ["c", "a"]), ("m", "b", 1, None), ("m", "a", 0, None)], "k string, v string, n int, own array<string>")
    assert rows(queues.in_custom_order(t, "k", F.col("own"), "v", ["n"]).select("k", "place", "v")) == [("k", 0, "c"), ("k", 1, "a"), ("k", 2, "b"), ("m", 0, "a"), ("m", 1, "b")]


def test_writing_apps(spark):
    cases = {
        "mkvmerge v9.0.1 ('x') 64bit": "mkvmerge 9.0.1", "Lavf 58.0.0.0": "lavf 58.0", "AVI-Mux GUI 1.17.8.3, x": "avimuxgui 1.17.8.3", "app": "app", "": "", "app v": "app v",
        "app 1.256": "app 1.256", "app 7": "app 7.0", "A  B 3": "a 3.0", "app 1..2": "app 1.0.2", "app 1.2.3.4.5": "app 1.2.3.4", "app 1.99999999999999999999": "app 1.99999999999999999999", None: None,
    }
    got = spark.createDataFrame([(c,) for c in cases], "raw string").select("raw", normal.writing_app(F.col("raw"))).collect()
    assert {r[0]: r[1] for r in got} == cases


def test_numbers_at_their_limits(spark):
    n = spark.createDataFrame([(0, 0), (2**62, 1), (-1, -5), (None, None)], "a long, b long")
    got = n.select(normal.ticks_ns(F.col("a")), normal.frame_ns(F.lit(3), F.col("b")), normal.date_2001(F.col("a")), normal.budget_ms(F.col("b"))).collect()
    assert [r[0] for r in got] == [0, (2**64 - 1) // 45, -22222, None] and [r[1] for r in got] == [None, 3 * 10**9, None, None]
    assert got[0][2] == "2001-01-01T00:00:00Z" and got[2][2] == "2000-12-31T23:59:59Z" and got[3][2] is None
    assert [r[3] for r in got] == [100, 100, 100, None]


def test_codes_and_siblings(spark):
    codes = {"avc1": "AVC1", "ac3 ": "AC3 ", "\x00mp4a": "MP4A", "mp4": None, "éab": "éAB", None: None}
    got = spark.createDataFrame([(c,) for c in codes], "c string").select("c", normal.fourcc(F.col("c"))).collect()
    assert {r[0]: r[1] for r in got} == codes
    files = spark.createDataFrame([("/d/a.idx",), ("/d/a.Sub",), ("/d/a.SUB",), ("/d/b.IDX",), ("/e/a.sub",), ("/d/b.sUb",), (None,)], "p string")
    assert rows(normal.with_bitmaps(files, "p")) == [("/d/a.idx", "/d/a.SUB"), ("/d/b.IDX", None)]
