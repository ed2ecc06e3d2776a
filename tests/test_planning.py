import datetime as dt

import pytest
from pyspark.sql import functions as F

from loupe.operators import progress, resolve, timeline
from loupe.session import Scratch


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_chunks_and_durations(spark):
    got = timeline.chunks(spark.range(14).withColumnRenamed("id", "position")).groupBy("chunk").count().collect()
    assert sorted(map(tuple, got)) == [(0, 12), (1, 2)]
    assert value(spark, timeline.chunk_duration(F.lit(12), F.lit(4.0))) == 37.0
    assert value(spark, timeline.total_duration(F.lit(14), F.lit(2), F.lit(4.0))) == 44.0
    assert [value(spark, timeline.transition_offset(F.lit(i), F.lit(s))) for i, s in ((0, 4.0), (1, 4.0), (3, 1.5), (2, 0.4))] == [None, 3.0, 1.5, 0.0]
    assert [value(spark, timeline.fade(F.lit(d), 2.0)) for d in (-1.0, 0.0, 4.0, 100.0)] == [0.0, 0.0, 1.0, 2.0]
    assert value(spark, timeline.space_needed(F.lit(1), F.lit(1.0))) == 2 * 1024**3
    assert value(spark, timeline.space_needed(F.lit(1000), F.lit(4.0))) == 67 * 50 * 1024 * 1024 * 3 // 2
    assert value(spark, timeline.chunk_size(F.lit(10))) == 8 and value(spark, timeline.chunk_size(F.lit(2**40))) == 12
    assert [value(spark, timeline.pages(F.lit(n))) for n in (0, 1, 20, 21)] == [1, 1, 1, 2]


def test_first_chunk_is_sorted_by_size_and_stable(spark):
    rows = [(1, k, s) for k, s in enumerate([3, 9, None, 9, 5])]
    df = spark.createDataFrame(rows, "show long, position long, file_size long").withColumn("was", F.col("position"))
    got = timeline.first_chunk_by_size(df, "show", chunk=4).orderBy("position").collect()
    assert [r.was for r in got] == [1, 3, 0, 2, 4]


def test_progress_lines(spark):
    lines = ["out_time_us=1500000", "out_time_ms=2000000", " frame = 12 ", "fps=29.97", "progress=end", "progress=continue", "=5", "junk", "frame=x", "", None, "speed=2x", "out_time_us=-5"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i long, line string").withColumn("p", progress.parse_line("line"))
    got = {r.i: r.p for r in df.filter("p IS NOT NULL").collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 12]
    assert (got[0].out_seconds, got[1].out_seconds, got[2].frame, got[3].fps, got[4].finished) == (1.5, 2.0, 12, 29.97, True)


def test_latest_keeps_the_last_of_each_key(spark):
    rows = [("a", 1, "frame=1"), ("a", 2, "fps=5"), ("a", 3, "frame=7"), ("a", 4, "frame=bad"), ("b", 1, "progress=end"), ("c", 1, "x")]
    got = {r.w: (r.frame, r.fps, r.finished) for r in progress.latest(spark.createDataFrame(rows, "w string, n long, line string"), "w", "n").collect()}
    assert got == {"a": (7, 5.0, False), "b": (None, None, True)}


def test_fractions(spark):
    assert value(spark, progress.chunk_fraction(F.lit(50.0), F.lit(10.0))) == 1.0
    assert value(spark, progress.chunk_fraction(F.lit(0.0), F.lit(-3.0))) == 0.0
    assert value(spark, progress.chunk_done(F.lit(7.9), F.lit(4.0), F.lit(12))) == 2
    assert value(spark, progress.overall_fraction(F.lit(2.0), F.lit(2))) == pytest.approx(0.94)


def test_eta_looks_back_a_window(spark):
    samples = [(float(t), d, c) for t, d, c in [(0, 0, 0), (10, 50, 2), (20, 100, 4), (120, 150, 6), (120.05, 150, 6)]]
    got = progress.with_eta(spark.createDataFrame(samples, "t double, done long, chunks_complete long"), 1000).orderBy("t").collect()
    assert [r.eta_seconds for r in got] == [None, 210, 180, 1710, 1710]


def test_rolling_windows(spark):
    df = spark.createDataFrame([("a", i) for i in range(1, 9)], "k string, v long")
    assert [r.v for r in progress.rolling_last(df, "k", ["v"], 5).orderBy("place").collect()] == [4, 5, 6, 7, 8]
    five = df.filter("v <= 5")
    assert [r.evicted for r in progress.rolling_evicted(five, "k", ["v"], "v", 3).orderBy("v").collect()] == [None, None, None, 1, 2]
    for bad in (0, -1):
        with pytest.raises(ValueError):
            progress.rolling_last(df, "k", ["v"], bad)
    assert progress.rolling_last(df.limit(0), "k", ["v"], 2).count() == 0


def test_names_do_not_collide(spark):
    rows = [(1, "/a/x.jpg"), (2, "/b/X.jpg"), (3, "/c/x_1.jpg"), (4, "/d/x.jpg"), (5, "/e/y.png"), (6, "/f/x_1.jpg")]
    plan = spark.createDataFrame(rows, "seq long, path string").withColumn("target_dir", F.lit("/t"))
    got = {r.seq: r.target_name for r in resolve.collision_free(plan).collect()}
    assert got == {1: "x.jpg", 2: "X_1.jpg", 3: "x_1_1.jpg", 4: "x_2.jpg", 5: "y.png", 6: "x_1_2.jpg"}
    there = spark.createDataFrame([("/t", "X.JPG"), ("/t", "x_1.jpg")], "target_dir string, name string")
    got = {r.seq: r.target_name for r in resolve.collision_free(plan.filter("seq = 1"), there).collect()}
    assert got == {1: "x_2.jpg"}


def test_targets_fall_back_to_a_writable_root(spark):
    losers = spark.createDataFrame([(1, "/a/x.jpg"), (2, "C:\\b\\y.jpg")], "seq long, path string")
    bad = spark.createDataFrame([("/a", False)], "dir string, ok boolean")
    roots = spark.createDataFrame([(1, "/r1", False), (2, "/r2", True)], "ordinal int, root string, ok boolean")
    got = {r.seq: r.target_dir for r in resolve.move_targets(losers, bad, roots).collect()}
    assert got == {1: "/r2/PotentialDuplicates", 2: "C:\\b\\PotentialDuplicates"}
    assert {r.seq: r.status for r in resolve.move_plan(losers, writable=bad, roots=roots.filter("ordinal = 1")).collect()} == {1: "no writable folder", 2: "planned"}


def test_executor_moves_and_reports(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jpg").write_bytes(b"1")
    rows = [(1, f"{tmp_path}/a/x.jpg"), (2, f"{tmp_path}/a/gone.jpg")]
    report = resolve.execute(spark, resolve.move_plan(spark.createDataFrame(rows, "seq long, path string"))).collect()
    assert {r.path.rsplit("/", 1)[1]: r.status for r in report} == {"x.jpg": "moved", "gone.jpg": "failed"}
    assert (tmp_path / "a" / "PotentialDuplicates" / "x.jpg").read_bytes() == b"1"


def test_manifest_quotes(spark):
    df = spark.createDataFrame([(0, "/a/it's.mp4")], "chunk int, path string")
    assert resolve.manifest_lines(df).first().line == "file '/a/it'\\''s.mp4'"


def test_moves_replace_nothing_and_come_again_unharmed(spark, tmp_path):
    from loupe.operators.resolve import _moved

    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.jpg").write_bytes(b"old")
    (tmp_path / "x.jpg").write_bytes(b"new")
    assert _moved(str(tmp_path / "x.jpg"), str(tmp_path / "p"), "x.jpg") == ("failed", "x.jpg exists")
    assert _moved(str(tmp_path / "x.jpg"), str(tmp_path / "p"), "y.jpg") == ("moved", None)
    assert _moved(str(tmp_path / "x.jpg"), str(tmp_path / "p"), "y.jpg") == ("moved", None)  # the task runs again
    assert (tmp_path / "p" / "x.jpg").read_bytes() == b"old" and (tmp_path / "p" / "y.jpg").read_bytes() == b"new"


def test_publishing_files(spark, tmp_path):
    for name, size in (("a.part", 2000), ("b.part", 10)):
        (tmp_path / name).write_bytes(b"x" * size)
    (tmp_path / "a").write_bytes(b"older")
    parts = spark.createDataFrame([(f"{tmp_path}/{n}.part", f"{tmp_path}/{n}") for n in "abc"], "part string, final string")
    got = {r.final[-1]: (r.status, r.reason) for r in resolve.publish(spark, parts).collect()}
    assert got == {"a": ("published", None), "b": ("failed", "10 bytes only"), "c": ("failed", "no file was made")}
    assert len((tmp_path / "a").read_bytes()) == 2000 and not (tmp_path / "a.part").exists() and (tmp_path / "b.part").exists()
    assert resolve.publish(spark, parts.filter("final LIKE '%a'")).first().status == "published"  # the task runs again


def test_work_is_stopped_and_cleared_away(spark):
    import threading

    from loupe.session import _ROOTS, Cancelled, Scratch, _path, cancellable

    stop, roots = threading.Event(), []

    def endless():
        scratch = Scratch(spark, "stopped")
        roots.append(scratch.root)
        scratch.cut(spark.range(10), "before")
        threading.Timer(1.0, stop.set).start()
        return spark.range(10**13).selectExpr("sum(hash(id)) AS s").collect()

    with pytest.raises(Cancelled):
        cancellable(spark, endless, stop)
    fs, at = _path(spark, roots[0])
    assert not fs.exists(at) and roots[0] not in _ROOTS
    assert cancellable(spark, lambda: spark.range(5).count(), threading.Event()) == 5
    with pytest.raises(ZeroDivisionError):
        cancellable(spark, lambda: 1 // 0, threading.Event())


def test_wrapping_and_fitting(spark):
    from loupe.functions import text

    def lines(value, most):
        return spark.createDataFrame([(value,)], "t string").select(text.wrapped("t", most).alias("l")).first().l

    assert lines("aa bb  cc dddddddd e", 5) == ["aa bb", "cc", "dddddddd", "e"]
    assert lines("", 5) == [""] and lines("  ", 5) == ["  "] and lines(None, 5) == [None]
    df = spark.createDataFrame([("one two",), ("x" * 200,), ("a",)], "t string")
    got = [tuple(r.f) for r in df.select(text.fitted("t", 100, 60).alias("f")).collect()]
    # at 50 points a line holds four characters, but two lines are too high; at 28 all fit on one
    assert got == [(28, ["one two"]), (16, ["x" * 200]), (50, ["a"])]
