from loupe.operators.sessions import SessionTable
from loupe.session import Scratch
from loupe.streaming import progress as streams


def write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def test_lines_are_parsed_as_they_arrive(spark, tmp_path):
    write(tmp_path / "in", "1.txt", ["frame=3", "junk", "out_time_us=1000000"])
    stream = lambda: streams.parsed(streams.read_lines(spark, str(tmp_path / "in")))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    streams.run_to_end(stream(), out, state)
    assert spark.read.parquet(out).count() == 2
    write(tmp_path / "in", "2.txt", ["progress=end", "fps=x"])
    streams.run_to_end(stream(), out, state)
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 3 and any(r.finished for r in rows)


def test_sessions_are_kept_up_over_batches(spark, tmp_path):
    gap = 1800 * 1_000_000
    write(tmp_path / "in", "1.txt", ["a,0,1", f"a,{2 * gap},2"])
    store = SessionTable(spark, f"{Scratch(spark, 'test').root}/store", buckets=2)

    def go():
        lines = streams.read_lines(spark, str(tmp_path / "in"))
        rows = lines.selectExpr("split(line, ',')[0] AS key", "cast(split(line, ',')[1] AS long) AS t", "cast(split(line, ',')[2] AS long) AS id")
        streams.keep_sessions(rows, store, str(tmp_path / "state"))

    go()
    assert store.read().count() == 2
    write(tmp_path / "in", "2.txt", [f"a,{gap},3"])
    go()
    assert [tuple(r) for r in store.read().collect()] == [("a", 0, 2 * gap, 1, 2, 3)]


def test_streams_into_one_store_do_not_shadow_each_other_and_a_crash_counts_nothing_twice(spark, tmp_path):
    gap = 1800 * 1_000_000
    store = SessionTable(spark, f"{Scratch(spark, 'test').root}/store", buckets=2)

    def go(folder, state):
        lines = streams.read_lines(spark, str(tmp_path / folder))
        rows = lines.selectExpr("split(line, ',')[0] AS key", "cast(split(line, ',')[1] AS long) AS t", "cast(split(line, ',')[2] AS long) AS id")
        streams.keep_sessions(rows, store, str(tmp_path / state))

    write(tmp_path / "one", "1.txt", ["a,0,1"])
    write(tmp_path / "two", "1.txt", [f"b,{9 * gap},2"])
    go("one", "s1")
    go("two", "s2")  # its batch 0 is not the other's
    assert {r.key for r in store.read().collect()} == {"a", "b"}
    write(tmp_path / "three", "1.txt", [f"c,{gap},3"])
    go("three", "s3")
    # lost after the publication and before the stream noted the batch: it comes again
    for part in ("commits/0", "commits/.0.crc"):
        (tmp_path / "s3" / part).unlink(missing_ok=True)
    go("three", "s3")
    assert sorted((r.key, r.n) for r in store.read().collect()) == [("a", 1), ("b", 1), ("c", 1)]


def test_throttle_and_rolling_window_keep_state_between_batches(spark, tmp_path):
    write(tmp_path / "in", "1.txt", ["a,1", "a,5", "a,12"])

    def rows():
        lines = streams.read_lines(spark, str(tmp_path / "in"))
        return lines.selectExpr("split(line, ',')[0] AS k", "cast(split(line, ',')[1] AS long) AS done")

    def go():
        streams.run_to_end(streams.throttle_stream(rows(), "k", "done", 10), str(tmp_path / "t"), str(tmp_path / "ts"))
        streams.run_to_end(streams.rolling_stream(rows(), "k", "done", "done", 2), str(tmp_path / "r"), str(tmp_path / "rs"))

    go()
    write(tmp_path / "in", "2.txt", ["a,13", "a,25", "b,2"])
    go()
    assert sorted((r.k, r.done) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("a", 1), ("a", 12), ("a", 25), ("b", 2)]
    got = {(r.k, r.done): r.evicted for r in spark.read.parquet(str(tmp_path / "r")).collect()}
    assert got == {("a", 1): None, ("a", 5): None, ("a", 12): 1, ("a", 13): 5, ("a", 25): 12, ("b", 2): None}


def test_provisional_groups_come_first(spark):
    from tests.test_dedup import A, B, NOW, photo

    seen = []
    rows = spark.createDataFrame([photo(1, A, 7), photo(2, A, 7), photo(3, B, 15)], NOW)
    streams.provisional_then_final(rows, lambda name, df: seen.append((name, df.collect())))
    assert [n for n, _ in seen] == ["provisional", "final"] and len(seen[0][1]) == 1
    assert {(r.classification, r.confirmed) for r in seen[1][1]} == {("ExactOnly", True), ("HasVisualComponent", False)}
