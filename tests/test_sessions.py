import random

import pytest

from loupe.operators.sessions import SessionTable, local_sessions
from loupe.session import Scratch

GAP = 1800 * 1_000_000
ROW = "key string, t long, id long"


def brute(rows, gap=GAP):
    by = {}
    for k, t, i in rows:
        if k is not None and t is not None:
            by.setdefault(k, []).append((t, i))
    out = set()
    for k, items in by.items():
        items.sort()
        run = [items[0]]
        for x in items[1:] + [None]:
            if x is None or x[0] - run[-1][0] > gap:
                last = max(run)
                out.add((k, run[0][0], last[0], run[0][1], last[1], len(run)))
                run = []
            if x is not None:
                run.append(x)
    return out


def rows_of(seed, n=500):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, rng.randint(-10**11, 10**11), rng.randint(0, 10**10)]), i) for i in range(n)]
    return rows + [("edge", 0, 1), ("edge", GAP, 2), ("edge", 2 * GAP + 1, 3), ("tie", 5, 9), ("tie", 5, 4)] + rows[:20]


def test_local_sessions(spark):
    rows = rows_of(1)
    got = [tuple(r) for r in local_sessions(spark.createDataFrame(rows, ROW)).collect()]
    assert set(got) == brute(rows) and len(got) == len(set(got))
    assert local_sessions(spark.createDataFrame([], ROW)).count() == 0


@pytest.mark.parametrize("buckets,slice_days", [(1, 730), (5, 1)])
def test_batches_in_any_order_give_the_same_sessions(spark, buckets, slice_days):
    rows = rows_of(2)
    rng = random.Random(8)
    rng.shuffle(rows)
    store = SessionTable(spark, f"{Scratch(spark, 'test').root}/store", buckets=buckets, slice_days=slice_days)
    assert store.read().count() == 0
    at = 0
    for size in (100, 1, 0, 250, 1000):
        store.merge(spark.createDataFrame(rows[at : at + size], ROW))
        at += size
        assert {tuple(r) for r in store.read().collect()} == brute(rows[:at])


def test_a_bridge_joins_stored_sessions(spark):
    store = SessionTable(spark, f"{Scratch(spark, 'test').root}/store", buckets=2)
    store.merge(spark.createDataFrame([("a", 0, 1), ("a", 2 * GAP, 2), ("b", 0, 7)], ROW))
    assert store.read().count() == 3
    store.merge(spark.createDataFrame([("a", GAP, 3)], ROW))
    assert {tuple(r) for r in store.read().collect()} == {("a", 0, 2 * GAP, 1, 2, 3), ("b", 0, 0, 7, 7, 1)}


def test_a_version_is_published_once(spark):
    store = SessionTable(spark, f"{Scratch(spark, 'test').root}/store", buckets=2)
    assert store.merge(spark.createDataFrame([("a", 0, 1)], ROW)) == 1
    with pytest.raises(RuntimeError):
        store._publish(1, {})
    assert store.merge(spark.createDataFrame([(None, 0, 1)], ROW)) == 1  # nothing usable, nothing published
    assert store.read().count() == 1


def test_data_without_a_manifest_is_not_seen(spark):
    store = SessionTable(spark, f"{Scratch(spark, 'test').root}/store", buckets=2)
    store.merge(spark.createDataFrame([("a", 0, 1)], ROW))
    lost = SessionTable(spark, store.root, buckets=2)
    lost._publish = lambda *a: (_ for _ in ()).throw(OSError("writer lost"))
    with pytest.raises(OSError):
        lost.merge(spark.createDataFrame([("a", 5, 2)], ROW))
    assert {tuple(r) for r in store.read().collect()} == {("a", 0, 0, 1, 1, 1)}


@pytest.mark.parametrize("slice_days", [730, 1])
def test_corrected_rows_replace_their_earlier_versions(spark, slice_days):
    """Rows that move, lose their time or come anew, in batches, against sessions of what counts at the end."""
    rng = random.Random(4)
    store = SessionTable(spark, f"{Scratch(spark, 'test').root}/store", buckets=3, slice_days=slice_days)
    held: dict[int, tuple] = {}
    for step in range(4):
        ids = rng.sample(range(400), 150) if step else range(300)
        batch = {i: (rng.choice(["hot", "hot", "b", None]), rng.choice([None, *[rng.randint(0, 4 * 10**11)] * 4]), i) for i in ids}
        frame = lambda rows: spark.createDataFrame(list(rows), ROW)
        store.merge(
            frame(batch.values()), replaced=frame(r for i, r in held.items() if i in batch), rest=frame(r for i, r in held.items() if i not in batch)
        )
        held |= batch
        assert {tuple(r) for r in store.read().collect()} == brute(held.values())
    store.merge(frame([]), replaced=frame(r for r in held.values() if r[0] == "hot"), rest=frame(r for r in held.values() if r[0] != "hot"))
    assert {tuple(r) for r in store.read().collect()} == brute(r for r in held.values() if r[0] != "hot")


def test_a_merge_leaves_units_alone_in_which_nothing_changed(spark):
    day = 86_400 * 1_000_000
    store = SessionTable(spark, f"{Scratch(spark, 'test').root}/store", buckets=2, slice_days=10)
    store.merge(spark.createDataFrame([("a", k * day, k) for k in range(100)], ROW))
    before = store._manifest()[1]["units"]
    store.merge(spark.createDataFrame([("a", 55 * day + GAP, 500)], ROW))
    after = store._manifest()[1]["units"]
    assert len(before) == 10 and [u for u in after if after[u] != before.get(u)] == [u for u in before if u.endswith("_5")]
    # the session at a slice's end goes on in the next: both units are read, the first holds it
    store.merge(spark.createDataFrame([("a", 50 * day - GAP, 501), ("a", 49 * day + GAP, 502)], ROW))
    assert store.read().filter("n = 2").count() == 3


def test_replaced_data_are_removed_but_for_the_version_before(spark):
    store = SessionTable(spark, f"{Scratch(spark, 'test').root}/store", buckets=1, keep=2)
    for k in range(5):
        store.merge(spark.createDataFrame([("a", k * 10 * GAP, k)], ROW))
    assert store._versions() == [4, 5] and store.read().count() == 5
    from loupe.session import _path

    fs, at = _path(spark, f"{store.root}/data")
    assert sorted(x.getPath().getName().split("-")[0] for x in fs.listStatus(at)) == ["4", "5"]


def test_a_batch_with_a_source_is_taken_once(spark):
    store = SessionTable(spark, f"{Scratch(spark, 'test').root}/store")
    rows = spark.createDataFrame([("a", 0, 1)], ROW)
    assert store.merge(rows, source=("s", 0)) == store.merge(rows, source=("s", 0)) == 1
    assert store.merge(rows, source=("other", 0)) == 2 and store.read().first().n == 2
    assert store.merge(spark.createDataFrame([], ROW), source=("s", 1)) == 3 and store.taken("s") == 1 and store.taken("new") == -1
