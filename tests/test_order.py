import datetime as dt
import random

import numpy as np
import pytest

from loupe.functions import text
from loupe.operators import edges, order, positions, report
from loupe.plans import registry
from loupe.plans.common import now

T0 = dt.datetime(2026, 5, 25, 10)
NOW = "seq long, library string, path string, capture_time timestamp_ntz, dhash long, sha string"


def frame(spark, rows):
    return spark.createDataFrame([(s, "a", p, t, h, None) for s, p, t, h in rows], NOW)


def test_sessions_of_a_list(spark):
    def numbers(times, paths=None):
        rows = [(i, (paths or "abcdefgh")[i], t, None) for i, t in enumerate(times)]
        return [r.number for r in order.time_clusters(frame(spark, rows)).orderBy("seq").collect()]

    m = lambda *a: [T0 + dt.timedelta(minutes=x) for x in a]
    assert numbers(m(0, 0.5, 1, 1.5)) == [1, 1, 1, 1]
    assert numbers(m(0, 5, 120, 130, 480)) == [1, 1, 2, 2, 3]
    assert numbers([None, None, None], "zam") == [1, 1, 1]
    assert numbers(m(0, 30) + [T0 + dt.timedelta(minutes=60, microseconds=1), None]) == [1, 1, 2, 2]


def test_slots_of_twenty_among_a_hundred():
    slots = order.spaced_slots(np.array([80, 20]))
    assert sorted(slots.tolist()) == list(range(100))
    small = sorted(slots[80:].tolist())
    assert small[:4] == [3, 7, 13, 17] and small[-2:] == [93, 97] and min(np.diff(small)) == 4


def plain_slots(sizes):
    n, out, free = sum(sizes), [], set(range(sum(sizes)))
    for number, size in enumerate(sizes):
        for k in range(size):
            target = (round(k * (n / size)) + number % n) % n
            later = [s for s in free if s >= target]
            slot = min(later) if later else min(free)
            free.remove(slot)
            out.append(slot)
    return out


def test_slots_match_the_plain_rule():
    rng = random.Random(3)
    for _ in range(30):
        sizes = sorted((rng.choice([1, 1, 2, 5, 13]) for _ in range(rng.randint(1, 25))), reverse=True)
        assert order.spaced_slots(np.array(sizes)).tolist() == plain_slots(sizes)


def test_variety_chain_goes_to_the_farthest():
    h = np.array([0, 1, 0xFF, 0xF, 0xFFFF], dtype=np.uint64)
    assert order.variety_chain(h, np.ones(5, dtype=bool)).tolist() == [0, 4, 1, 2, 3]
    assert order.variety_chain(h, np.zeros(5, dtype=bool)).tolist() == [0, 1, 2, 3, 4]
    assert order.variety_chain(h[:1], np.ones(1, dtype=bool)).tolist() == [0]


def mixed(spark, rows, partitions=None):
    df = frame(spark, rows)
    out = order.best_mix(df.repartition(partitions) if partitions else df).collect()
    return [r.seq for r in sorted(out, key=lambda r: r.slot)]


def test_twenty_alike_are_spread(spark):
    rows = [(i, f"osu_{i:02d}.jpg", T0 + dt.timedelta(seconds=i), -0x5555555555555556) for i in range(20)]
    rows += [(100 + i, f"other_{i:03d}.jpg", T0 + dt.timedelta(days=30, hours=i), (i << 32) | 0x5555) for i in range(80)]
    got = mixed(spark, rows)
    slots = [k for k, s in enumerate(got) if s < 100]
    assert len(got) == len(set(got)) == 100 and slots[:4] == [3, 7, 13, 17] and min(np.diff(slots)) > 3
    assert mixed(spark, rows, 7) == got


def test_without_any_signal_by_path(spark):
    assert mixed(spark, [(1, "c.jpg", None, None), (2, "a.jpg", None, None), (3, "b.jpg", None, None), (4, "a_", None, None)]) == [2, 4, 3, 1]
    assert mixed(spark, []) == [] and mixed(spark, [(5, "x", None, None)]) == [5]


def test_spacing_report(spark):
    df = spark.createDataFrame([("a", 1, s, s) for s in (0, 4, 5)] + [("a", 9, 7, 7)], "library string, component long, seq long, slot long")
    (r,) = order.spacing_report(df).collect()
    assert (r.n, r.min_gap, r.max_gap, r.avg_gap, r.slots) == (3, 1, 4, 2.5, "0, 4, 5")
    many = spark.createDataFrame([("a", 1, s, s) for s in range(15)], "library string, component long, seq long, slot long")
    assert order.spacing_report(many).first().slots == "0, 1, 2, 3, 4, 5, 6, 7, ..., 14"


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_positions(spark, n):
    df = spark.range(n).selectExpr("id", "id % 7 AS k")
    got = sorted((r.k, r.id, r.position) for r in positions.with_position(df, ["k", "id"]).collect())
    assert [p for _, _, p in got] == list(range(1, n + 1))


def _hashed(spark, n, seed, libraries=("a", "a", "b")):
    """Photos with hashes near each other, equal or missing, and one without a library."""
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n // 20)]
    rows = []
    for seq in range(1, n + 1):
        h = rng.choice(base)
        for b in rng.sample(range(64), rng.choice([0, 3, 9, 14, 18])):
            h ^= 1 << b
        h = h - (1 << 64) if h >> 63 else h
        rows.append((seq, rng.choice(libraries), f"/p/{seq % 7}.jpg", None if seq % 11 == 0 else h))
    rows.append((n + 1, None, "/p/x.jpg", rows[0][3]))
    return rows, spark.createDataFrame(rows, "seq long, library string, path string, dhash long")


def _near(rows, most):
    bits = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    known = [r for r in rows if r[1] is not None and r[3] is not None]
    return {(x[0], y[0]): bits(x[3], y[3]) for x in known for y in known if x[0] < y[0] and x[1] == y[1] and bits(x[3], y[3]) <= most}


def test_pairs_at_22_bits_in_several_blocks_match_brute_force(spark):
    rows, df = _hashed(spark, 150, 4)
    want = _near(rows, 22)
    got = edges.compared_pairs(df, distance=22, rows=20).collect()
    assert len(got) == len(want) and {(r.id_a, r.id_b): r.bits for r in got} == want
    assert {(r.id_a, r.id_b): r.bits for r in report.close_pairs(df, 22).collect()} == want and max(want.values()) == 22


THRESHOLDS = [6, 8, 10, 12, 14, 16, 18, 20, 21, 22]


def _groups(rows, thresholds):
    """{threshold: sets of two or more photos}, by union of all near pairs."""
    near, out = _near(rows, max(thresholds)), {}
    for t in thresholds:
        parent = {r[0]: r[0] for r in rows}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for (a, b), bits in near.items():
            if bits <= t:
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
        by = {}
        for x in parent:
            by.setdefault(find(x), set()).add(x)
        out[t] = {frozenset(g) for g in by.values() if len(g) > 1}
    return out


def _current(spark, data_dir):
    return [tuple(r) for r in now(spark, data_dir, "library", "path", "dhash").select("seq", "library", "path", "dhash").collect()]


@pytest.mark.parametrize("block", [13, 50, 4096])
def test_sweep_in_blocks_matches_brute_force(spark, block):
    rows, df = _hashed(spark, 160, 6)
    want, got = _groups(rows, THRESHOLDS), {}
    for r in report.compared_sweep(df, THRESHOLDS, rows=block).collect():
        got.setdefault((r.threshold, r.component), set()).add(r.seq)
    assert all(c == min(g) for (_, c), g in got.items())
    assert {t: {frozenset(g) for (x, _), g in got.items() if x == t} for t in THRESHOLDS} == want
    assert len({len(g) for g in want.values()}) > 5


def test_sweep_query_counts_at_every_threshold(spark, data_dir):
    want = _groups(_current(spark, data_dir), THRESHOLDS)
    got = registry.queries()["A13_threshold_sweep"](spark, data_dir).collect()
    assert {r.threshold: (r.n_groups, r.n_photos) for r in got} == {t: (len(g), sum(map(len, g))) for t, g in want.items()}
    assert [r.threshold for r in sorted(got)] == THRESHOLDS


def test_new_groups_at_every_step(spark, data_dir):
    groups = _groups(_current(spark, data_dir), THRESHOLDS)
    want = sorted((t, min(g), x) for before, t in zip(THRESHOLDS, THRESHOLDS[1:]) for g in groups[t] - groups[before] for x in g)
    got = registry.queries()["U3_new_groups"](spark, data_dir).collect()
    assert sorted((r.threshold, r.component, r.seq) for r in got) == want and len({t for t, *_ in want}) > 5


def test_sweep_at_small_thresholds_matches_brute_force(spark):
    rows, df = _hashed(spark, 160, 9)
    want, got = _groups(rows, [2, 3, 9, 12]), {}
    for r in report.threshold_sweep(df, [9, 3, 2, 12]).collect():
        got.setdefault((r.threshold, r.component), set()).add(r.seq)
    assert all(c == min(g) for (_, c), g in got.items())
    assert {t: {frozenset(g) for (x, _), g in got.items() if x == t} for t in (2, 3, 9, 12)} == want


def test_a_published_order_is_reproduced(spark):
    """All 197 slots of an order that was published with hashes and times to the minute."""
    from pathlib import Path

    from loupe.sources.files import read_ordering

    listed = read_ordering(spark, str(Path(__file__).parent / "data" / "mixed_order.txt")).collect()
    assert [r.slot for r in listed] == list(range(1, 198))
    rows = [(k, r.name, r.capture_time, r.dhash) for k, r in enumerate(sorted(listed, key=lambda r: r.name[::-1]))]
    names = {k: name for k, name, *_ in rows}
    assert [names[s] for s in mixed(spark, rows)] == [r.name for r in listed]
    sizes = sorted(order.similar_clusters(frame(spark, rows)).groupBy("component").count().toPandas()["count"], reverse=True)
    assert sizes[:10] == [38, 17, 9, 7, 7, 6, 5, 5, 4, 4]


def test_ties_of_flat_hashes_and_of_many_copies_match_brute_force(spark):
    rng = random.Random(5)
    hashes = [rng.getrandbits(53) << 11 for _ in range(40)]
    rows = []
    for seq in range(300):
        h = rng.choice(hashes[:3] if seq % 3 else hashes) ^ (1 << rng.randrange(11, 64) if seq % 4 else 0)
        rows.append((seq, "a", "/p", h - (1 << 64) if h >> 63 else h))
    df = spark.createDataFrame(rows, "seq long, library string, path string, dhash long")
    for shared in (None, 2, 3):
        got = edges.near_hashes(df, shared=shared).collect()
        assert {(r.id_a, r.id_b): r.bits for r in got} == _near(rows, 8) and len(got) == len(_near(rows, 8))


def test_time_links_and_gaps_are_those_of_a_window(spark):
    rows = [(s, "p", T0 + dt.timedelta(minutes=17 * (s * s % 23)), None) for s in range(60)]
    got = {(r.u, r.v) for r in edges.time_links(frame(spark, rows)).collect()}
    by = sorted((t, s) for s, _, t, _ in rows)
    assert got == {(a[1], b[1]) for a, b in zip(by, by[1:]) if b[0] - a[0] <= dt.timedelta(minutes=30)}


def test_following_hot_keys(spark):
    from loupe.session import follow

    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 7, if(id % 50 = 1, NULL, id)) AS k")
    found = spark.createDataFrame([(7, 1), (8, 2), (11, 3)], "k long, v long")
    for how in ("inner", "left"):
        want = sorted((r.id, r.v or 0) for r in rows.join(found, "k", how).collect())
        assert sorted((r.id, r.v or 0) for r in follow(rows, found, "k", 5000, hot_rows=100, how=how).collect()) == want
    plan = follow(rows, found, "k", 5000, hot_rows=100)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan and "Union" in plan


def test_positions_by_group(spark):
    df = spark.range(3000).selectExpr("id", "if(id < 2000, 'hot', if(id < 2900, cast(id % 40 AS string), NULL)) AS g")
    got = {}
    for r in positions.with_position(df, ["id"], by="g").collect():
        got.setdefault(r.g, []).append((r.id, r.position))
    assert all([p for _, p in sorted(x)] == list(range(1, len(x) + 1)) for x in got.values()) and len(got) == 42


def test_first_available_name(spark):
    there = [("/a", "Trip"), ("/a", "trip (2)"), ("/a", "Trip (04)"), ("/a", "Trip (4)"), ("/b", "X (2)"), *(("/c", f"F ({i})") for i in range(2, 1000)), ("/c", "F")]
    wanted = [(1, "/a", "TRIP"), (2, "/b", "X"), (3, "/c", "F"), (4, "/gone", "Y"), (5, "/a", "Trip (4)"), (6, "/a", "Trip (2)")]
    got = report.available_names(spark.createDataFrame(wanted, "id int, folder string, base string"), spark.createDataFrame(there, "folder string, name string"))
    assert {r.id: r.name for r in got.collect()} == {1: "TRIP (3)", 2: "X", 3: "F", 4: "Y", 5: "Trip (4) (2)", 6: "Trip (2) (2)"}


def test_default_base_name(spark):
    cases = [(["C:\\pics\\Rome"], "Rome Slideshow"), (["/p/Rome/"], "Rome Slideshow"), (["/a", "/b"], "My Slideshow"), ([], "My Slideshow"),
             (None, "My Slideshow"), ([None], "My Slideshow"), ([""], "My Slideshow"), (["C:\\"], "C:\\ Slideshow")]
    df = spark.createDataFrame([(k, f) for k, (f, _) in enumerate(cases)], "k int, folders array<string>")
    got = {r.k: r.name for r in df.select("k", text.default_base_name("folders").alias("name")).collect()}
    assert got == {k: name for k, (_, name) in enumerate(cases)}


def test_listed_pairs(spark):
    photos = spark.createDataFrame([(1, "/x/A.jpg", 1), (2, "/y/a.JPG", 255), (3, "/x/b.jpg", 7), (4, "/x/c.jpg", None)], "seq long, path string, dhash long")
    names = spark.createDataFrame([("a.jpg",), ("B.jpg",), ("c.jpg",), ("no.jpg",), ("b.jpg",)], "name string")
    got = {(r.name_a, r.name_b): r.bits for r in report.listed_pairs(photos, names).collect()}
    assert got == {("A.JPG", "B.JPG"): 2, ("A.JPG", "C.JPG"): None, ("B.JPG", "C.JPG"): None}
    lists = spark.createDataFrame([(1, "a.jpg"), (1, "B.jpg"), (2, "c.jpg"), (2, "b.jpg"), (None, "a.jpg")], "list int, name string")
    got = {(r.list, r.name_a, r.name_b): r.bits for r in report.listed_pairs(photos, lists, by="list").collect()}
    assert got == {(1, "A.JPG", "B.JPG"): 2, (2, "B.JPG", "C.JPG"): None}
