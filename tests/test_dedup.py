"""Facts on ties, components, classification and the photo to keep."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loupe.operators import dedup, edges, graph

NOW = (
    "seq long, library string, device string, path string, file_size long, format string, width int, height int, "
    "capture_time timestamp_ntz, dhash long, sha string"
)
T0 = dt.datetime(2020, 1, 1)


def photo(seq, sha=None, dhash=None, size=1, w=10, t=None, path=None, library="a"):
    return (seq, library, None, path or f"/{seq}.jpg", size, "Jpeg", w, w, t, dhash, sha)


def found(spark, rows):
    d = dedup.detect(spark.createDataFrame(rows, NOW))
    by = {}
    for r in d.members.collect():
        by.setdefault((r.classification, r.group_id), set()).add(r.seq)
    return by, {(r.classification, r.group_id): r for r in d.groups.collect()}


A, B, C, D = ("%064x" % k for k in (1, 2, 3, 4))


def test_exact_pair_and_triple(spark):
    assert found(spark, [photo(1, A, 5), photo(2, A, 5)])[0] == {("ExactOnly", 1): {1, 2}}
    assert found(spark, [photo(3, A, 5), photo(1, A, 5), photo(2, A, 5)])[0] == {("ExactOnly", 1): {1, 2, 3}}


def test_exact_inside_visual_leaves_the_winner(spark):
    members, groups = found(spark, [photo(1, A, 0b1111), photo(2, A, 0b1111, w=99), photo(3, B, 0b0111)])
    assert members == {("ExactOnly", 1): {1, 2}, ("HasVisualComponent", 1): {2, 3}}
    assert groups["ExactOnly", 1].recommended_seq == 2 and groups["HasVisualComponent", 1].recommended_seq == 2


def test_two_exact_sets_that_look_alike(spark):
    members, _ = found(spark, [photo(1, A, 7), photo(2, A, 7), photo(3, B, 15), photo(4, B, 15)])
    assert members == {("ExactOnly", 1): {1, 2}, ("ExactOnly", 3): {3, 4}, ("HasVisualComponent", 1): {1, 3}}


def test_bridge_groups_ends_that_differ(spark):
    a, b, c = 0, 0xFF, 0xFFFF
    assert found(spark, [photo(1, None, a), photo(2, None, b), photo(3, None, c)])[0] == {("HasVisualComponent", 1): {1, 2, 3}}


def test_distance_of_eight_ties_and_nine_does_not(spark):
    assert found(spark, [photo(1, A, 0), photo(2, B, 0xFF)])[0] == {("HasVisualComponent", 1): {1, 2}}
    assert found(spark, [photo(1, A, 0), photo(2, B, 0x1FF)])[0] == {}


def test_libraries_and_missing_values_do_not_tie(spark):
    rows = [photo(1, A, 5), photo(2, A, 5, library="b"), photo(3), photo(4), photo(5, library=None, sha=A), photo(6, library=None, sha=A)]
    assert found(spark, rows)[0] == {}
    assert found(spark, [])[0] == {}


def test_equal_looks_with_unknown_bytes_are_visual(spark):
    assert found(spark, [photo(1, None, 9), photo(2, None, 9)])[0] == {("HasVisualComponent", 1): {1, 2}}


@pytest.mark.parametrize("a,b,best", [
    (photo(1, w=1000, size=5000), photo(2, w=2000, size=1000), 2), (photo(1, size=100000), photo(2, size=500000), 2),
    (photo(2, path="/a"), photo(1, path="/b"), 2), (photo(1, path="/ab"), photo(2, path="/a_"), 1), (photo(1), photo(2, t=T0), 2),
])
def test_photo_to_keep(spark, a, b, best):
    df = spark.createDataFrame([a, b], NOW)
    assert df.agg(F.min_by("seq", dedup.keep_key())).first()[0] == best
    assert df.orderBy(*dedup.keep_order()).first().seq == best


def test_near_hashes_match_brute_force(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(20)]
    rows = []
    for i in range(240):
        h = rng.choice(base)
        for b in rng.sample(range(63), rng.randint(0, 14)):
            h ^= 1 << b
        rows.append((i, rng.choice("ab"), h))
    df = spark.createDataFrame(rows, "seq long, library string, dhash long")
    for most in (0, 5, 8, 12):
        want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and bin(a[2] ^ b[2]).count("1") <= most}
        got = [(r.id_a, r.id_b) for r in edges.near_hashes(df, distance=most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    def solve(pairs, n=None):
        df = spark.createDataFrame(pairs, "src long, dst long")
        vertices = spark.range(n).withColumnRenamed("id", "seq") if n else None
        return {r.seq: r.component for r in graph.components(df, "src", "dst", vertices).collect()}

    assert solve([(0, 1), (1, 2), (3, 4)], 6) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    assert solve([(0, 1), (2, 3), (1, 2)], 5) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}
    assert solve([(1, 1), (None, 2)]) == {}
    rng = random.Random(1)
    pairs = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 620)]
    assert solve(pairs) == union_find(pairs)


def test_attach_hashes_fills_only_missing(spark):
    photos = spark.createDataFrame([(1, "/A/x.jpg", None), (2, "/b", 7), (3, None, None)], "seq long, path string, dhash long")
    hashes = spark.createDataFrame([("\\a\\X.JPG", 5), ("/B", 9), (None, 1)], "path string, dhash long")
    assert sorted(map(tuple, dedup.attach_hashes(photos, hashes).select("seq", "dhash").collect())) == [(1, 5), (2, 7), (3, None)]


def test_groups_are_ordered_by_size_time_and_first(spark):
    rows = [("x", 2, T0, 4), ("y", 3, None, 3), ("z", 2, None, 2), ("w", 2, T0 - dt.timedelta(1), 9)]
    df = spark.createDataFrame(rows, "classification string, n long, recommended_time timestamp_ntz, first_seq long")
    assert [r.classification for r in dedup.ordered_groups(df).orderBy("position").collect()] == ["y", "w", "x", "z"]


def test_the_fingerprint_of_very_many_pairs_does_not_overflow(spark):
    pairs = spark.range(20_000_000).selectExpr("id + 1 AS u", "id AS v")
    a, b = (df.agg(*(c.alias(k) for k, c in graph._fingerprint().items())).first() for df in (pairs, pairs.filter("u != 77")))
    assert a.n == 20_000_000 and b.n == a.n - 1 and (a.x, a.y) != (b.x, b.y)


def test_columns_with_clashing_names_are_not_read(spark):
    rows = [photo(1, A, 5), photo(2, A, 5), photo(3, B, 7)]
    df = spark.createDataFrame(rows, NOW).selectExpr("*", "1 AS component", "2 AS visual", "3 AS grp", "4 AS h", "5 AS copies", "6 AS id", "7 AS best")
    assert {(r.classification, r.group_id, r.seq) for r in dedup.detect(df).members.collect()} == {
        ("ExactOnly", 1, 1), ("ExactOnly", 1, 2), ("HasVisualComponent", 1, 1), ("HasVisualComponent", 1, 3)
    }


def test_a_hot_hash_and_hot_bytes(spark):
    rows = [photo(k, A if k % 2 else None, 5, w=k % 7 + 1) for k in range(1, 400)] + [photo(500, B, 7)]
    members, _ = found(spark, rows)
    best = max((k for k in range(1, 400, 2)), key=lambda k: (k % 7, -len(f"/{k}.jpg"), -k))
    assert members["ExactOnly", 1] == set(range(1, 400, 2))
    assert members["HasVisualComponent", 1] == {500, *range(2, 400, 2), best}
    assert dedup.size_collisions(spark.createDataFrame(rows, NOW)).filter("collides").count() == 400


def test_detection_leaves_no_tables_of_its_ties(spark, data_dir, tmp_path, monkeypatch):
    """They would lie beside the tables that groups are made of."""
    from loupe import session
    from loupe.operators import dedup
    from loupe.plans.common import now

    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    assert dedup.detect(now(spark, data_dir)).members.count() > 0
    left = {p.name.split("-")[0] for p in tmp_path.iterdir()}
    assert "detect" in left and "looks" not in left
