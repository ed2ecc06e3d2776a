import random

import pytest

from loupe.llm import groups
from tests.llm.conftest import components, distance, messy_photos, now_of, photo, usable_sha


def links(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long, id long") if pairs and len(pairs[0]) == 3 else spark.createDataFrame(
        [(a, b, 0) for a, b in pairs], "src long, dst long, id long")


def solved(spark, pairs):
    return {r.id: r.component for r in groups.connected(links(spark, pairs)).collect()}


def expected(pairs):
    good = [(a, b) for a, b in pairs if a is not None and b is not None and a != b]
    return components({x for p in good for x in p}, good)


def test_no_pairs_and_useless_pairs(spark):
    assert solved(spark, []) == {}
    assert solved(spark, [(1, 1), (None, 2), (3, None), (None, None)]) == {}


def test_bridged_and_reversed_and_repeated(spark):
    pairs = [(2, 1), (1, 2), (1, 2), (3, 2), (9, 8), (5, 5)]
    assert solved(spark, pairs) == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}


def test_long_chain_in_bad_order(spark):
    ids = list(range(1, 700))
    random.Random(1).shuffle(ids)
    pairs = list(zip(ids, ids[1:]))
    assert solved(spark, pairs) == expected(pairs)
    straight = [(i, i + 1) for i in range(1, 600)]
    assert set(solved(spark, straight).values()) == {1}


def test_hub_and_random_graphs(spark):
    rng = random.Random(5)
    hub = [(5000, i) for i in range(1, 400)]
    assert set(solved(spark, hub).values()) == {1}
    pairs = [(rng.randint(-50, 500), rng.randint(-50, 500)) for _ in range(300)]
    assert solved(spark, pairs) == expected(pairs)


def test_a_star_of_half_a_million_leaves(spark):
    """Hub, chain of hubs and a bridge, with keys followed by broadcast."""
    leaves = spark.range(500_000).selectExpr("5L AS src", "id + 1000 AS dst")
    more = spark.createDataFrame([(5, 3), (3, 7), (7, 600_000), (2_000_000, 2_000_001)], "src long, dst long")
    got = groups.connected(leaves.unionByName(more), hot_rows=50_000)
    assert sorted(tuple(r) for r in got.groupBy("component").count().collect()) == [(3, 500_004), (2_000_000, 2)]


@pytest.mark.parametrize("hot_rows", [5, 1_000_000])
def test_hot_ids_are_followed_alike(spark, hot_rows):
    rng = random.Random(12)
    pairs = [(rng.randint(1, 200), rng.randint(1, 200)) for _ in range(120)] + [(50, 300 + k) for k in range(60)] + [(k, 60) for k in range(400, 440)]
    got = {r.id: r.component for r in groups.connected(links(spark, pairs), hot_rows=hot_rows).collect()}
    assert got == expected(pairs)


@pytest.mark.parametrize("hot_rows", [1_000_000, 5])
def test_photo_groups_match_brute_force(spark, photos_of, hot_rows):
    rows = messy_photos(300, 11)
    rng = random.Random(2)
    kinds = ["exact", "VISUAL", "time", None, "rejected", "Exact"]
    recorded = [(rng.randint(1, 330), rng.randint(1, 330), rng.choice(kinds)) for _ in range(60)] + [(4, 4, "exact"), (None, 3, "exact")]
    now = now_of(rows)
    pairs = []
    for x in now.values():
        for y in now.values():
            if x[0] < y[0] and x[1] and x[1] == y[1]:
                path = [p[3].upper().replace("/", "\\") for p in (x, y)]
                if (
                    (usable_sha(x[10]) and usable_sha(x[10]) == usable_sha(y[10])) or path[0] == path[1]
                    or (x[9] and y[9] and distance(x[9], y[9]) <= 8)
                    or any({a, b} == {x[0], y[0]} and (k or "").lower() in ("exact", "visual") for a, b, k in recorded)
                ):
                    pairs.append((x[0], y[0]))
    edges = spark.createDataFrame(recorded, "src long, dst long, kind string").selectExpr("*", "1 AS library", "2 AS seq")
    ties = groups.photo_ties(photos_of(rows), edges, hot_rows=hot_rows)
    got = {r.id: r.component for r in groups.connected(ties, "u", "v").collect()}
    assert got == expected(pairs)


def test_empty_tables(spark, photos_of):
    edges = spark.createDataFrame([], "src long, dst long, kind string")
    assert groups.photo_groups(photos_of([]), edges).count() == 0
    assert groups.photo_groups(photos_of([photo(1, None, 7), photo(2, None, 7)]), edges).count() == 0


def test_near_groups_match_brute_force(spark, photos_of):
    rows = messy_photos(300, 21) + [photo(900 + k, "copies", 0xFF00, "%064x" % 7) for k in range(4)]
    rows += [photo(950, "mixed", 5, "%064x" % 8), photo(951, "mixed", 5, "%064x" % 8), photo(952, "mixed", 5, None)]
    now = [r for r in now_of(rows).values() if r[1] and r[9]]
    pairs = [
        (x[0], y[0]) for x in now for y in now
        if x[0] < y[0] and x[1] == y[1] and distance(x[9], y[9]) <= 8 and not (usable_sha(x[10]) and usable_sha(x[10]) == usable_sha(y[10]))
    ]
    got = {r.seq: (r.component, r.representative) for r in groups.near_groups(photos_of(rows)).collect()}
    assert {s: c for s, (c, _) in got.items()} == expected(pairs)
    first = {}
    for r in now:
        first[r[1], r[9]] = min(r[0], first.get((r[1], r[9]), r[0]))
    assert {s: f for s, (_, f) in got.items()} == {r[0]: first[r[1], r[9]] for r in now if r[0] in got}
    assert groups.near_groups(photos_of([])).count() == 0
