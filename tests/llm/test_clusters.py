import random

import numpy as np
import pyarrow as pa

from loupe.llm import clusters
from tests.llm.conftest import components, distance, messy_photos, now_of, photo


def brute(rows):
    now = [p for p in now_of(rows).values() if p[1] is not None]
    pairs = []
    for x in now:
        for y in now:
            if x[0] < y[0] and x[1] == y[1]:
                near = x[9] and y[9] and distance(x[9], y[9]) <= 8
                close = x[8] and y[8] and abs((x[8] - y[8]).total_seconds()) <= 1800
                if near or close:
                    pairs.append((x[0], y[0]))
    label = components([p[0] for p in now], pairs)
    by = {}
    for p in now:
        by.setdefault(label[p[0]], []).append(p)
    out = {}
    for c, members in by.items():
        if len(members) >= 2:
            hashed = [p for p in members if p[9]]
            out[c] = (min((sum(distance(p[9], q[9]) for q in hashed), p[0]) for p in hashed)[1] if hashed else c, len(members))
    return out


def test_matches_brute_force(photos_of):
    rows = messy_photos(300, 21)
    got = clusters.alike_clusters(photos_of(rows)).collect()
    assert {r.cluster: (r.typical, r.n) for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_boundary_of_the_gap_and_no_hash(photos_of):
    rows = [photo(1, t=0), photo(2, t=1800), photo(3, t=3600.000001), photo(5, "b", t=0), photo(4, "b", t=0), photo(9, None, t=0), photo(8, None, t=0)]
    got = {r.cluster: (r.typical, r.n) for r in clusters.alike_clusters(photos_of(rows)).collect()}
    assert got == {1: (1, 2), 4: (4, 2)} == brute(rows)


def test_hash_all_ones_counts(photos_of):
    rows = [photo(1, dhash=(1 << 64) - 1), photo(2, dhash=(1 << 64) - 2), photo(3, dhash=(1 << 64) - 4)]
    got = {r.cluster: (r.typical, r.n) for r in clusters.alike_clusters(photos_of(rows)).collect()}
    assert got == brute(rows)


def test_empty(photos_of):
    assert clusters.alike_clusters(photos_of([])).count() == 0
    assert clusters.kmeans_clusters(photos_of([])).count() == 0


def test_kmeans_separates_clear_groups_and_repeats_exactly(photos_of):
    rows, seq = [], 0
    bases = [0x00000000FFFFFFFF, 0xFFFFFFFF00000000, 0x5555555555555555]
    for k, base in enumerate(bases):
        for i in range(12):
            seq += 1
            rows.append(photo(seq, dhash=base ^ (1 << i), t=k * 10_000_000 + i))
    rows += [photo(99, "lone", dhash=None, t=None), photo(100, None, dhash=5)]
    from pyspark.sql import functions as F

    df = photos_of(rows)
    options = {"k_of": F.least(F.col("n"), F.lit(3)), "block_rows": 5}
    got = sorted((r.library, r.n, r.typical) for r in clusters.kmeans_clusters(df, **options).collect())
    assert [(x, n) for x, n, _ in got] == [("a", 12)] * 3 + [("lone", 1)]
    assert {(t - 1) // 12 for x, _, t in got if x == "a"} == {0, 1, 2}
    again = sorted((r.library, r.n, r.typical) for r in clusters.kmeans_clusters(df.repartition(3), **options).collect())
    assert again == got


def _random_library(n, seed):
    rng = random.Random(seed)
    return [photo(i, dhash=rng.getrandbits(64), t=rng.randint(0, 30_000)) for i in range(1, n + 1)]


def _kmeans(df, **options):
    return sorted((r.library, r.n, r.typical) for r in clusters.kmeans_clusters(df, **options).collect())


def test_kmeans_goes_on_until_centres_rest_and_blocks_do_not_matter(photos_of):
    df = photos_of(_random_library(2000, 3))
    whole = _kmeans(df)
    assert _kmeans(df, lloyd_rounds=4) != whole == _kmeans(df, lloyd_rounds=200)
    assert sum(n for _, n, _ in whole) == 2000
    # seeds follow the cost of the library, so that cutting it into blocks changes nothing
    assert _kmeans(df, block_rows=700) == whole


def test_kmeans_finds_a_planted_mixture(spark, photos_of):
    """Forty groups of like pictures in bursts: pairs put together or apart as planted, in 95 of 100 cases at least."""
    rng, rows, truth = random.Random(8), [], {}
    for g in range(40):
        base, start = rng.getrandbits(64), g * 500_000
        for _ in range(rng.randint(30, 80)):
            seq, h = len(rows) + 1, base
            for b in rng.sample(range(64), rng.randint(0, 5)):
                h ^= 1 << b
            truth[seq] = g
            rows.append(photo(seq, dhash=h, t=start + rng.randint(0, 1500)))
    from pyspark.sql import functions as F

    found = clusters.kmeans_clusters(photos_of(rows), k_of=F.lit(40), block_rows=500).collect()
    assert sum(r.n for r in found) == len(rows) and len(found) <= 40
    cells = {}
    for r in clusters.kmeans_clusters(photos_of(rows), k_of=F.lit(40), block_rows=500, members=True).collect():
        cells.setdefault(r.c, []).append(r.seq)
    assert sorted(map(len, cells.values())) == sorted(r.n for r in found)
    assert sum(max(np.bincount([truth[s] for s in c])) for c in cells.values()) >= 0.95 * len(rows)


def test_seeds_follow_the_cost_of_the_library():
    seq = np.arange(1, 1001)
    u = (seq * 104_729) % (1 << 20)

    def block(bits):  # photos that differ from the centre in so many bits
        return pa.table({
            "library": ["a"] * 1000, "k": [50] * 1000, "u": u, "dhash": pa.array([(1 << bits) - 1] * 1000, pa.int64()),
            "slot": pa.array([None] * 1000, pa.int64()),
        })

    centre = clusters._table_features(block(0).slice(0, 1))
    total = sum(clusters._cost_block(block(b), clusters._rows_of("a", [0], [1], centre)).column("cost")[0].as_py() for b in (1, 39))
    centres = clusters._rows_of("a", [0], [1], centre).append_column("cost", pa.array([total]))
    few, many = (len(clusters._seed_block(block(b), centres, 2.0)) for b in (1, 39))
    assert few <= 10 and 60 <= many <= 140  # 2.5 and 97.5 of the 100 expected
