import numpy as np

from loupe.llm import diverse
from tests.llm.conftest import distance, messy_photos, now_of, photo

ASK = "slideshow_id long, library string, wanted int"


def similarity_of(rows):
    h = np.array([(r[9] or 0) & (1 << 64) - 1 for r in rows], dtype=np.uint64)
    t = np.array([np.nan if r[8] is None else (r[8] - rows[0][11]).total_seconds() * 1e6 for r in rows])
    return diverse.Similarity(h, np.array([bool(r[9]) for r in rows]), t)


def dense(s):
    m = np.zeros((s.n, s.n), dtype=np.float32)
    for j in range(s.n):
        cols, values = s.row(j)
        m[j, cols] = values
    return m


def test_similarities_match_the_formula():
    rows = list(now_of(messy_photos(80, 3)).values())
    m = dense(similarity_of(rows))
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            want = 0.0
            if a[9] and b[9]:
                want += diverse.HASH_WEIGHT * max(0, 1 - distance(a[9], b[9]) / diverse.HASH_REACH)
            if a[8] and b[8]:
                want += diverse.TIME_WEIGHT * max(0, 1 - abs((a[8] - b[8]).total_seconds()) * 1e6 / diverse.TIME_REACH)
            assert abs(m[i, j] - (1 if i == j else want)) < 1e-5


def plain_greedy(s, wanted):
    m = dense(s).astype(float)
    best, picks = np.zeros(s.n), []
    for _ in range(min(wanted, s.n)):
        gain = np.maximum(m - best, 0).sum(axis=1)
        gain[picks] = -1
        picks.append(int(gain.argmax()))
        best = np.maximum(best, m[picks[-1]])
    return picks, best.sum()


def value(s, picks):
    return dense(s)[picks].max(axis=0).sum()


def test_lazy_greedy_reaches_the_plain_greedy_value():
    rows = [r for r in now_of(messy_photos(200, 9)).values()]
    s = similarity_of(rows)
    picks, gains, nearest, best = diverse.lazy_greedy(s, np.ones(s.n), 30)
    assert len(set(picks)) == 30 and abs(value(s, picks) - plain_greedy(s, 30)[1]) < 1e-2
    assert np.allclose(best, dense(s)[picks].max(axis=0))
    assert (np.diff(gains) <= 1e-4).all() and set(nearest) <= set(range(30))


def test_two_rounds_come_close_to_one(spark, photos_of):
    rows = [r for r in messy_photos(900, 5) if r[1] == "hot"]
    asked = spark.createDataFrame([(1, "hot", 40)], ASK)
    got = [r.seq for r in diverse.varied_subsets(asked, photos_of(rows), block_rows=60).collect()]
    now = {k: r for k, r in now_of(rows).items()}
    order = sorted(now)
    s = similarity_of([now[k] for k in order])
    assert len(set(got)) == 40 and set(got) <= set(now)
    assert value(s, [order.index(x) for x in got]) >= 0.9 * plain_greedy(s, 40)[1]


def test_a_burst_gets_one_photo_before_others_go_without(spark, photos_of):
    rng = np.random.default_rng(2)
    rows = [photo(i, dhash=0xABCDEF, t=0) for i in range(1, 200)]
    rows += [photo(500 + i, dhash=int(rng.integers(1, 2**63)) * 2 + 1, t=100_000 * (i + 1)) for i in range(9)]
    asked = spark.createDataFrame([(1, "a", 10)], ASK)
    got = [r.seq for r in diverse.varied_subsets(asked, photos_of(rows)).collect()]
    assert sum(x < 500 for x in got) == 1 and len(got) == 10


def skewed_bursts(n, seed):
    """Ten bursts of very different sizes, each of one look and far apart in time, and ten photos that are like no other."""
    rng = np.random.default_rng(seed)
    looks = [int(x) * 2 + 1 for x in rng.integers(1, 2**63, 20)]
    sizes = [int(n * p) for p in (0.33, 0.20, 0.10, 0.08, 0.07, 0.06, 0.05, 0.04, 0.04, 0.03)] + [1] * 10
    rows, burst_of = [], {}
    for k, size in enumerate(sizes):
        for i in range(size):
            seq = len(rows) + 1
            burst_of[seq] = k
            rows.append(photo(seq, dhash=looks[k] ^ 1 << int(rng.integers(1, 64)), t=k * 1_000_000 + i % 600))
    return rows, burst_of


def _against_plain_greedy(spark, photos_of, merge_rows):
    rows, burst_of = skewed_bursts(2400, 3)
    asked = spark.createDataFrame([(1, "a", 10)], ASK)
    # 40 blocks of about 60 photos, of which a share of 3 * 10 / 40 would be one or two nominees
    got = [r.seq for r in diverse.varied_subsets(asked, photos_of(rows), block_rows=60, merge_rows=merge_rows).collect()]
    s = similarity_of(rows)
    plain, best = plain_greedy(s, 10)
    assert len(set(got)) == 10 and {burst_of[x] for x in got} == {burst_of[p + 1] for p in plain} == set(range(10))
    assert value(s, [x - 1 for x in got]) >= 0.95 * best


def test_many_blocks_small_request_and_skewed_bursts(spark, photos_of):
    _against_plain_greedy(spark, photos_of, diverse.MERGE_ROWS)


def test_merging_nominees_in_several_rounds(spark, photos_of):
    assert diverse._rounds(40, 3) == 4
    _against_plain_greedy(spark, photos_of, 30)


def test_requests(spark, photos_of):
    rows = messy_photos(120, 8)
    now = now_of(rows)
    asked = spark.createDataFrame(
        [(1, "b", 5), (2, "b", 3), (2, "b", 3), (3, "b", 10**6), (4, None, 3), (5, "b", None), (6, "b", 0), (7, "nowhere", 4), (8, "c", -1)], ASK
    ).selectExpr("*", "1 AS seq", "2 AS place", "3 AS n")
    got = diverse.varied_subsets(asked, photos_of(rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.slideshow_id, []).append((r.place, r.seq))
    here = {k for k, r in now.items() if r[1] == "b"}
    assert set(by) == {1, 2, 3} and len(set(by[1])) == 5
    assert {s for _, s in by[3]} == here and [p for p, _ in sorted(by[3])] == list(range(1, len(here) + 1))
    # an order per library: smaller requests are its beginning
    assert set(by[2]) == set(sorted(by[1])[:3]) or len(here) > 5
    again = diverse.varied_subsets(asked, photos_of(rows).repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_empty_tables(spark, photos_of):
    assert diverse.varied_subsets(spark.createDataFrame([], ASK), photos_of([])).count() == 0
    assert diverse.varied_subsets(spark.createDataFrame([(1, "a", 3)], ASK), photos_of([])).count() == 0
