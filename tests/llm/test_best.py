from loupe.llm import best
from tests.llm.conftest import messy_photos, now_of, photo

MEMBER = "group_id long, seq long, path string, is_recommended boolean"


def members(spark, rows):
    return spark.createDataFrame(rows, MEMBER).selectExpr("*", "1 AS width", "2 AS place", "3 AS n")


def area(p):
    return p[6] * p[7] if (p[6] or 0) > 0 and (p[7] or 0) > 0 else 0


def rank(p):
    far = p[8] is None
    return (-area(p), -(p[4] or 0), far, p[8] if not far else 0, len(p[3]), p[3].upper(), p[0])


def test_matches_brute_force(spark, photos_of):
    rows = messy_photos(200, 4)
    now = now_of(rows)
    m = [(g, (g * 37 + k * k * 11) % 230 + 1, None, k == 0) for g in range(60) for k in range(g % 5 + 1)]
    m += m[:40] + [(None, 5, None, None), (7, None, None, None)]
    m += [(1000, s, None, None) for s in range(1, 230)]
    want = {}
    for g in {x[0] for x in m if x[0] is not None}:
        there = {s for gg, s, *_ in m if gg == g and s in now}
        if len(there) >= 2:
            want[g] = min((now[s] for s in there), key=rank)[0]
    got = best.best_members(members(spark, m), photos_of(rows)).collect()
    assert {r.group_id: r.seq for r in got} == want and len(got) == len(want)


def test_each_tie_break_decides(spark, photos_of):
    cases = [
        (photo(1, w=10, h=10), photo(2, w=70_000, h=70_000), 2),  # beyond 32 bits
        (photo(1, size=5), photo(2, size=9), 2),
        (photo(1, t=None), photo(2, t=50), 2),
        (photo(1, t=60), photo(2, t=50), 2),
        (photo(1, path="/long.jpg"), photo(2, path="/s.jpg"), 2),
        (photo(1, path="/ab"), photo(2, path="/a_"), 1),  # upper case: B before _
        (photo(9, path="/a"), photo(3, path="/A"), 3),
        (photo(1, w=None), photo(2, w=1, h=1), 2),
        (photo(1, w=-5, h=-5, size=1), photo(2, w=0, size=2), 2),
    ]
    for a, b, want in cases:
        m = members(spark, [(1, a[0], None, None), (1, b[0], None, None), (1, b[0], None, True)])
        assert [r.seq for r in best.best_members(m, photos_of([a, b])).collect()] == [want]


def test_small_groups_and_empty_tables(spark, photos_of):
    m = members(spark, [(1, 1, None, None), (1, 1, None, None), (2, 1, None, None), (2, 99, None, None)])
    assert best.best_members(m, photos_of([photo(1)])).count() == 0
    assert best.best_members(members(spark, []), photos_of([])).count() == 0


def test_built_record_takes_fields_from_the_most_trusted_that_has_them(spark, photos_of):
    rows = [photo(1, w=None, t=5, device=" ", loaded=1), photo(2, w=7, h=8, t=None, device="x", loaded=2), photo(3, w=9, h=9, t=9, device="y", loaded=0)]
    m = members(spark, [(1, 1, None, True), (1, 2, None, None), (1, 3, None, False)])
    (r,) = best.surviving_records(m, photos_of(rows)).collect()
    assert (r.seq, r.n, r.width, r.height, r.device) == (3, 3, 9, 9, "y")
    assert r.capture_time == rows[0][8]
