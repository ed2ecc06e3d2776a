import numpy as np
import pytest

from loupe.functions import bits
from loupe.llm import near
from tests.llm.conftest import distance, messy_photos, now_of, photo, usable_sha


def brute(rows, most=8):
    now = list(now_of(rows).values())
    out = set()
    for x in now:
        for y in now:
            if x[0] < y[0] and x[1] and x[1] == y[1] and x[9] and y[9] and distance(x[9], y[9]) <= most:
                a, b = usable_sha(x[10]), usable_sha(y[10])
                if a is None or a != b:
                    out.add((x[0], y[0]))
    return out


@pytest.mark.parametrize("most", [0, 1, 3, 8, 11])
def test_index_finds_what_comparing_all_finds(most):
    rng = np.random.default_rng(most)
    h = rng.integers(0, 2**64, 900, dtype=np.uint64)
    for i in range(450):
        x = h[i]
        for b in rng.choice(64, rng.integers(0, most + 3), replace=False):
            x ^= np.uint64(1) << np.uint64(b)
        h[450 + i] = x
    h = np.unique(h)
    got = [(int(a), int(b)) for i, j in near.hash_pairs(h, most) for a, b in zip(i, j)]
    i, j = np.nonzero(np.triu(np.bitwise_count(h[:, None] ^ h[None, :]) <= most, 1))
    assert len(got) == len(set(got))
    assert set(got) == set(zip(i.tolist(), j.tolist()))


def test_one_differing_bit_in_each_byte_is_found():
    h = np.array([0, 0x0101010101010101, 0x8040201008040201, 0x0303030303030303], dtype=np.uint64)
    got = {(int(a), int(b)) for i, j in near.hash_pairs(h, 8) for a, b in zip(i, j)}
    assert (0, 1) in got and (0, 2) in got and (0, 3) not in got


@pytest.mark.parametrize("limit", [60_000, 40, 3])
def test_photos_match_brute_force_however_groups_are_cut(photos_of, limit):
    rows = messy_photos()
    got = [tuple(r) for r in near.near_photos(photos_of(rows), limit=limit).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_deeper_levels_lose_nothing(photos_of):
    rows = [r for r in messy_photos(150, 3)]
    thin = near.levels(8)
    assert thin[0] == 1 and thin == sorted(thin)
    got = [tuple(r) for r in near.near_photos(photos_of(rows), limit=1 / 200).collect()]  # forces three shared segments
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_many_copies_of_one_file_make_no_pairs_but_find_others(photos_of):
    sha = "a" * 64
    rows = [photo(i, "hot", 0xF0F0, sha) for i in range(1, 301)] + [photo(999, "hot", 0xF0F1, None)]
    got = {tuple(r) for r in near.near_photos(photos_of(rows)).collect()}
    assert got == {(i, 999) for i in range(1, 301)}


def test_empty_and_null_only_tables(photos_of):
    assert near.near_photos(photos_of([])).count() == 0
    assert near.near_photos(photos_of([photo(1, None, 5), photo(2, None, 5), photo(3, "a", None), photo(4, "a", 0), photo(None, "a", 5)])).count() == 0


def test_distance_is_checked(photos_of):
    with pytest.raises(ValueError):
        near.near_pairs(photos_of([]), distance=16)


def test_regrouping_keeps_distances_and_agrees_with_the_column(spark):
    rng = np.random.default_rng(5)
    h = rng.integers(0, 2**64, 300, dtype=np.uint64)
    x = bits.regrouped(h)
    assert (np.bitwise_count(h[:, None] ^ h[None, :]) == np.bitwise_count(x[:, None] ^ x[None, :])).all()
    ones = bits.regrouped(np.uint64(1) << np.arange(64, dtype=np.uint64))
    assert len(set(ones.tolist())) == 64
    # each new byte has one bit of every old byte and of every place in a byte
    place = {int(v).bit_length() - 1: k for k, v in enumerate(ones.tolist())}
    for byte in range(8):
        old = [place[8 * byte + k] for k in range(8)]
        assert sorted(o // 8 for o in old) == list(range(8)) and sorted(o % 8 for o in old) == list(range(8))
    df = spark.createDataFrame([(int(v),) for v in h.view(np.int64)], "h long")
    got = [r.x for r in df.select(bits.regrouped_column("h").alias("x")).collect()]
    assert got == x.view(np.int64).tolist()


def test_hashes_with_cut_off_bits_do_not_meet_all(monkeypatch):
    rng = np.random.default_rng(6)
    h = np.unique(rng.integers(0, 2**53, 20_000, dtype=np.uint64) << np.uint64(11))
    met = []
    expand = near._expand
    monkeypatch.setattr(near, "_expand", lambda a, b: (met.append(int(b.sum())), expand(a, b))[1])
    found = sum(len(i) for i, _ in near.hash_pairs(bits.regrouped(h)))
    assert sum(met) < 0.1 * len(h) ** 2 / 2 and found < 100


def test_half_a_million_copies_of_one_hash_are_one_row_of_the_index(spark):
    """Equal hashes meet as one class; what ties them is followed by broadcast."""
    photos = spark.range(500_000).selectExpr("id AS seq", "'hot' AS library", "1234567L AS dhash").unionByName(
        spark.createDataFrame([(900_000, "hot", 1234566), (900_001, "hot", 1 << 40)], "seq long, library string, dhash long")
    )
    slim = photos.selectExpr("library AS grp", "seq AS id", "dhash AS hash", "cast(NULL AS string) AS same")
    assert near.near_classes(slim).classes.count() == 3
    ties = near.near_pairs(photos, expand=False, hot_rows=50_000)
    assert sorted(r.id_a for r in ties.filter("id_b >= 500000").collect()) == [0]
    assert ties.filter("id_a = 0").count() == 500_000
