import datetime as dt
import random

import pytest

PHOTO = (
    "seq long, library string, device string, path string, file_size long, format string, width int, height int, "
    "capture_time timestamp_ntz, dhash long, sha256 string, loaded_at timestamp_ntz"
)
T0 = dt.datetime(2020, 5, 1, 12)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def photo(seq, library="a", dhash=None, sha=None, path=None, t=None, size=1, w=10, h=10, device="cam", loaded=0, fmt="Jpeg"):
    return (
        seq, library, device, path if path is not None else f"/p/{seq}.jpg", size, fmt, w, h,
        None if t is None else T0 + dt.timedelta(seconds=t), None if dhash is None else signed(dhash), sha,
        T0 + dt.timedelta(days=loaded),
    )


@pytest.fixture(scope="session")
def photos_of(spark):
    def make(rows, extra=True):
        df = spark.createDataFrame(rows, PHOTO)
        if extra:  # columns an operator must not trip over
            df = df.selectExpr("*", "seq AS n", "library AS cluster", "1 AS id", "'x' AS component", "0 AS block", "1 AS level", "1 AS node")
        return df

    return make


def now_of(rows):
    """Current rows by seq, as plain Python."""
    best = {}
    for r in rows:
        if r[0] is not None and (r[0] not in best or best[r[0]][11] < r[11]):
            best[r[0]] = r
    return best


def usable_sha(s):
    s = (s or "").strip().lower()
    return s if len(s) == 64 and all(c in "0123456789abcdef" for c in s) else None


def distance(a, b):
    return bin((a ^ b) & (1 << 64) - 1).count("1")


def components(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def messy_photos(n=400, seed=7):
    """Photos with near hashes, copies, nulls, repeats, superseded rows and a hot library."""
    rng = random.Random(seed)
    rows = []
    base = [rng.getrandbits(64) for _ in range(n // 8)]
    shas = [f"{rng.getrandbits(256):064x}" for _ in range(n // 6)]
    for seq in range(1, n + 1):
        h = rng.choice(base)
        for b in rng.sample(range(64), rng.randint(0, 9)):
            h ^= 1 << b
        rows.append(photo(
            seq, rng.choice(["hot", "hot", "b", "c", None]), rng.choice([h, h, h, h, 0, None]),
            rng.choice([None, "pending", " " + rng.choice(shas).upper() + " ", rng.choice(shas)]),
            rng.choice([f"C:\\x\\{rng.randint(1, n)}.jpg", f"c:/X/{rng.randint(1, n)}.JPG"]),
            rng.choice([None, rng.randint(0, 400_000)]), rng.choice([1, 2, 3]), rng.choice([None, 0, 5, 70_000]), rng.choice([5, 70_000]),
            rng.choice([None, " Cam-1", "cam-1", "CAM-2 "]), rng.randint(0, 3),
        ))
    for r in rng.sample(rows, n // 8):
        rows.append(r)  # delivered twice
    for r in rng.sample(rows[:n], n // 8):
        old = list(r)
        old[9], old[1], old[11] = signed(rng.getrandbits(64)), "b", old[11] - dt.timedelta(days=9)
        rows.append(tuple(old))
    rng.shuffle(rows)
    return rows
