"""Similarity clusters of photos, their size and their most typical member (problem 6).

Two operators.

``alike_clusters`` gives the clusters TESTDATA.md defines: everything alike
directly or through others.  Distributed k-means cannot give these, since it cuts
such chains wherever a cell ends, so the clusters come from connected components;
the typical member is still the member nearest the cluster's centroid, the
centroid being the mean of the members' hash bits (the sum of bit distances to
all members is an L1 distance to it, so no pair of members is compared).

``kmeans_clusters`` is the named method: hashed weighted features, seeds by
parallel oversampling, Lloyd steps, members nearest each centroid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupe.functions.keys import GAP_SECONDS, NEAR_BITS, micros, usable_hash
from loupe.llm.groups import connected
from loupe.llm.near import group_sizes, near_pairs
from loupe.operators.current import current_photos
from loupe.operators.edges import slot_runs, time_slot
from loupe.session import Scratch, follow

GAP_US = GAP_SECONDS * 1_000_000
_LANES = 0x0000000100000001


def _bit_sums(hash_: str) -> list[Column]:
    """32 sums; sum j counts bit j in its lower and bit j + 32 in its upper 32 bits."""
    h = F.col(hash_)
    return [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_LANES).cast("long"))).alias(f"b{j}") for j in range(32)]


_CENTRE_BITS = "cluster long, n long, first long, hashed long, ones long, planes array<long>"


def _planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each cluster the sum of its 64 counts of one bits, and their binary digits: one 64-bit mask a digit, the highest first."""
    for batch in batches:
        packed = np.stack([batch.column(4 + j).fill_null(0).to_numpy().view(np.uint64) for j in range(32)], axis=1)
        ones = np.concatenate([packed & np.uint64(0xFFFFFFFF), packed >> np.uint64(32)], axis=1)
        digits = int(ones.max(initial=0)).bit_length()
        masks = np.zeros((len(ones), digits), dtype=np.uint64)
        for d in range(digits):
            bits = ((ones >> np.uint64(digits - 1 - d)) & np.uint64(1)).astype(np.uint8)
            masks[:, d] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
        used = np.logical_or.accumulate(masks > 0, axis=1)  # no leading zeros
        offsets = np.append(0, np.cumsum(used.sum(axis=1))).astype(np.int32)
        planes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(masks[used].view(np.int64)))
        sums = pa.array(ones.sum(axis=1).view(np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], sums, planes], ["cluster", "n", "first", "hashed", "ones", "planes"])


def _distance_sum(hash_: str) -> Column:
    """Sum of the bit distances of a hash to all hashes counted in ones and planes.

    Bit k adds the members that differ in it: its count of ones if it is 0, the rest if
    it is 1.  The counts of the bits that are 1 are summed digit by digit.
    """
    h = F.col(hash_)
    counted = F.aggregate("planes", F.lit(0).cast("long"), lambda acc, mask: acc * 2 + F.bit_count(mask.bitwiseAND(h)))
    return F.col("ones") + F.col("hashed") * F.bit_count(h) - 2 * counted


def alike_clusters(photos: DataFrame, *, distance: int = NEAR_BITS, gap_us: int = GAP_US) -> DataFrame:
    """(``cluster``, ``typical``, ``n``) of each cluster of two or more photos.

    Photos of a library are alike if their hashes are at most ``distance`` bits
    apart or their capture times at most the gap; a cluster is everything alike
    directly or through others, named by its smallest seq.  typical is the member
    with the smallest sum of distances to all members with a usable hash, the
    smallest seq of equals, and the smallest seq of the cluster where no member
    has one.  Photos with a null library are alike to none; missing values are
    alike to nothing; an empty table gives no rows.
    """
    spark = photos.sparkSession
    scratch = Scratch(spark, "alike")
    now = current_photos(photos, "library", usable_hash("dhash").alias("dhash"), micros("capture_time").alias("t"))
    now = now.filter(F.col("library").isNotNull()).select(F.col("library").alias("grp"), "seq", "dhash", "t").withColumn("slot", time_slot("t", gap_us))
    now, seen = scratch.cut(now, "now", n=F.count(F.lit(1)))
    n = seen["n"]
    runs = slot_runs(now, gap_us).select("grp", "slot", "node")
    timed = follow(now.filter("slot IS NOT NULL"), runs, ["grp", "slot"], n).select("seq", F.col("grp").alias("library"), "dhash", "node")
    rest = now.filter("slot IS NULL").select("seq", F.col("grp").alias("library"), "dhash", F.col("seq").alias("node"))
    nodes, _ = scratch.cut(timed.unionByName(rest), "nodes")

    # Photos of one run are one vertex.  Equal hashes tie their vertices to the first
    # of them; of the hashes near each other the first vertices are tied.
    hashed, _ = scratch.cut(nodes.filter("dhash IS NOT NULL").select("library", "dhash", "node").distinct(), "hashed")
    ties = near_pairs(hashed, id="node", distance=distance, sizes=group_sizes(photos), expand=False)
    links = connected(ties, "id_a", "id_b")

    placed = follow(nodes, links.toDF("node", "component"), "node", n, how="left").select(
        F.coalesce("component", "node").alias("cluster"), "seq", "dhash"
    )
    placed, _ = scratch.cut(placed, "placed")
    known = F.col("dhash").isNotNull()
    centres = placed.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.count("dhash").alias("hashed"), *_bit_sums("dhash")
    ).filter("n >= 2").mapInArrow(_planes, _CENTRE_BITS)
    centres, _ = scratch.cut(centres, "centres")
    nearest = (
        follow(placed.filter(known), centres.filter("hashed > 0"), "cluster", n)
        .select("cluster", "n", F.struct(_distance_sum("dhash").alias("sum"), "seq").alias("place"))
        .groupBy("cluster").agg(F.min("place").alias("place"), F.first("n").alias("n"))
        .select("cluster", F.col("place.seq").alias("typical"), "n")
    )
    blank = centres.filter("hashed = 0").select("cluster", F.col("first").alias("typical"), "n")
    return nearest.unionByName(blank)


# --- k-means over hashed weighted features ---------------------------------------

#: Weights of the features: looks, and the time slots a capture lies in.
BIT_WEIGHT, TIME_WEIGHT = 1.0, 3.0
TIME_DIMS = 32
DIMS = 64 + TIME_DIMS
SEED_ROUNDS = 3
#: Lloyd steps end when no centre of the library moves farther than TOLERANCE, at the latest after LLOYD_ROUNDS.
TOLERANCE, LLOYD_ROUNDS = 1e-4, 100
#: Photos of one block at least; and for each centre, so that the centres sent to blocks are few beside the photos.
BLOCK_ROWS, ROWS_PER_CENTRE = 100_000, 40
_CENTRE = "library string, c int, n long, vec array<float>"
_COST = "library string, cost double"
_STATE = f"{_CENTRE}, moving boolean"


def _features(hashes: np.ndarray, known: np.ndarray, slots: np.ndarray, timed: np.ndarray) -> np.ndarray:
    """Rows of DIMS numbers: 64 signed bits (0 where unknown), then the hashed time slots.

    A capture counts in its own slot of the gap's width and, by half, in the two
    beside it; slots are hashed to dimension and sign, so captures in one or in
    neighbouring slots agree and others meet by chance only.
    """
    out = np.zeros((len(hashes), DIMS), dtype=np.float32)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
    out[:, :64] = (bits * 2 - 1) * known[:, None] * np.float32(BIT_WEIGHT / 8)
    rows = np.flatnonzero(timed)
    for step, share in ((0, 1.0), (-1, 0.5), (1, 0.5)):
        x = (slots[rows] + step).astype(np.uint64)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        np.add.at(out, (rows, 64 + (x % np.uint64(TIME_DIMS)).astype(np.int64)),
                  np.where((x >> np.uint64(40)) & np.uint64(1), 1.0, -1.0) * share * TIME_WEIGHT / 4)
    return out


def _table_features(table: pa.Table) -> np.ndarray:
    h, slot = table.column("dhash"), table.column("slot")
    return _features(
        h.fill_null(0).to_numpy().view(np.uint64), h.is_valid().to_numpy(), slot.fill_null(0).to_numpy(), slot.is_valid().to_numpy()
    )


def _matrix(centres: pa.Table) -> np.ndarray:
    return centres.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS).astype(np.float32)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre and the squared distance to it, in slices."""
    which = np.empty(len(x), dtype=np.int64)
    far = np.empty(len(x), dtype=np.float32)
    norm = (centres * centres).sum(axis=1)
    step = max(1, (1 << 22) // max(1, len(centres)))
    for s in range(0, len(x), step):
        d = norm[None, :] - 2 * (x[s : s + step] @ centres.T)
        which[s : s + step] = d.argmin(axis=1)
        far[s : s + step] = np.maximum(d.min(axis=1) + (x[s : s + step] ** 2).sum(axis=1), 0)
    return which, far


def _rows_of(library, c, n, vec: np.ndarray) -> pa.Table:
    flat = pa.array(np.ascontiguousarray(vec, dtype=np.float32).ravel(), pa.float32())
    offsets = pa.array(np.arange(0, len(vec) * DIMS + 1, DIMS, dtype=np.int32))
    return pa.table({
        "library": pa.array([library] * len(vec), pa.string()), "c": pa.array(np.asarray(c, dtype=np.int32)),
        "n": pa.array(np.asarray(n, dtype=np.int64)), "vec": pa.ListArray.from_arrays(offsets, flat),
    })


def _cost_block(points: pa.Table, centres: pa.Table) -> pa.Table:
    """Sum of the squared distances of a block."""
    _, far = _nearest(_table_features(points), _matrix(centres))
    return pa.table({"library": pa.array([points.column("library")[0].as_py()], pa.string()), "cost": pa.array([far.sum(dtype=np.float64)])})


def _seed_block(points: pa.Table, centres: pa.Table, factor: float) -> pa.Table:
    """Points of a block that become candidates: with probability l d^2 / the library's cost, by a hash of their id.

    The cost is missing where the block is the library.
    """
    x = _table_features(points)
    _, far = _nearest(x, _matrix(centres))
    cost = centres.column("cost")[0].as_py()
    cost = float(far.sum(dtype=np.float64)) if cost is None else cost
    wanted = factor * points.column("k")[0].as_py()
    u = (points.column("u").to_numpy() % (1 << 20)) / float(1 << 20)
    take = u * cost < wanted * far if cost > 0 else np.zeros(len(x), dtype=bool)
    return _rows_of(points.column("library")[0].as_py(), np.zeros(take.sum()), np.ones(take.sum()), x[take])


def _sums(x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the centres that have members, how many, feature sums)."""
    which, _ = _nearest(x, m)
    count = np.bincount(which, minlength=len(m))
    sums = np.zeros((len(m), DIMS), dtype=np.float64)
    order = np.argsort(which, kind="stable")
    starts = np.flatnonzero(np.append(True, which[order][1:] != which[order][:-1]))
    sums[which[order][starts]] = np.add.reduceat(x[order], starts, axis=0)
    used = np.flatnonzero(count)
    return used, count[used], sums[used]


def _sum_block(points: pa.Table, centres: pa.Table) -> pa.Table:
    """Partial sums of a block: members and feature sums by nearest centre."""
    used, count, sums = _sums(_table_features(points), _matrix(centres))
    return _rows_of(points.column("library")[0].as_py(), centres.column("c").to_numpy()[used], count, sums)


def _far_moved(old: np.ndarray, new: np.ndarray) -> bool:
    return bool((((old - new) ** 2).sum(axis=1) > TOLERANCE**2).any())


def _two_nearest(x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest centre, the distance to it and to the second nearest, in slices."""
    which, near, second = np.empty(len(x), dtype=np.int64), np.empty(len(x)), np.empty(len(x))
    norm, step = (m * m).sum(axis=1), max(1, (1 << 22) // max(1, len(m)))
    for s in range(0, len(x), step):
        part = x[s : s + step]
        d = norm[None, :] - 2 * (part @ m.T)
        at, rows = d.argmin(axis=1), np.arange(len(part))
        own = (part * part).sum(axis=1)
        which[s : s + step], near[s : s + step] = at, d[rows, at] + own
        d[rows, at] = np.inf
        second[s : s + step] = d.min(axis=1) + own
    return which, np.sqrt(np.maximum(near, 0)), np.sqrt(np.maximum(second, 0))


#: Slack of the bounds, for the rounding of 32-bit distances.
_SLACK = 1e-3


def _lloyd_block(points: pa.Table, centres: pa.Table, rounds: int) -> pa.Table:
    """All Lloyd steps of a library that is one block.

    Bounds on the distance to the own and to any other centre (Hamerly, SDM 2010) tell
    which photos cannot have changed their centre; only the others are compared anew,
    so late steps, in which little moves, compare little.
    """
    centres = centres.sort_by("c")
    x, m, c = _table_features(points), _matrix(centres), centres.column("c").to_numpy()
    count = np.ones(len(m))
    which = near = second = None
    for _ in range(rounds):
        if which is None:
            which, near, second = _two_nearest(x, m)
        else:
            open_ = np.flatnonzero(near + _SLACK >= second)
            if len(open_):
                which[open_], near[open_], second[open_] = _two_nearest(x[open_], m)
        count = np.bincount(which, minlength=len(m))
        used = np.flatnonzero(count)
        order = np.argsort(which, kind="stable")
        starts = np.cumsum(count[used]) - count[used]
        moved = (np.add.reduceat(x[order], starts, axis=0, dtype=np.float64) / count[used][:, None]).astype(np.float32)
        going = _far_moved(m[used], moved)
        far = np.sqrt(((moved - m[used]) ** 2).sum(axis=1))
        fresh = np.zeros(len(m), dtype=np.int64)
        fresh[used] = np.arange(len(used))
        which = fresh[which]
        near, second = near + far[which], second - far.max(initial=0)
        m, c, count = moved, c[used], count[used]
        if not going:
            break
    return _rows_of(points.column("library")[0].as_py(), c, count, m)


def _typical_block(points: pa.Table, centres: pa.Table) -> pa.Table:
    """Per centre: the block's members, and the one nearest to it (smallest seq of equals)."""
    x, m = _table_features(points), _matrix(centres)
    which, far = _nearest(x, m)
    seq = points.column("seq").to_numpy()
    order = np.lexsort((seq, far, which))
    first = np.append(True, which[order][1:] != which[order][:-1])
    count = np.bincount(which, minlength=len(m))
    at = order[first]
    return pa.table({
        "library": pa.array([points.column("library")[0].as_py()] * len(at), pa.string()),
        "c": pa.array(centres.column("c").to_numpy()[which[at]].astype(np.int32)),
        "n": pa.array(count[which[at]].astype(np.int64)), "far": pa.array(far[at].astype(np.float64)), "seq": pa.array(seq[at]),
    })


_MEMBER, _TYPICAL = "library string, c int, seq long", "library string, c int, n long, far double, seq long"


def _member_block(points: pa.Table, centres: pa.Table) -> pa.Table:
    """Centre of each photo of a block."""
    which, _ = _nearest(_table_features(points), _matrix(centres))
    return pa.table({"library": points.column("library"), "c": centres.column("c").take(pa.array(which)), "seq": points.column("seq")})


def _no_member() -> pa.Table:
    return pa.table({"library": pa.array([], pa.string()), "c": pa.array([], pa.int32()), "seq": pa.array([], pa.int64())})


def _no_typical() -> pa.Table:
    kinds = {"library": pa.string(), "c": pa.int32(), "n": pa.int64(), "far": pa.float64(), "seq": pa.int64()}
    return pa.table({c: pa.array([], t) for c, t in kinds.items()})


def _no_cost() -> pa.Table:
    return pa.table({"library": pa.array([], pa.string()), "cost": pa.array([], pa.float64())})


def _reduce_seeds(table: pa.Table) -> pa.Table:
    """k seeds of a library's weighted candidates: k-means++ by greatest weighted distance."""
    m, w = _matrix(table), table.column("n").to_numpy().astype(np.float64)
    order = np.lexsort((*m.T[::-1], -w))
    m, w, k = m[order], w[order], table.column("k")[0].as_py()
    chosen = [0]
    far = ((m - m[0]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(m)) and (far * w).max() > 0:
        chosen.append(int((far * w).argmax()))
        far = np.minimum(far, ((m - m[chosen[-1]]) ** 2).sum(axis=1))
    return _rows_of(table.column("library")[0].as_py(), np.arange(len(chosen)), np.ones(len(chosen)), m[chosen])


def _mean(table: pa.Table) -> pa.Table:
    """New centres of a library from its blocks' sums."""
    c, n, m = table.column("c").to_numpy(), table.column("n").to_numpy(), _matrix(table).astype(np.float64)
    ids, place = np.unique(c, return_inverse=True)
    sums, count = np.zeros((len(ids), DIMS)), np.bincount(place, weights=n)
    np.add.at(sums, place, m)
    return _rows_of(table.column("library")[0].as_py(), ids, count, sums / count[:, None])


def _step(sums: pa.Table, centres: pa.Table) -> pa.Table:
    """New centres of a library, and whether any has moved far from where it was."""
    new, centres = _mean(sums), centres.sort_by("c")
    at = np.searchsorted(centres.column("c").to_numpy(), new.column("c").to_numpy())
    return new.append_column("moving", pa.array([_far_moved(_matrix(centres)[at], _matrix(new))] * len(new)))


def _alone(points: pa.Table, seed_rounds: int, lloyd_rounds: int, finish) -> pa.Table:
    """All steps of a library that is one block: the same rounds, with nothing between them to send."""
    candidates = _rows_of(points.column("library")[0].as_py(), [0], [1], _table_features(points.filter(points.column("first"))))
    for r in range(1, seed_rounds + 1):
        drawn = points.append_column("u", points.column(f"u{r}"))
        unknown = candidates.append_column("cost", pa.nulls(len(candidates), pa.float64()))
        candidates = pa.concat_tables([candidates, _seed_block(drawn, unknown, 2.0)])
    m = _matrix(candidates)
    m = m[np.lexsort(m.T[::-1])]
    used, count, _ = _sums(_table_features(points), m)
    k = points.column("k")[0].as_py()
    weighed = _rows_of(None, used, count, m[used]).append_column("k", pa.array([k] * len(used)))
    return finish(points, _lloyd_block(points, _reduce_seeds(weighed), lloyd_rounds))


def kmeans_clusters(
    photos: DataFrame, *, gap_us: int = GAP_US, seed_rounds: int = SEED_ROUNDS, lloyd_rounds: int = LLOYD_ROUNDS,
    block_rows: int = BLOCK_ROWS, k_of: Column | None = None, members: bool = False,
) -> DataFrame:
    """(``library``, ``c``, ``n``, ``typical``): k-means clusters of each library; with ``members`` (``library``, ``c``, ``seq``).

    k_of: clusters of a library as a function of its size ``n``; the root of half
    of it if not given.  Seeds come from parallel oversampling: in each round a
    photo becomes a candidate with a probability in proportion to its squared
    distance (2 k are expected per round of the whole library), candidates are
    weighted by the photos next to them and reduced to k.  Lloyd steps follow until no
    centre moves farther than ``TOLERANCE``, ``lloyd_rounds`` at most.  n counts the members, typical is the member
    nearest the centroid, the smallest seq of equals.  All choices hash the photo's
    seq, so a run is repeated exactly.  Photos with a null library are left out;
    missing hash or time leave their features at zero.

    A library is worked on in blocks of ``block_rows`` photos, or of ``ROWS_PER_CENTRE``
    for each of its clusters if that is more; what is gathered of
    it is candidates and sums, never photos.  A library of one block takes all its
    steps in one task, the others leave the Lloyd rounds as they come to rest.
    """
    scratch = Scratch(photos.sparkSession, "kmeans")
    now = current_photos(photos, "library", usable_hash("dhash").alias("dhash"), micros("capture_time").alias("t"))
    slot = F.expr(f"(t - pmod(t, {gap_us}L)) div {gap_us}L").alias("slot")
    now = now.filter(F.col("library").isNotNull()).select("seq", "library", "dhash", slot)
    sizes = now.groupBy("library").agg(F.count(F.lit(1)).alias("n"), F.min_by("seq", F.xxhash64("seq")).alias("start"))
    k = F.ceil(F.sqrt(F.col("n") / 2)) if k_of is None else k_of
    sizes = sizes.withColumn("k", F.greatest(F.lit(1), k.cast("int"))).withColumn(
        "blocks", F.ceil(F.col("n") / F.greatest(F.lit(block_rows), ROWS_PER_CENTRE * F.col("k")))
    )
    sizes, _ = scratch.cut(sizes, "sizes")
    points, _ = scratch.cut(
        now.join(sizes, "library").withColumn("block", F.pmod(F.xxhash64("seq"), "blocks")).withColumn("first", F.col("seq") == F.col("start")),
        "points",
    )

    large = sizes.filter("blocks > 1").select("library")
    kind = _MEMBER if members else _TYPICAL

    def chance(r: int) -> Column:
        return F.shiftrightunsigned(F.xxhash64("seq", F.lit(r)), 20)

    def alone(p: pa.Table) -> pa.Table:
        return _alone(p, seed_rounds, lloyd_rounds, _member_block if members else _typical_block)

    chances = (chance(r).alias(f"u{r}") for r in range(1, seed_rounds + 1))
    small = points.filter("blocks = 1").select("library", "seq", "dhash", "slot", "k", "first", *chances).groupBy("library").applyInArrow(alone, kind)
    points = points.filter("blocks > 1")
    if large.isEmpty():
        found = small
    else:
        found = small.unionByName(_in_blocks(scratch, points, sizes.filter("blocks > 1"), seed_rounds, lloyd_rounds, chance, members))
    if members:
        return found
    return found.groupBy("library", "c").agg(
        F.sum("n").alias("n"), F.min_by("seq", F.struct("far", "seq")).alias("typical")
    )


def _in_blocks(scratch: Scratch, points: DataFrame, sizes: DataFrame, seed_rounds: int, lloyd_rounds: int, chance, members: bool) -> DataFrame:
    """Typical members by block, or all members, of libraries of several blocks."""

    def over_blocks(function, centres: DataFrame, schema: str, salt: int = 0) -> DataFrame:
        """``function`` of every block of points and its library's centres."""
        spread = centres.join(sizes.select("library", "blocks"), "library").withColumn(
            "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        )
        empty = {_CENTRE: lambda: _rows_of(None, [], [], np.zeros((0, DIMS))), _COST: _no_cost, _MEMBER: _no_member, _TYPICAL: _no_typical}[schema]()

        def of(p: pa.Table, c: pa.Table) -> pa.Table:  # a block may have got no photo
            return function(p, c) if p.num_rows and c.num_rows else empty

        left = points.join(centres.select("library").distinct(), "library", "left_semi")
        left = left.select("library", "block", "seq", "dhash", "slot", "n", "k", chance(salt).alias("u"))
        return left.groupBy("library", "block").cogroup(spread.groupBy("library", "block")).applyInArrow(of, schema)

    start = points.filter("first").groupBy("library").applyInArrow(
        lambda t: _rows_of(t.column("library")[0].as_py(), [0], [1], _table_features(t)), _CENTRE
    )
    candidates, _ = scratch.cut(start, "seed-0")
    for r in range(1, seed_rounds + 1):
        costs = over_blocks(_cost_block, candidates, _COST).groupBy("library").agg(F.sum("cost").alias("cost"))
        fresh = over_blocks(lambda p, c: _seed_block(p, c, 2.0), candidates.join(costs, "library"), _CENTRE, r)
        candidates, _ = scratch.cut(candidates.unionByName(fresh), f"seed-{r}")
    numbered = candidates.withColumn("c", (F.row_number().over(Window.partitionBy("library").orderBy("vec")) - 1).cast("int"))
    numbered, _ = scratch.cut(numbered, "seeds")
    weighed = over_blocks(_sum_block, numbered, _CENTRE).groupBy("library", "c").agg(F.sum("n").alias("n"))
    weighed = numbered.drop("n").join(weighed, ["library", "c"]).join(sizes.select("library", "k"), "library")
    moving, seen = scratch.cut(weighed.groupBy("library").applyInArrow(_reduce_seeds, _CENTRE), "moving-0", rows=F.count(F.lit(1)))
    rested: DataFrame | None = None
    kept: set[str] = set()  # rounds in which a library came to rest
    for r in range(1, lloyd_rounds + 1):
        if not seen["rows"]:
            break
        sums = over_blocks(_sum_block, moving, _CENTRE)
        stepped = sums.groupBy("library").cogroup(moving.groupBy("library")).applyInArrow(_step, _STATE)
        stepped, seen = scratch.cut(stepped, f"moving-{r}", rows=F.count_if("moving"), still=F.count_if(~F.col("moving")))
        if seen["still"]:
            still = stepped.filter("NOT moving").drop("moving")
            rested = still if rested is None else rested.unionByName(still)
            kept.add(f"moving-{r}")
        moving = stepped.filter("moving").drop("moving")
        scratch.drop(*({f"moving-{r - 1}"} - kept))
    centres = moving if rested is None else rested.unionByName(moving)
    return over_blocks(_member_block, centres, _MEMBER) if members else over_blocks(_typical_block, centres, _TYPICAL)
