"""Near-equal 64-bit hashes by an inverted index over byte positions (problem 5).

Method.  A hash is eight bytes at eight positions.  Two hashes at most 8 bits
apart need not share a single byte (one differing bit in each), so an index on
equal single bytes guarantees nothing.  What is guaranteed is

* of the four two-byte positions, one differs by at most 2 bits in position 0 or
  by at most 1 bit in positions 1 to 3 (otherwise the distance is at least
  3 + 2 + 2 + 2 = 9), and
* at least four of the eight bytes are equal up to one bit (otherwise five bytes
  differ by two bits or more, which makes 10).

The bytes are not those of the hash as it is.  Its 8 x 8 bits are regrouped along
diagonals first, which changes no distance: a new byte has one bit of each row and
of each column of the picture, so that flat rows or columns, or hashes whose last
bits are cut off, do not make one byte equal everywhere.

So posting lists are kept for each two-byte position.  Every hash looks up its
own value and the values up to the position's tolerance away; the bytes equal up
to one bit are tallied for each pair met, pairs below the guaranteed minimum are
dropped, and the rest is verified by the exact distance.  A pair is kept by the
first position that can meet it, so no pair comes out twice.  With n uniform
hashes this meets about n * n * 188 / 65,536 / 2 candidates instead of n * n / 2.

Distribution.  Rows with equal hashes are one class, formed by an aggregation that
combines before the shuffle; classes are compared, and their members multiplied out
by joins afterwards, if at all.  So a hash that very many rows have is one row of
one task.  Groups (libraries) are independent.  A group with more rows than
``limit`` is cut into blocks: the 64 bits are divided into t + c segments (t the
distance), of which any pair within t shares at least c; a block holds the hashes
with equal values in one choice of c segments, and a pair is kept in the block of
its first c equal segments only.  c grows with the group's size, so that blocks
of a group of any size stay near ``limit`` rows.  Which groups are cut changes
the cost, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.functions.bits import regrouped, regrouped_column
from loupe.functions.keys import NEAR_BITS, sha_key, usable_hash
from loupe.operators.current import current_photos
from loupe.session import HOT_ROWS, Scratch, follow, ship_code

#: Rows of a group that one task compares without cutting the group into blocks.
GROUP_LIMIT = 60_000
#: Candidates or results held at once by a task.
BATCH = 1 << 20
#: Hot groups (more than GROUP_LIMIT rows each) that may be broadcast.
HOT_GROUPS = 100_000
#: A block number holds the segments' values below this bit, their choice above.
CHOICE_SHIFT = 40

_NEAR_BYTE = np.bitwise_count(np.arange(256, dtype=np.uint8)) <= 1


@lru_cache(maxsize=None)
def _masks(tolerance: int) -> np.ndarray:
    """All 16-bit values of at most ``tolerance`` one bits."""
    every = np.arange(1 << 16, dtype=np.int32)
    return every[np.bitwise_count(every) <= tolerance]


def tolerances(distance: int) -> list[int]:
    """Bits each two-byte position may differ by; -1: the position is not needed."""
    each, more = divmod(distance + 1, 4)
    return [each - (p >= more) for p in range(4)]


def _expand(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and positions of the ranges [start, start + count)."""
    row = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return row, np.arange(len(row)) - before[row] + starts[row]


def _slices(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive slices whose counts sum to about ``most`` at the most."""
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield slice(at, to)
        at = to


def hash_pairs(hashes: np.ndarray, distance: int = NEAR_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of distinct (regrouped) 64-bit hashes at most ``distance`` bits apart."""
    h = hashes.astype(np.uint64, copy=False)
    n = len(h)
    if n < 2:
        return
    allowed = tolerances(distance)
    least = 8 - distance // 2
    symbols = h.view(np.uint16).reshape(n, 4)
    for p, tolerance in enumerate(allowed):
        if tolerance < 0:
            continue
        symbol = symbols[:, p].astype(np.int32)
        posting = np.argsort(symbol, kind="stable").astype(np.int32)
        count = np.bincount(symbol, minlength=1 << 16).astype(np.int32)
        start = (np.cumsum(count) - count).astype(np.int32)
        masks = _masks(tolerance)
        step = max(1, BATCH // len(masks))
        for low in range(0, n, step):
            probe = symbol[low : low + step, None] ^ masks[None, :]
            found = count[probe]
            row, mask = np.nonzero(found)
            lists, value = found[row, mask], probe[row, mask]
            row = row.astype(np.int32) + low
            for s in _slices(lists, BATCH):
                k, at = _expand(start[value[s]], lists[s])
                i, j = row[s][k], posting[at]
                keep = i < j
                i, j = i[keep], j[keep]
                x = h[i] ^ h[j]
                bits = np.bitwise_count(x.view(np.uint16).reshape(-1, 4))
                keep = np.ones(len(x), dtype=bool)
                for earlier in range(p):
                    keep &= bits[:, earlier] > allowed[earlier]
                i, j, x = i[keep], j[keep], x[keep]
                tally = _NEAR_BYTE[x.view(np.uint8).reshape(-1, 8)].sum(axis=1, dtype=np.int8)
                keep = tally >= least
                i, j, x = i[keep], j[keep], x[keep]
                keep = np.bitwise_count(x) <= distance
                if keep.any():
                    yield i[keep], j[keep]


def segments(distance: int, shared: int) -> list[tuple[int, int]]:
    """(shift, width) of distance + shared nearly equal parts of 64 bits."""
    edges = np.linspace(0, 64, distance + shared + 1).round().astype(int)
    return [(int(a), int(b - a)) for a, b in zip(edges, edges[1:])]


def levels(distance: int) -> list[float]:
    """Blocks per segment choice, by level: how far level c thins a group out."""
    return [2.0 ** (64 * c / (distance + c)) for c in range(4)]


def _block_columns(hash_col: str, distance: int, shared: int):
    """Block numbers of one hash at a level: choice number and segment values."""
    if shared == 0:
        return F.array(F.lit(0).cast("long"))
    h = F.col(hash_col)
    parts = [F.shiftrightunsigned(h, a).bitwiseAND(F.lit((1 << w) - 1).cast("long")) for a, w in segments(distance, shared)]
    widths = [w for _, w in segments(distance, shared)]
    blocks = []
    for number, choice in enumerate(combinations(range(len(parts)), shared)):
        value = F.lit(0).cast("long")
        for part in choice:
            value = F.shiftleft(value, widths[part]).bitwiseOR(parts[part])
        blocks.append(value.bitwiseOR(F.lit(number << CHOICE_SHIFT).cast("long")))
    return F.array(*blocks)


def _owned(x: np.ndarray, distance: int, shared: int, block: int) -> np.ndarray:
    """Which differences have this block's segments as their first equal ones."""
    if shared == 0:
        return np.ones(len(x), dtype=bool)
    parts = segments(distance, shared)
    choices = list(combinations(range(len(parts)), shared))
    chosen = set(choices[block >> CHOICE_SHIFT])
    keep = np.ones(len(x), dtype=bool)
    for p in range(max(chosen) + 1):
        a, w = parts[p]
        equal = (x >> np.uint64(a)) & np.uint64((1 << w) - 1) == 0
        keep &= equal if p in chosen else ~equal
    return keep


_PAIR = ["id_a", "id_b", "many", "class_a", "class_b"]


def _class_pairs(table: pa.Table, distance: int, shared: int, block: int) -> Iterator[pa.RecordBatch]:
    """Pairs (_PAIR) of the near classes of one block.

    Two classes of one and the same known ``same`` value make no pair; class_a and
    class_b are these values, where the pair is to be multiplied out.
    """
    table = table.combine_chunks()
    first, n = table.column("first").to_numpy(), table.column("n").to_numpy()
    h = regrouped(table.column("hash").to_numpy().view(np.uint64))
    values = pa.concat_arrays(table.column("same").chunks) if table.num_rows else table.column("same").combine_chunks()
    same = values.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    for i, j in hash_pairs(h, distance):
        keep = (same[i] < 0) | (same[i] != same[j])
        if shared:
            keep &= _owned(h[i] ^ h[j], distance, shared, block)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        swap = first[i] > first[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        many = (n[i] > 1) | (n[j] > 1)
        of = [values.take(pa.array(np.where(many, k, 0), mask=~many)) for k in (i, j)]
        yield pa.RecordBatch.from_arrays([pa.array(first[i]), pa.array(first[j]), pa.array(many), *of], _PAIR)


class NearClasses(NamedTuple):
    """Near hashes by class, a class being the rows of one group with one hash.

    classes: grp, hash, first (smallest id), n, same (the value all its rows have, or
    null); pairs: id_a < id_b, first ids of near classes, ``many``, whether one of
    them has several rows, and then their ``same``; rows: bound of the number of rows.
    """

    classes: DataFrame
    pairs: DataFrame
    rows: int


def near_classes(
    slim: DataFrame, *, distance: int = NEAR_BITS, limit: int = GROUP_LIMIT, sizes: DataFrame | None = None, group: str = "library"
) -> NearClasses:
    """Classes and pairs of near classes of ``slim`` (grp, id, hash and, where rows can be copies, same; no null but in same)."""
    if not 0 <= distance <= 15:
        raise ValueError("distance must lie between 0 and 15 bits")
    ship_code(slim.sparkSession)
    sized = (F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    if "same" in slim.columns:
        one = (F.count("same") == F.count(F.lit(1))) & (F.min("same") == F.max("same"))
        classes = slim.groupBy("grp", "hash").agg(*sized, F.when(one, F.min("same")).alias("same"))
    else:  # aggregated by hashing, as there are only numbers to keep
        classes = slim.groupBy("grp", "hash").agg(*sized).withColumn("same", F.lit(None).cast("string"))
    counted = slim.groupBy("grp").agg(F.count("*").alias("n")) if sizes is None else sizes.select(F.col(group).alias("grp"), "n")
    thin = levels(distance)
    level = F.lit(len(thin) - 1)
    for c in reversed(range(len(thin) - 1)):
        level = F.when(F.col("n") <= F.lit(float(limit) * thin[c]), F.lit(c)).otherwise(level)
    counted = counted.filter(F.col("grp").isNotNull()).withColumn("level", level)
    # at most four rows: groups and rows by level
    seen = counted.groupBy("level").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups")).collect()
    present = sorted(r["level"] for r in seen if r["level"])
    spread = classes
    if present:
        hot = counted.filter("level > 0").select("grp", "level")
        few = sum(r["groups"] for r in seen if r["level"]) <= HOT_GROUPS
        spread = spread.withColumn("mixed", regrouped_column("hash"))
        spread = spread.join(F.broadcast(hot) if few else hot, "grp", "left").withColumn("level", F.coalesce("level", F.lit(0)))
        blocks = _block_columns("mixed", distance, 0)
        for c in present:
            blocks = F.when(F.col("level") == c, _block_columns("mixed", distance, c)).otherwise(blocks)
        spread = spread.withColumn("block", F.explode(blocks)).drop("mixed")
    else:
        spread = spread.withColumns({"level": F.lit(0), "block": F.lit(0).cast("long")})

    def pairs(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, shared, block = (k.as_py() for k in key)
        got = list(batches)
        if sum(b.num_rows for b in got) < 2:
            return
        yield from _class_pairs(pa.Table.from_batches(got), distance, shared, block)

    kind = classes.schema["same"].dataType.simpleString()
    found = spread.groupBy("grp", "level", "block").applyInArrow(pairs, f"id_a long, id_b long, many boolean, class_a {kind}, class_b {kind}")
    return NearClasses(classes, found, sum(r["rows"] for r in seen))


def class_members(slim: DataFrame, near: NearClasses, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(first, id and, where ``slim`` has it, same) of the rows of all classes of several rows."""
    many = near.classes.filter("n > 1").select("grp", "hash", "first")
    return follow(slim, many, ["grp", "hash"], near.rows, hot_rows=hot_rows).drop("grp", "hash")


def near_pairs(
    rows: DataFrame,
    *,
    group: str = "library",
    id: str = "seq",  # noqa: A002 - column name parameter
    hash: str = "dhash",  # noqa: A002
    same: str | None = None,
    distance: int = NEAR_BITS,
    limit: int = GROUP_LIMIT,
    sizes: DataFrame | None = None,
    expand: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Pairs (``id_a`` < ``id_b``) of rows of one group whose hashes are close.

    rows: one row per id; they are read several times.  Rows with a null group, id
    or hash are left out, rows of the same non-null ``same`` value are not paired
    (they are copies).  Equal hashes count as close.  sizes: (group, n) upper bounds
    of the group sizes, if known more cheaply than by counting ``rows``.  Without
    ``expand`` copies are not multiplied out: ids with equal hashes are tied to the
    smallest of them, which alone is paired with the smallest ids of the near hashes.
    An empty table gives no pairs; other columns are not read.  hot_rows: see ``follow``.
    """
    slim = rows.select(
        F.col(group).alias("grp"), F.col(id).cast("long").alias("id"), F.col(hash).cast("long").alias("hash"),
        *([(F.col(same) if same else F.lit(None).cast("string")).alias("same")] if expand else []),
    ).filter(F.col("grp").isNotNull() & F.col("id").isNotNull() & F.col("hash").isNotNull())
    if not expand:
        near = near_classes(slim, distance=distance, limit=limit, sizes=sizes, group=group)
        copies = class_members(slim, near, hot_rows).filter("id != first").select(F.col("first").alias("id_a"), F.col("id").alias("id_b"))
        return near.pairs.select("id_a", "id_b").unionByName(copies)
    scratch = Scratch(rows.sparkSession, "near")
    near = near_classes(slim, distance=distance, limit=limit, sizes=sizes, group=group)
    members, _ = scratch.cut(class_members(slim, near, hot_rows).select("first", "id", "same"), "members")
    pairs, _ = scratch.cut(near.pairs, "pairs")
    differ = ~F.coalesce(F.col("same_a") == F.col("same_b"), F.lit(False))
    a, b = members.toDF("id_a", "a", "same_a"), members.toDF("id_b", "b", "same_b")
    spread = pairs.filter("many").join(a, "id_a", "left").join(b, "id_b", "left").select(
        F.coalesce("a", "id_a").alias("a"), F.coalesce("b", "id_b").alias("b"),
        F.coalesce("same_a", "class_a").alias("same_a"), F.coalesce("same_b", "class_b").alias("same_b"),
    )
    x, y = members.toDF("first", "a", "same_a"), members.toDF("first", "b", "same_b")
    equal = x.join(y, "first").filter("a < b").select("a", "b", "same_a", "same_b")
    multiplied = spread.unionByName(equal).filter(differ).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
    return pairs.filter("NOT many").select("id_a", "id_b").unionByName(multiplied)


def group_sizes(photos: DataFrame, group: str = "library") -> DataFrame:
    """Rows per group of the raw table, read from that one column: bounds from above."""
    return photos.groupBy(group).agg(F.count("*").alias("n"))


def near_photos(photos: DataFrame, *, distance: int = NEAR_BITS, limit: int = GROUP_LIMIT) -> DataFrame:
    """Pairs (``seq_a`` < ``seq_b``) of photos of one library whose pictures are nearly equal.

    Only the current row of each ``seq`` counts.  Photos with a null library or
    seq, or with a null or zero ``dhash``, are in no pair.  Photos with equal
    usable ``sha256`` are the same file and make no pair; an unusable one equals
    nothing.  Every pair comes once.
    """
    now = _hashed_photos(photos)
    pairs = near_pairs(now, same="file", distance=distance, limit=limit, sizes=group_sizes(photos))
    return pairs.select(F.col("id_a").alias("seq_a"), F.col("id_b").alias("seq_b"))


def _hashed_photos(photos: DataFrame) -> DataFrame:
    """Current photos with a library and a usable hash (seq, library, dhash, file), as a written table."""
    now = current_photos(photos, "library", usable_hash("dhash").alias("dhash"), sha_key("sha256").alias("file"))
    now, _ = Scratch(photos.sparkSession, "hashed").cut(now.filter("library IS NOT NULL AND dhash IS NOT NULL"), "now")
    return now
