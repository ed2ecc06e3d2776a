"""Ties between photos of one library: same bytes, similar looks, close in time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupe.functions.bits import regrouped_column
from loupe.functions.keys import GAP_SECONDS, NEAR_BITS, hamming, micros
from loupe.operators.positions import with_previous
from loupe.session import Scratch, follow

#: Rows of a block that is compared with all rows of another, and pairs compared at once.
COMPARE_ROWS, COMPARE_SLICE = 4096, 1 << 22


#: Rows of the largest group up to which hashes meet by one, two, or else three equal parts.
SHARED_ROWS = (50_000, 3_000_000)


def _bands(distance: int, shared: int = 1) -> list[tuple[int, int]]:
    """(shift, width) of distance + shared nearly equal parts of 64 bits, of which close hashes have ``shared`` equal at least."""
    n = distance + shared
    edges = [round(64 * k / n) for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _shared(rows: DataFrame) -> int:
    """How many equal parts hashes of the groups ``grp`` of this size had best meet by."""
    most = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return 1 + sum(most > n for n in SHARED_ROWS)


def _part(h: Column, shift: int, width: int) -> Column:
    return h if width == 64 else F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _near_apart(distinct: DataFrame, distance: int, shared: int = 1) -> DataFrame:
    """(id_a, id_b, bits) of rows (grp, id, h) with different hashes h, at most ``distance`` bits apart.

    Of ``distance`` + ``shared`` parts hashes that close have ``shared`` equal at least,
    so the join is on the group, a choice of so many parts and their values; a pair
    counts in its first choice only, which spares a distinct.  More parts to a key
    mean more rows and far fewer candidates.  Parts are taken of the regrouped bits,
    so that pictures that are flat in places do not agree in a part by that alone.
    """
    parts = _bands(distance, shared)
    choices = list(combinations(range(len(parts)), shared))

    def value(h: Column, choice: tuple[int, ...]) -> Column:
        out = F.lit(0).cast("long")
        for k in choice:
            out = F.shiftleft(out, parts[k][1]).bitwiseOR(_part(h, *parts[k]))
        return out

    keys = F.array(*(F.struct(F.lit(k).alias("part"), value(F.col("h"), c).alias("value")) for k, c in enumerate(choices)))
    mixed = distinct.select("grp", "id", regrouped_column("h").alias("h"))
    cut = mixed.select("grp", "id", "h", F.explode(keys).alias("key")).select("grp", "id", "h", "key.part", "key.value")
    x, y = cut.alias("x"), cut.alias("y")
    differ = F.col("x.h").bitwiseXOR(F.col("y.h"))
    first: Column = F.lit(len(choices))
    for k, c in reversed(list(enumerate(choices))):
        equal = reduce(Column.__and__, (_part(differ, *parts[p]) == 0 for p in c))
        first = F.when(equal, F.lit(k)).otherwise(first)
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("grp", "part", "value")]
    return (
        x.join(y, [*same, F.col("x.id") < F.col("y.id"), hamming("x.h", "y.h") <= distance, first == F.col("x.part")])
        .select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"), hamming("x.h", "y.h").cast("int").alias("bits"))
    )


def near_hashes(hashes: DataFrame, *, group: str = "library", id: str = "seq", hash: str = "dhash", distance: int = NEAR_BITS, shared: int | None = None) -> DataFrame:  # noqa: A002
    """Pairs (``id_a``, ``id_b``, ``bits``) of one group at most ``distance`` bits apart.

    Each different hash is compared once, whatever the number of rows that have it;
    its rows are multiplied out last.  Each pair comes once, with id_a < id_b.  Rows
    with a null group, id or hash are in no pair.  shared: equal parts by which hashes
    meet, by the size of the largest group if not given; the result is the same.
    """
    scratch = Scratch(hashes.sparkSession, "near")
    h = F.col(hash)
    known = hashes.filter(F.col(group).isNotNull() & F.col(id).isNotNull() & h.isNotNull())
    known, seen = scratch.cut(known.select(F.col(group).alias("grp"), F.col(id).alias("id"), h.alias("h")), "known", n=F.count(F.lit(1)))
    firsts = known.groupBy("grp", "h").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    led = follow(known, firsts.drop("n"), ["grp", "h"], seen["n"]).select("first", "id")
    shared = shared or _shared(known)
    near = _near_apart(firsts.select("grp", F.col("first").alias("id"), "h"), distance, shared).unionByName(
        firsts.filter("n > 1").select(F.col("first").alias("id_a"), F.col("first").alias("id_b"), F.lit(0).alias("bits"))
    )
    a, b = led.toDF("fa", "a"), led.toDF("fb", "b")
    whole = near.join(a, F.col("id_a") == F.col("fa")).join(b, F.col("id_b") == F.col("fb")).filter("id_a != id_b OR a < b")
    return whole.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "bits")


def block_pairs(hashes: DataFrame, *, group: str = "library", id: str = "seq", hash: str = "dhash", rows: int = COMPARE_ROWS) -> DataFrame:  # noqa: A002
    """(``grp``, ``i``, ``j``, ``block``, ``id``, ``h``): the rows of blocks i <= j of a group, for every two of its blocks.

    Rows with a null group, id or hash are in no block.
    """
    known = hashes.filter(F.col(group).isNotNull() & F.col(id).isNotNull() & F.col(hash).isNotNull())
    known = known.select(F.col(group).alias("grp"), F.col(id).alias("id"), F.col(hash).alias("h"))
    sizes = known.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / rows).alias("blocks"))
    placed = known.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return placed.select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "h")


def near_in_blocks(table: pa.Table, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, ids, bits) of the pairs near each other of two blocks, or of one block with itself, in slices."""
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    block, ids, h = (table.column(c).to_numpy() for c in ("block", "id", "h"))
    h = h.view(np.uint64)
    x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
    step = max(1, COMPARE_SLICE // max(1, len(y)))
    for low in range(0, len(x), step):
        bits = np.bitwise_count(h[x[low : low + step]][:, None] ^ h[y][None, :])
        r, c = np.nonzero(bits <= distance)
        if i == j:
            once = r + low < c
            r, c = r[once], c[once]
        yield ids[x[low + r]], ids[y[c]], bits[r, c]


def compared_pairs(hashes: DataFrame, *, distance: int, **names) -> DataFrame:
    """What ``near_hashes`` gives, from comparing all pairs of a group block by block.

    For distances at which parts of a hash are too short to tell hashes apart.
    """
    schema = pa.schema([("id_a", pa.int64()), ("id_b", pa.int64()), ("bits", pa.int32())])

    def of(table: pa.Table) -> pa.Table:
        parts = [pa.table([np.minimum(a, b), np.maximum(a, b), bits.astype(np.int32)], schema=schema) for a, b, bits in near_in_blocks(table, distance)]
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return block_pairs(hashes, **names).groupBy("grp", "i", "j").applyInArrow(of, "id_a long, id_b long, bits int")


def exact_classes(photos: DataFrame, *, group: str = "library", by: str = "sha") -> DataFrame:
    """(``seq``, ``leader``, ``copies``): photos whose bytes some other photo of the library has.

    leader is the smallest seq with these bytes, copies their number.  A class of
    c copies stands for its c (c - 1) / 2 pairs without listing them.
    """
    scratch = Scratch(photos.sparkSession, "exact")
    known = photos.filter(F.col(group).isNotNull() & F.col(by).isNotNull())
    known, seen = scratch.cut(known.select(F.col(group).alias("grp"), F.col(by).alias("by"), "seq"), "known", n=F.count(F.lit(1)))
    classes = known.groupBy("grp", "by").agg(F.min("seq").alias("leader"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return follow(known, classes, ["grp", "by"], seen["n"]).select("seq", "leader", "copies")


def time_links(photos: DataFrame, *, group: str = "library", gap_us: int = GAP_SECONDS * 1_000_000) -> DataFrame:
    """(``u``, ``v``): neighbours in time of one library at most the gap apart.

    They connect what all pairs at most the gap apart connect.
    """
    timed = photos.filter(F.col(group).isNotNull() & F.col("capture_time").isNotNull())
    timed = timed.select(F.col(group).alias("grp"), micros("capture_time").alias("t"), "seq")
    along = with_previous(timed, ["grp"], ["t", "seq"], ["t", "seq"])
    return along.filter(F.col("t") - F.col("before_t") <= gap_us).select(F.col("before_seq").alias("u"), F.col("seq").alias("v"))


def time_slot(t: str, gap_us: int) -> Column:
    """Calendar slot, one gap wide, of microseconds: times in one slot are never more than the gap apart."""
    return F.expr(f"({t} - pmod({t}, {gap_us}L)) div {gap_us}L")


def slot_runs(timed: DataFrame, gap_us: int) -> DataFrame:
    """(grp, slot, number, node) of rows (grp, t, slot, seq): runs of slots without a pause longer than the gap.

    A group is first reduced to one row a slot, before the shuffle; what one task
    holds of it is bounded by the calendar, not by the rows.  number counts the runs
    of a group from 1, node is the smallest seq of the run.
    """
    slots = timed.filter("grp IS NOT NULL AND slot IS NOT NULL").groupBy("grp", "slot").agg(
        F.min("t").alias("lo"), F.max("t").alias("hi"), F.min("seq").alias("first")
    )
    along = Window.partitionBy("grp").orderBy("slot")
    starts = F.coalesce((F.col("lo") - F.lag("hi").over(along) > gap_us).cast("long"), F.lit(0))
    runs = slots.withColumn("starts", starts).withColumn("number", F.sum("starts").over(along) + 1)
    return runs.select("grp", "slot", "number", F.min("first").over(Window.partitionBy("grp", "number")).alias("node"))


def hash_links(nodes: DataFrame, distance: int, n: int) -> DataFrame:
    """(``u``, ``v``): ties of vertices (grp, id, h) that span all pairs within ``distance`` bits; n bounds their number.

    A vertex may have many hashes, and a hash many vertices: these are tied to the
    first of them, first ones of near hashes to each other.
    """
    nodes = nodes.filter("grp IS NOT NULL AND h IS NOT NULL").distinct()
    leaders = nodes.groupBy("grp", "h").agg(F.min("id").alias("first"))
    copies = follow(nodes, leaders, ["grp", "h"], n).filter("id != first").select(F.col("first").alias("u"), F.col("id").alias("v"))
    near = _near_apart(leaders.select("grp", F.col("first").alias("id"), "h"), distance, _shared(nodes))
    return copies.unionByName(near.select(F.col("id_a").alias("u"), F.col("id_b").alias("v")))


def look_links(photos: DataFrame, *, group: str = "library", distance: int = NEAR_BITS) -> DataFrame:
    """(``u``, ``v``, ``visual``): ties that span all pairs within ``distance`` bits.

    Equal hashes are tied to the first photo that has the hash, first photos of
    near hashes to each other.  visual is false where both ends hold the same
    bytes: such a tie says nothing beyond the exact one.
    """
    scratch = Scratch(photos.sparkSession, "looks")
    hashed = photos.filter(F.col(group).isNotNull() & F.col("dhash").isNotNull())
    hashed, seen = scratch.cut(hashed.select(F.col(group).alias("grp"), F.col("dhash").alias("h"), "seq", "sha"), "hashed", n=F.count(F.lit(1)))
    leaders = hashed.groupBy("grp", "h").agg(F.min(F.struct("seq", "sha")).alias("first"))
    # few pairs of many rows, whose shuffle files go before the joins below; rows of an aggregation are sorted faster than those of a table
    near = _near_apart(leaders.select("grp", F.col("first.seq").alias("id"), "h"), distance, _shared(hashed)).select("id_a", "id_b")
    near, _ = scratch.cut(near, "near")
    leaders, _ = scratch.cut(leaders, "leaders")
    copies = follow(hashed, leaders, ["grp", "h"], seen["n"]).filter("seq != first.seq").select(
        F.col("first.seq").alias("u"), F.col("seq").alias("v"), ~F.coalesce(F.col("first.sha") == F.col("sha"), F.lit(False))
    )
    shas = leaders.select("first.seq", "first.sha")
    near = near.join(shas.toDF("id_a", "sha_a"), "id_a").join(shas.toDF("id_b", "sha_b"), "id_b")
    near = near.select(F.col("id_a").alias("u"), F.col("id_b").alias("v"), ~F.coalesce(F.col("sha_a") == F.col("sha_b"), F.lit(False)))
    return copies.toDF("u", "v", "visual").unionByName(near.toDF("u", "v", "visual"))
