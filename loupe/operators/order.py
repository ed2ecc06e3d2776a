"""Orders that spread similar photos: time clusters, variety chains, spaced slots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loupe.functions.keys import GAP_SECONDS, NEAR_BITS, micros
from loupe.operators.edges import hash_links, slot_runs, time_slot
from loupe.operators.graph import components
from loupe.operators.positions import with_previous
from loupe.session import Scratch, follow


def time_clusters(photos: DataFrame, *, group: str = "library", gap_us: int = GAP_SECONDS * 1_000_000) -> DataFrame:
    """(``seq``, ``number``): clusters of each library along time, from 1.

    A cluster begins where the pause since the photo before is more than the gap.
    Photos without a time follow all others and stay in the last cluster; a
    library without any time is one cluster.
    """
    scratch = Scratch(photos.sparkSession, "clusters")
    timed = photos.filter(F.col(group).isNotNull()).select(F.col(group).alias("grp"), "seq", micros("capture_time").alias("t"))
    timed, seen = scratch.cut(timed.withColumn("slot", time_slot("t", gap_us)), "timed", n=F.count(F.lit(1)))
    runs, _ = scratch.cut(slot_runs(timed, gap_us), "runs")
    known = follow(timed.filter("slot IS NOT NULL"), runs.select("grp", "slot", "number"), ["grp", "slot"], seen["n"])
    last = runs.groupBy("grp").agg(F.max("number").alias("number"))
    rest = follow(timed.filter("slot IS NULL"), last, "grp", seen["n"], how="left").withColumn("number", F.coalesce("number", F.lit(1)))
    return known.select("seq", "number").unionByName(rest.select("seq", "number"))


def similar_clusters(photos: DataFrame, *, group: str = "library", distance: int = NEAR_BITS, gap_us: int = GAP_SECONDS * 1_000_000) -> DataFrame:
    """(``seq``, ``component``): photos alike by looks or time, singles included.

    Photos of one run of times are one vertex, named by its smallest seq; equal
    hashes tie their vertices to the first of them, near hashes their first ones.
    """
    scratch = Scratch(photos.sparkSession, "similar")
    slim = photos.filter(F.col(group).isNotNull()).select(F.col(group).alias("grp"), "seq", F.col("dhash").alias("h"), micros("capture_time").alias("t"))
    slim, seen = scratch.cut(slim.withColumn("slot", time_slot("t", gap_us)), "photos", n=F.count(F.lit(1)))
    n = seen["n"]
    runs = slot_runs(slim, gap_us).select("grp", "slot", "node")
    nodes = follow(slim.filter("slot IS NOT NULL"), runs, ["grp", "slot"], n).select("grp", "seq", "h", "node")
    nodes = nodes.unionByName(slim.filter("slot IS NULL").select("grp", "seq", "h", F.col("seq").alias("node")))
    nodes, _ = scratch.cut(nodes, "nodes")
    label = components(hash_links(nodes.select("grp", F.col("node").alias("id"), "h"), distance, n), "u", "v")
    placed = follow(nodes, label.toDF("node", "component"), "node", n, how="left")
    return placed.select("seq", F.coalesce("component", "node").alias("component"))


def variety_chain(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Greedy farthest-next order of rows that are sorted by path.

    Starts at the first row; next is the unplaced row that differs most from the
    one placed last, the earlier of equals.  A missing hash differs from nothing.

    Rows of one hash are a queue, so a step looks at the different hashes that are
    left, not at all rows.
    """
    n = len(hashes)
    # the missing hash is the last value; it differs from nothing and nothing from it
    values = np.unique(hashes[known])
    which = np.where(known, np.searchsorted(values, hashes), len(values))
    queue = np.argsort(which, kind="stable")
    ends = np.cumsum(np.bincount(which, minlength=len(values) + 1))
    at = ends - np.bincount(which, minlength=len(values) + 1)
    alive = np.flatnonzero(at < ends)  # numbers of the values that still have rows
    values = np.append(values, np.uint64(0)).astype(np.uint64)
    missing = len(values) - 1
    out = np.empty(n, dtype=np.int64)
    last = 0
    for k in range(n):
        out[k] = last
        value = which[last]
        at[value] += 1
        if at[value] == ends[value]:
            alive = alive[alive != value]
        if k + 1 == n:
            break
        if value == missing:
            best = alive
        else:
            far = np.bitwise_count(values[alive] ^ values[value])
            if len(alive) and alive[-1] == missing:
                far[-1] = 0
            best = alive[far == far.max()]
        last = int(queue[at[best]].min())
    return out


def spaced_slots(sizes: np.ndarray) -> np.ndarray:
    """Slots (from 0) of the members of clusters that come by size, the greatest first.

    Member k of a cluster aims at round(k n / size) (half to even) plus the
    cluster's number, modulo n, and takes the next free slot, from the start again
    past the end.  Free slots are found by a forest of next-free pointers.
    """
    n = int(sizes.sum())
    following = list(range(n + 1))

    def free_from(slot: int) -> int:
        root = slot
        while following[root] != root:
            root = following[root]
        while following[slot] != root:
            following[slot], slot = root, following[slot]
        return root

    out = np.empty(n, dtype=np.int64)
    at = 0
    for number, size in enumerate(sizes.tolist()):
        spacing = n / size
        for k in range(size):
            slot = free_from((round(k * spacing) + number % n) % n)
            if slot == n:
                slot = free_from(0)
            out[at] = slot
            following[slot] = slot + 1
            at += 1
    return out


def _unsigned(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy().view(np.uint64), column.is_valid().to_numpy()


def _chains(table: pa.Table) -> pa.Table:
    """Places within their cluster of the photos of some clusters of a library."""
    table = table.sort_by([("component", "ascending"), ("key", "ascending"), ("path", "ascending"), ("seq", "ascending")])
    hashes, known = _unsigned(table.column("dhash"))
    ends = np.append(np.flatnonzero(np.diff(table.column("component").to_numpy())) + 1, table.num_rows)
    place, start = np.zeros(table.num_rows, dtype=np.int64), 0
    for end in ends.tolist():
        if end - start > 1:
            place[start + variety_chain(hashes[start:end], known[start:end])] = np.arange(end - start)
        start = end
    return table.drop_columns(["key", "path", "dhash", "part"]).append_column("place", pa.array(place))


def _slot(table: pa.Table) -> pa.Table:
    """Adds ``slot`` to the photos of a library, known by number of their cluster and place in it."""
    table = table.sort_by([("number", "ascending"), ("place", "ascending")])
    sizes = np.unique(table.column("number").to_numpy(), return_counts=True)[1]
    return table.append_column("slot", pa.array(spaced_slots(sizes)))


#: Parts that the clusters of a library are dealt to, each a task of chains.
CHAIN_PARTS = 64


def best_mix(photos: DataFrame, *, group: str = "library", distance: int = NEAR_BITS) -> DataFrame:
    """(``group``, ``seq``, ``component``, ``place``, ``slot``): each library's photos evenly mixed.

    Photos alike form clusters; within a cluster they are chained for variety
    (place, from 0), and the clusters, the largest first, are spread over the
    slots (from 0).  A library without any hash or time is all clusters of one and
    so in path order.  A missing path counts as an empty one.

    Chain and slots are sequential by definition: a cluster is chained in one task,
    and the slots of a library are given out in one, with 40 bytes a photo.
    """
    scratch = Scratch(photos.sparkSession, "mix")
    slim = photos.filter(F.col(group).isNotNull()).select(group, "seq", F.coalesce("path", F.lit("")).alias("path"), "dhash", "capture_time")
    slim, seen = scratch.cut(slim, "photos", n=F.count(F.lit(1)))
    label = similar_clusters(slim, group=group, distance=distance)
    placed = slim.join(label, "seq").select(group, "seq", "component", "path", F.upper("path").alias("key"), "dhash")
    placed, _ = scratch.cut(placed, "placed")
    clusters = placed.groupBy(group, "component").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "path", "seq")).alias("first"))
    number = F.row_number().over(Window.partitionBy(group).orderBy(F.col("n").desc(), "first")) - 1
    numbered = follow(placed, clusters.select("component", number.alias("number")), "component", seen["n"])
    numbered = numbered.withColumn("part", F.pmod(F.xxhash64("component"), F.lit(CHAIN_PARTS)))
    kind = photos.schema[group].dataType.simpleString()
    chained = numbered.select(group, "seq", "component", "number", "key", "path", "dhash", "part").groupBy(group, "part").applyInArrow(
        _chains, f"`{group}` {kind}, seq long, component long, number int, place long"
    )
    slotted = chained.groupBy(group).applyInArrow(_slot, f"`{group}` {kind}, seq long, component long, number int, place long, slot long")
    return slotted.select(group, "seq", "component", "place", "slot")


def slot_gaps(mixed: DataFrame, *, group: str = "library") -> DataFrame:
    """(group, component, seq, slot, gap): gap to the slot before in the same cluster, null for the first."""
    along = with_previous(mixed.select(group, "component", "seq", "slot"), [group, "component"], ["slot"], ["slot"])
    return along.select(group, "component", "seq", "slot", (F.col("slot") - F.col("before_slot")).alias("gap"))


#: Slots that a report lists; of more it lists the first few and the last.
LISTED_SLOTS, LISTED_FIRST = 12, 8


def spacing_report(mixed: DataFrame, *, group: str = "library") -> DataFrame:
    """Clusters of two or more: n, min_gap, max_gap, avg_gap, first_slot, and a short list of slots.

    The list holds all slots up to twelve, of more the first eight and the last.
    """
    gaps, _ = Scratch(mixed.sparkSession, "spacing").cut(slot_gaps(mixed, group=group), "gaps")
    found = gaps.groupBy(group, "component").agg(
        F.count(F.lit(1)).alias("n"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), F.avg("gap").alias("avg_gap"),
        F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"),
    ).filter("n >= 2")
    # Spark keeps the first rows of a cluster in each task before the shuffle
    place = F.row_number().over(Window.partitionBy(group, "component").orderBy("slot"))
    first = gaps.withColumn("place", place).filter(F.col("place") <= LISTED_SLOTS).groupBy(group, "component").agg(F.array_sort(F.collect_list("slot")).alias("slots"))
    short = F.concat(F.array_join(F.slice("slots", 1, LISTED_FIRST), ", "), F.lit(", ..., "), F.col("last_slot").cast("string"))
    listed = F.when(F.col("n") <= LISTED_SLOTS, F.array_join("slots", ", ")).otherwise(short)
    return found.join(first, [group, "component"]).withColumn("slots", listed).drop("last_slot")
