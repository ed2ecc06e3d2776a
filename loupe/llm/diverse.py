"""Choosing a varied subset (problem 4): lazy greedy facility location in rounds.

A subset S of a library covers photo i as well as its most similar member:
F(S) is the sum over all photos of max similarity to S.  F is monotone and
submodular, so the greedy choice is within 1 - 1/e of the best, and a large burst
or set of copies is covered by its first pick: further picks from it gain nothing.

A library's photos fall into blocks by a hash of their id.  Each block nominates,
by lazy greedy over itself, the full wanted number (128 at least), and gives every nominee its
part of the coverage of the block's photos.  Where the nominees of all blocks are
many, those of a few blocks become a block of the next round and nominate again,
weighted by those parts.  Last, lazy greedy over what is left of a library.

The greedy order is nested, so one order per library serves all requests: a
request takes the first ``wanted`` photos.  Blocks hold about as many photos as
there are blocks, 512 and twice the wanted number at least, later rounds
``MERGE_ROWS`` nominees or twice the wanted number: a task holds a library only if
about half of it is wanted.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.functions.keys import GAP_SECONDS, micros, usable_hash
from loupe.operators.current import current_photos
from loupe.session import Scratch, bounded

#: Bits at which hashes have nothing in common any more; unrelated pictures differ in about 32.
HASH_REACH = 24
#: Microseconds after which captures have nothing in common any more.
TIME_REACH = GAP_SECONDS * 1_000_000
#: Weights of looks and time; a photo is fully similar (1) only to itself and its like.
HASH_WEIGHT, TIME_WEIGHT = 0.7, 0.3
BLOCK_ROWS = 512
#: Photos that a block nominates at least, so that what a few picks cover is known finely.
LEAST_NOMINEES = 128
#: Nominees merged into one block of the next round, of two blocks at least.
MERGE_ROWS = 4096
#: Pairs compared at once.
SLICE = 1 << 20
MANY_LIBRARIES = 100_000
_NODE = "library string, wanted long, block long, blocks long, seq long, dhash long, t long, weight double"
_NODE_COLUMNS = ["library", "wanted", "block", "blocks", "seq", "dhash", "t", "weight"]


_BY_BITS = np.maximum(0, 1 - np.arange(65) / HASH_REACH).astype(np.float32) * np.float32(HASH_WEIGHT)


class Similarity:
    """Similarities of some photos, of each photo those above zero only (a time of nan is unknown).

    Unrelated hashes have nothing in common and most captures are far apart, so a
    photo is similar to a few per cent of the others.  All pairs of the photos
    given are compared, a slice of rows at a time.
    """

    def __init__(self, hashes: np.ndarray, has_hash: np.ndarray, times: np.ndarray):
        n = self.n = len(hashes)
        hashed = np.flatnonzero(has_hash)
        ends, cols, values = [0], [], []
        far = np.where(np.isnan(times), np.inf, times)
        step = max(1, SLICE // max(1, n))
        for low in range(0, n, step):
            rows = np.arange(low, min(n, low + step))
            bits = np.bitwise_count(hashes[rows][:, None] ^ hashes[None, :])
            bits[~has_hash[rows]] = 64
            if len(hashed) < n:
                bits[:, ~has_hash] = 64
            with np.errstate(invalid="ignore"):  # two unknown times
                near = np.abs(far[rows][:, None] - far[None, :]) < TIME_REACH
            near |= bits < HASH_REACH
            near[np.arange(len(rows)), rows] = True
            r, c = np.nonzero(near)
            v = _BY_BITS[bits[r, c]]
            gap = np.abs(times[rows[r]] - times[c])
            v += np.float32(TIME_WEIGHT) * np.nan_to_num(np.maximum(0, 1 - gap / TIME_REACH)).astype(np.float32)
            v[rows[r] == c] = 1
            ends.append(np.bincount(r, minlength=len(rows)))
            cols.append(c.astype(np.int32))
            values.append(v)
        self.start = np.cumsum(np.concatenate([[0], *ends[1:]])).astype(np.int64) if n else np.zeros(1, dtype=np.int64)
        self.cols = np.concatenate(cols) if cols else np.zeros(0, dtype=np.int32)
        self.values = np.concatenate(values) if values else np.zeros(0, dtype=np.float32)

    def row(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """The photos photo j is similar to, and how much."""
        a, b = self.start[j], self.start[j + 1]
        return self.cols[a:b], self.values[a:b]


def lazy_greedy(similarity: Similarity, weights: np.ndarray, wanted: int) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """(picks in order, their gains, for each photo the number of the pick that covers it best, and how well).

    A gain can only shrink as picks are added, so a candidate whose renewed gain
    still tops the heap is the best one.  Ties go to the smaller position.
    """
    n = similarity.n
    best = np.zeros(n, dtype=np.float32)
    nearest = np.zeros(n, dtype=np.int64)
    w = weights.astype(np.float32)
    first = np.add.reduceat(similarity.values * w[similarity.cols], similarity.start[:-1]) if n else np.zeros(0)
    heap = [(-g, j, 0) for j, g in enumerate(first.tolist())]
    heapq.heapify(heap)
    rows = [similarity.row(j) for j in range(n)]
    shares = [w[c] for c, _ in rows]
    picks: list[int] = []
    gains: list[float] = []
    while heap and len(picks) < wanted:
        gain, j, seen = heap[0]
        cols, values = rows[j]
        if seen != len(picks):
            more = values - best[cols]
            np.maximum(more, 0, out=more)
            heapq.heapreplace(heap, (-float(more.dot(shares[j])), j, len(picks)))
            continue
        heapq.heappop(heap)
        closer = values > best[cols]
        mine = cols[closer]
        nearest[mine] = len(picks)
        best[mine] = values[closer]
        picks.append(j)
        gains.append(-gain)
    return picks, np.array(gains), nearest, best


def _similarity(table: pa.Table) -> Similarity:
    h = table.column("dhash")
    hashes = h.fill_null(0).to_numpy().view(np.uint64)
    times = table.column("t").cast(pa.float64()).fill_null(float("nan")).to_numpy()
    return Similarity(hashes, h.is_valid().to_numpy(), times)


def _nominate(table: pa.Table) -> pa.Table:
    """The wanted number of a block's rows, with their parts of its coverage; a library of one block waits for the last round."""
    wanted = max(LEAST_NOMINEES, table.column("wanted")[0].as_py())
    if table.column("blocks")[0].as_py() == 1 or table.num_rows <= wanted:
        return table.select(_NODE_COLUMNS)
    table = table.sort_by("seq")
    weights = table.column("weight").to_numpy()
    picks, _, nearest, best = lazy_greedy(_similarity(table), weights, wanted)
    parts = np.bincount(nearest, weights=best * weights, minlength=len(picks))
    return table.take(pa.array(picks)).drop_columns(["weight"]).append_column("weight", pa.array(parts)).select(_NODE_COLUMNS)


def _choose(table: pa.Table) -> pa.Table:
    table = table.sort_by("seq")
    wanted = table.column("wanted")[0].as_py()
    picks, gains, *_ = lazy_greedy(_similarity(table), table.column("weight").to_numpy(), wanted)
    chosen = table.take(pa.array(picks))
    return pa.table({
        "library": chosen.column("library"), "place": pa.array(np.arange(1, len(picks) + 1), pa.int64()),
        "seq": chosen.column("seq"), "gain": pa.array(gains, pa.float64()),
    })


def varied_order(photos: DataFrame, wanted: DataFrame, *, block_rows: int = BLOCK_ROWS, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """(``library``, ``place``, ``seq``, ``gain``): each library's photos in greedy order.

    wanted: (library, wanted), one row per library; at most ``wanted`` photos of a
    library come out, all of them if it has fewer.  gain is what the photo added
    to the weighted coverage of the nominees.  Photos with a null library are
    left out; one without hash and time covers only itself.
    """
    scratch = Scratch(photos.sparkSession, "varied")
    wanted = wanted.filter(F.col("library").isNotNull() & (F.col("wanted") > 0)).select("library", F.col("wanted").cast("long").alias("wanted"))
    small = F.broadcast if bounded(wanted, MANY_LIBRARIES) else (lambda x: x)
    now = current_photos(photos, "library", usable_hash("dhash").alias("dhash"), micros("capture_time").alias("t"))
    now, _ = scratch.cut(now.join(small(wanted), "library"), "now")
    sizes = now.groupBy("library").agg(F.count(F.lit(1)).alias("n"), F.first("wanted").alias("most"))
    rows = F.greatest(F.lit(block_rows).cast("long"), F.ceil(F.sqrt("n")), 2 * F.col("most"))
    sizes = sizes.select("library", F.ceil(F.col("n") / rows).alias("blocks"))
    nodes = now.join(small(sizes), "library").withColumn("block", F.pmod(F.xxhash64("seq"), F.col("blocks"))).withColumn("weight", F.lit(1.0))
    # How many rounds any library needs; a library that needs fewer passes through the others.
    fan = F.greatest(F.lit(2), F.floor(merge_rows / F.greatest(F.lit(LEAST_NOMINEES), F.col("wanted")))).cast("long")
    widths = now.select("library", "wanted").distinct().join(small(sizes), "library").select("blocks", fan.alias("fan")).distinct().collect()
    rounds = max((_rounds(r.blocks, r.fan) for r in widths), default=0)
    for _ in range(rounds):
        nodes = nodes.groupBy("library", "block").applyInArrow(_nominate, _NODE)
        nodes = nodes.withColumn("block", F.floor(F.col("block") / fan)).withColumn("blocks", F.ceil(F.col("blocks") / fan))
    return nodes.groupBy("library").applyInArrow(_choose, "library string, place long, seq long, gain double")


def _rounds(blocks: int, fan: int) -> int:
    """Rounds of merging ``fan`` blocks into one until one is left."""
    n = 0
    while blocks > 1:
        blocks, n = -(-blocks // fan), n + 1
    return n


def varied_subsets(requests: DataFrame, photos: DataFrame, **options) -> DataFrame:
    """(``slideshow_id``, ``place``, ``seq``): the ``wanted`` photos of each request.

    A request for more photos than its library has gets them all; one with a null
    library, a library without photos, or a null or non-positive number gets
    none.  Repeated requests get the same photos; place counts from 1.
    """
    asked = requests.filter(F.col("library").isNotNull() & (F.col("wanted") > 0)).select("slideshow_id", "library", "wanted")
    order = varied_order(photos, asked.groupBy("library").agg(F.max("wanted").alias("wanted")), **options)
    return asked.join(order, "library").filter("place <= wanted").select("slideshow_id", "place", "seq")
