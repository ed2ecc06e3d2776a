"""Reports on thresholds: close pairs, sweeps, what each step adds, named lookups."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.functions.keys import hamming
from loupe.functions.text import file_name
from loupe.operators.edges import COMPARE_ROWS, block_pairs, compared_pairs, near_hashes, near_in_blocks
from loupe.operators.graph import components
from loupe.session import Scratch, follow

#: Greatest distance for which pairs are found by equal parts of their hashes; beyond it all pairs are compared.
PARTS_BITS = 12


def close_pairs(photos: DataFrame, most: int = 22, *, group: str = "library") -> DataFrame:
    """(id_a, id_b, bits, name_a, name_b): pairs at most ``most`` bits apart, with file names."""
    names = photos.select("seq", file_name("path").alias("name"))
    pairs = (near_hashes if most <= PARTS_BITS else compared_pairs)(photos, group=group, distance=most)
    return pairs.join(names.toDF("id_a", "name_a"), "id_a").join(names.toDF("id_b", "name_b"), "id_b").select("id_a", "id_b", "bits", "name_a", "name_b")


def threshold_sweep(photos: DataFrame, thresholds: list[int], *, group: str = "library") -> DataFrame:
    """(threshold, seq, component): groups of two or more at each threshold.

    Distances are taken once, for the greatest threshold, and each threshold goes on
    from the groups of the last; the driver loops over the thresholds only.  Great
    thresholds go to ``compared_sweep``.
    """
    if max(thresholds) > PARTS_BITS:
        return compared_sweep(photos, thresholds, group=group)
    scratch = Scratch(photos.sparkSession, "sweep")
    pairs, seen = scratch.cut(near_hashes(photos, group=group, distance=max(thresholds)), "pairs", n=F.count(F.lit(1)))
    parts: list[DataFrame] = []
    label, below = None, -1
    for t in sorted(set(thresholds)):
        # groups only grow with the threshold: ties of this step connect the groups of the last
        fresh = pairs.filter((F.col("bits") > below) & (F.col("bits") <= t)).select("id_a", "id_b")
        if label is None:
            label, _ = scratch.cut(components(fresh, "id_a", "id_b"), f"label-{t}")
        else:
            for end in ("id_a", "id_b"):
                fresh = follow(fresh, label.toDF(end, "root"), end, seen["n"], how="left").withColumn(end, F.coalesce("root", end)).drop("root")
            step, _ = scratch.cut(components(fresh, "id_a", "id_b"), f"step-{t}")
            kept = follow(label, step.toDF("component", "root"), "component", 2 * seen["n"], how="left").select("seq", F.coalesce("root", "component").alias("component"))
            label, _ = scratch.cut(kept.unionByName(step.join(label, "seq", "left_anti")), f"label-{t}")
        parts.append(label.select(F.lit(t).alias("threshold"), "seq", "component"))
        below = t
    return reduce(DataFrame.unionByName, parts)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give all that the ties a - b connect the smallest of their labels; label[label] is label, before and after."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(further := label[label], label):
            label[:] = further


def _forest(n: int, a: np.ndarray, b: np.ndarray, level: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fewer than n ties that connect what the ties a - b up to any level connect."""
    label, out = np.arange(n), []
    for k in range(levels):
        before = label.copy()
        here = level == k
        _merge(label, a[here], b[here])
        moved = np.flatnonzero((before == np.arange(n)) & (label != before))
        out.append((moved, label[moved], np.full(len(moved), k)))
    return tuple(np.concatenate(x) for x in zip(*out))


_TIES = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("level", pa.int32())])


def _with_group(table: pa.Table, ties: pa.Table) -> pa.Table:
    return ties.add_column(0, "grp", pa.array([table.column("grp")[0].as_py()] * len(ties), table.column("grp").type))


def _ties(ids: np.ndarray, forest: tuple, table: pa.Table) -> pa.Table:
    a, b, level = forest
    i, j = (np.full(len(a), table.column(c)[0].as_py()) for c in ("i", "j"))
    return _with_group(table, pa.table([i, j, ids[a], ids[b], level.astype(np.int32)], schema=_TIES))


def _sweep_blocks(table: pa.Table, thresholds: list[int]) -> pa.Table:
    """Ties of two blocks, level k standing for the kth threshold."""
    ids = np.unique(table.column("id").to_numpy())
    known = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    for a, b, bits in near_in_blocks(table, thresholds[-1]):
        fresh = np.searchsorted(ids, a), np.searchsorted(ids, b), np.searchsorted(thresholds, bits)
        known = _forest(len(ids), *(np.concatenate(x) for x in zip(known, fresh)), len(thresholds))
    return _ties(ids, known, table)


def _numbered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    a, b, level = (table.column(c).to_numpy() for c in ("a", "b", "level"))
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    return ids, place[: len(a)], place[len(a) :], level


def _reduce_ties(table: pa.Table, levels: int) -> pa.Table:
    ids, a, b, level = _numbered(table)
    return _ties(ids, _forest(len(ids), a, b, level, levels), table)


def _sweep_labels(table: pa.Table, thresholds: list[int]) -> pa.Table:
    ids, a, b, level = _numbered(table)
    label, parts = np.arange(len(ids)), []
    for k, t in enumerate(thresholds):
        here = level == k
        _merge(label, a[here], b[here])
        grouped = np.bincount(label, minlength=len(ids))[label] > 1
        parts.append((np.full(grouped.sum(), t, dtype=np.int32), ids[grouped], ids[label[grouped]]))
    return pa.table([np.concatenate(x) for x in zip(*parts)], names=["threshold", "seq", "component"])


def compared_sweep(photos: DataFrame, thresholds: list[int], *, group: str = "library", rows: int = COMPARE_ROWS) -> DataFrame:
    """What ``threshold_sweep`` gives, for thresholds at which photos have very many others near them.

    Of two blocks only ties are kept that connect the same at every threshold, fewer
    than photos; ties of neighbouring blocks are merged in rounds, so the last task of a
    library holds four ties a photo at most.
    """
    thresholds = sorted(set(thresholds))
    scratch = Scratch(photos.sparkSession, "sweep")
    kind = photos.schema[group].dataType.simpleString()
    schema = f"grp {kind}, i long, j long, a long, b long, level int"
    ties, _ = scratch.cut(
        block_pairs(photos, group=group, rows=rows).groupBy("grp", "i", "j").applyInArrow(lambda t: _sweep_blocks(t, thresholds), schema), "ties"
    )
    last = ties.agg(F.max("j")).head()[0] or 0
    while last > 1:
        halved = ties.withColumn("i", F.shiftright("i", 1)).withColumn("j", F.shiftright("j", 1))
        ties, last = halved.groupBy("grp", "i", "j").applyInArrow(lambda t: _reduce_ties(t, len(thresholds)), schema), last >> 1
    return ties.groupBy("grp").applyInArrow(lambda t: _sweep_labels(t, thresholds), "threshold int, seq long, component long")


def sweep_counts(sweep: DataFrame) -> DataFrame:
    """(threshold, n_groups, n_photos)"""
    groups = sweep.groupBy("threshold", "component").agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_photos"))


def new_groups(sweep: DataFrame, thresholds: list[int]) -> DataFrame:
    """(threshold, component, seq): members of the groups that the next lower threshold does not have as they are.

    Groups only grow with the threshold, so a group was there before if the group of
    the same smallest seq was, with as many members.
    """
    sizes = sweep.groupBy("threshold", "component").agg(F.count(F.lit(1)).alias("n"))
    following = F.create_map(*(F.lit(x) for pair in zip(thresholds, thresholds[1:]) for x in pair))
    before = sizes.select(following[F.col("threshold")].alias("threshold"), "component", "n").filter("threshold IS NOT NULL")
    grown = sizes.filter(F.col("threshold") > min(thresholds)).join(before, ["threshold", "component", "n"], "left_anti")
    return sweep.join(grown.select("threshold", "component"), ["threshold", "component"], "left_semi").select("threshold", "component", "seq")


def named_pairs(photos: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (name_a, name_b, ...) with ``bits`` between the first photos of these names, case aside.

    Null where a photo has no hash; pairs of which a name is not found are left out.
    """
    named = photos.filter(F.col("path").isNotNull()).withColumn("name", F.upper(file_name("path")))
    first = named.groupBy("name").agg(F.min_by(F.struct("dhash"), "seq").alias("x")).select("name", F.col("x.dhash").alias("dhash"))
    a, b = first.toDF("__a", "__ha"), first.toDF("__b", "__hb")
    found = wanted.join(a, F.upper("name_a") == F.col("__a")).join(b, F.upper("name_b") == F.col("__b"))
    return found.withColumn("bits", hamming("__ha", "__hb").cast("int")).drop("__a", "__b", "__ha", "__hb")


def listed_pairs(photos: DataFrame, names: DataFrame, by: str | None = None) -> DataFrame:
    """(by, name_a, name_b, bits): all pairs among the listed ``name``s, as ``named_pairs`` looks them up, each pair once.

    by: column that tells several lists apart; lists are short, pairs are of one list.
    """
    keys = [by] if by else []
    listed = names.filter(F.col("name").isNotNull()).select(*keys, F.upper("name").alias("name")).distinct()
    a, b = listed.withColumnRenamed("name", "name_a"), listed.withColumnRenamed("name", "name_b")
    pairs = a.join(b, keys).filter("name_a < name_b") if by else a.join(b, F.col("name_a") < F.col("name_b"))
    return named_pairs(photos, pairs).select(*keys, "name_a", "name_b", "bits")


def available_names(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """``wanted`` (folder, base, ...) with ``name``: the first of "Base", "Base (2)" to "Base (999)" that its folder does not have.

    existing: (folder, name) without extensions; case is ignored.  The base itself
    where all are taken or the folder is not there.
    """
    number = F.regexp_extract("name", r" \(([2-9]|[1-9][0-9]{1,2})\)$", 1)
    plain = existing.select(F.upper("folder").alias("__f"), F.upper("name").alias("__b"), F.lit(1).alias("__i"))
    numbered = existing.filter(number != "").select(
        F.upper("folder").alias("__f"), F.upper(F.regexp_replace("name", r" \([0-9]+\)$", "")).alias("__b"), number.cast("int").alias("__i")
    )
    taken = plain.unionByName(numbered).groupBy("__f", "__b").agg(F.collect_set("__i").alias("__taken"))
    found = wanted.join(taken, (F.upper("folder") == F.col("__f")) & (F.upper("base") == F.col("__b")), "left")
    first = F.array_min(F.array_except(F.sequence(F.lit(1), F.lit(999)), "__taken"))
    name = F.when(first > 1, F.concat("base", F.lit(" ("), first.cast("string"), F.lit(")"))).otherwise(F.col("base"))
    return found.withColumn("name", name).drop("__f", "__b", "__taken")
