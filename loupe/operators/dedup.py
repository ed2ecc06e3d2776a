"""Duplicate detection: collisions, exact and visual groups, the photo to keep."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.functions.keys import NEAR_BITS, area, path_key
from loupe.operators.edges import exact_classes, look_links
from loupe.operators.graph import components
from loupe.operators.positions import with_position
from loupe.session import Scratch, follow, passing

EXACT, VISUAL = "ExactOnly", "HasVisualComponent"


def size_collisions(photos: DataFrame, *, group: str = "library") -> DataFrame:
    """Adds ``collides``: whether another photo of the library has the same size.

    Equal bytes have equal sizes, so only these need their content hashed.
    """
    scratch = Scratch(photos.sparkSession, "sizes")
    photos, seen = scratch.cut(photos, "photos", n=F.count(F.lit(1)))
    known = F.col(group).isNotNull() & F.col("file_size").isNotNull()
    sizes = photos.filter(known).groupBy(group, "file_size").agg((F.count(F.lit(1)) > 1).alias("collides"))
    found = follow(photos.filter(known), sizes, [group, "file_size"], seen["n"])
    return found.unionByName(photos.filter(~known).withColumn("collides", F.lit(False)))


def keep_order(size: Column | None = None) -> list[Column]:
    """Best photo first: area (``size``, if it is known already), file size, capture, shortest and smallest path, seq."""
    return [
        (area("width", "height") if size is None else size).desc(), F.col("file_size").desc_nulls_last(), F.col("capture_time").asc_nulls_last(),
        F.length("path").asc_nulls_last(), F.upper("path").asc_nulls_last(), F.col("seq").asc(),
    ]


def keep_key() -> Column:
    """``keep_order`` as one comparable value (least is best), for min_by.

    Missing times and paths rank behind all others by a flag in front of them.
    """
    return F.struct(
        (-area("width", "height")).alias("k1"), (-F.coalesce("file_size", F.lit(-(2**62)))).alias("k2"),
        F.col("capture_time").isNull().alias("k3"), F.col("capture_time").alias("k4"),
        F.col("path").isNull().alias("k5"), F.length("path").alias("k6"), F.upper("path").alias("k7"), F.col("seq").alias("k8"),
    )


class Detected(NamedTuple):
    """members: group_id, classification, seq; groups: one row each, with the photo to keep."""

    members: DataFrame
    groups: DataFrame


def _groups(members: DataFrame, photos: DataFrame) -> DataFrame:
    """One row per group: n, first_seq, recommended_seq, _path and _time."""
    kept = F.min_by(F.struct("seq", "path", "capture_time"), keep_key())
    found = members.join(photos, "seq").groupBy("group_id", "classification").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), kept.alias("kept")
    )
    return found.select(
        "group_id", "classification", "n", "first_seq", F.col("kept.seq").alias("recommended_seq"),
        F.col("kept.path").alias("recommended_path"), F.col("kept.capture_time").alias("recommended_time"),
    )


def provisional_groups(photos: DataFrame, *, group: str = "library") -> Detected:
    """Exact groups only, as known before looks are compared."""
    members = exact_classes(photos, group=group).select(F.col("leader").alias("group_id"), F.lit(EXACT).alias("classification"), "seq")
    return Detected(members, _groups(members, photos))


def detect(photos: DataFrame, *, group: str = "library", distance: int = NEAR_BITS) -> Detected:
    """Duplicate groups of the current photos (seq, library, path, ..., dhash, sha).

    Ties are equal bytes and hashes within ``distance`` bits; a group is what is
    tied directly or through others.  A group with a visual tie between different
    bytes is visual, any other exact.  From a visual group every set of equal
    bytes is taken out as an exact group of its own, and only the best of each set
    stays; a visual group left with fewer than two photos is dropped.  So a photo
    can be in two groups.  group_id is the smallest seq of the component for a
    visual group, and of the set of equal bytes for an exact one.
    """
    scratch = Scratch(photos.sparkSession, "detect")
    needed = (group, "seq", "path", "file_size", "width", "height", "capture_time", "dhash", "sha")
    photos, _ = scratch.cut(photos.filter(F.col(group).isNotNull()).select(*needed), "photos")
    with passing(photos.sparkSession):
        looks, _ = scratch.cut(look_links(photos, group=group, distance=distance), "looks")
    exact = exact_classes(photos, group=group).filter("seq != leader").select(F.col("leader").alias("u"), F.col("seq").alias("v"))
    label, counted = scratch.cut(components(looks.select("u", "v").unionByName(exact), "u", "v"), "label", n=F.count(F.lit(1)))
    n = counted["n"]
    seen = looks.filter("visual").select(F.col("u").alias("seq")).join(label, "seq").select("component").distinct()
    placed = follow(label, seen.withColumn("visual", F.lit(True)), "component", n, how="left")
    placed = placed.withColumn("visual", F.coalesce("visual", F.lit(False))).join(photos, "seq")
    placed, _ = scratch.cut(placed, "placed")

    # sets of equal bytes: their size, name and best; a photo of unknown bytes is a set of its own
    of_bytes = placed.filter("sha IS NOT NULL").groupBy("component", "sha").agg(
        F.count(F.lit(1)).alias("copies"), F.min("seq").alias("set_id"), F.min_by("seq", keep_key()).alias("best"), F.bool_or("visual").alias("visual")
    )
    of_bytes, _ = scratch.cut(of_bytes, "sets")
    many = of_bytes.filter("copies > 1").select("component", "sha", "set_id")
    in_sets = follow(placed.filter("sha IS NOT NULL").select("component", "sha", "seq"), many, ["component", "sha"], n)
    exact_members = in_sets.select(F.col("set_id").alias("group_id"), F.lit(EXACT).alias("classification"), "seq")
    left = of_bytes.filter("visual").select("component", F.col("best").alias("seq")).unionByName(
        placed.filter("visual AND sha IS NULL").select("component", "seq")
    )
    enough = left.groupBy("component").agg(F.count(F.lit(1)).alias("left")).filter("left >= 2").select("component")
    visual_members = follow(left, enough, "component", n).select(F.col("component").alias("group_id"), F.lit(VISUAL).alias("classification"), "seq")
    members, _ = scratch.cut(exact_members.unionByName(visual_members), "members")
    return Detected(members, _groups(members, photos))


def attach_hashes(photos: DataFrame, hashes: DataFrame) -> DataFrame:
    """Fills null ``dhash`` from ``hashes`` (path, dhash) by path, case and slashes aside."""
    known = hashes.filter(F.col("path").isNotNull()).groupBy(path_key("path").alias("__key")).agg(F.min("dhash").alias("__dhash"))
    return (
        photos.withColumn("__key", path_key("path")).join(known, "__key", "left")
        .withColumn("dhash", F.coalesce("dhash", "__dhash")).drop("__key", "__dhash")
    )


def ordered_groups(groups: DataFrame) -> DataFrame:
    """Adds ``position``: groups by size, then capture of the photo to keep, then first seq."""
    at = F.col("recommended_time")
    return with_position(groups, [-F.col("n"), at.isNull(), at, "first_seq", "classification"])
