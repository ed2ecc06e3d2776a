"""Best representative of each duplicate group (problem 2): ranked by a window.

Members are ranked inside their group by the photos' values with a total order
as tie-break, and the first of each group is kept.  Spark reduces a window that
keeps the first ranks before the shuffle (each task sends at most the first two
of a group), so a group may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupe.functions.keys import area, micros
from loupe.operators.current import current_photos
from loupe.operators.dedup import keep_order


def _members(members: DataFrame) -> DataFrame:
    known = F.col("group_id").isNotNull() & F.col("seq").isNotNull()
    return members.filter(known).select("group_id", "seq").distinct()


def _photos_of(members: DataFrame, photos: DataFrame, *values: Column | str) -> DataFrame:
    """Current photos that are members of some group; others leave before the sort."""
    wanted = members.select("seq").distinct()
    return current_photos(photos.join(wanted, "seq", "left_semi"), *values)


def best_members(members: DataFrame, photos: DataFrame) -> DataFrame:
    """(``group_id``, ``seq``): the photo to keep of each group.

    Only members that are photos count, each once, by the current row of the
    photo; groups with fewer than two of them get no row.  A missing or
    non-positive side makes the area 0; missing values rank last; the rest of
    ``keep_order`` breaks ties, so that the result never depends on the order
    or partitioning of the rows.  Empty tables give no rows; stored flags, paths
    and other columns are not read.
    """
    members = _members(members)
    now = _photos_of(members, photos, area("width", "height").alias("area"), "file_size", "capture_time", "path")
    place = F.row_number().over(Window.partitionBy("group_id").orderBy(*keep_order(F.col("area"))))
    first_two = members.join(now, "seq").withColumn("place", place).filter("place <= 2")
    return (
        first_two.groupBy("group_id")
        .agg(F.min(F.when(F.col("place") == 1, F.col("seq"))).alias("seq"), F.count(F.lit(1)).alias("n"))
        .filter("n = 2")
        .select("group_id", "seq")
    )


#: Fields of the record that is built, in the order of their completeness weight.
BUILT = ("width", "height", "capture_time", "device", "format", "file_size")


def surviving_records(members: DataFrame, photos: DataFrame) -> DataFrame:
    """One built record per group: group_id, seq, n and the fields of ``BUILT``.

    seq is the best member's.  Each field comes from the most trusted member that
    has it: members flagged as recommended first, then the most complete (most
    fields known), then the most recently loaded, then the smallest seq.  width
    and height go together and must both be positive; a blank text counts as
    missing.  A field no member has is null.  Groups with fewer than two photos
    get no row.
    """
    flagged = (
        members.filter(F.col("group_id").isNotNull() & F.col("seq").isNotNull())
        .groupBy("group_id", "seq")
        .agg(F.coalesce(F.max("is_recommended"), F.lit(False)).alias("trusted"))
    )
    sides = (F.col("width") > 0) & (F.col("height") > 0)

    def text(c: str) -> Column:
        return F.nullif(F.trim(c), F.lit("")).alias(c)

    now = _photos_of(
        flagged, photos.withColumn("loaded", F.col("loaded_at")),
        F.when(sides, F.col("width")).alias("width"), F.when(sides, F.col("height")).alias("height"),
        "capture_time", text("device"), text("format"), "file_size", "loaded",
    )
    complete = sum((F.col(c).isNotNull().cast("int") for c in BUILT), F.lit(0))
    ranked = flagged.join(now, "seq").withColumn(
        "rank", F.struct((~F.col("trusted")).alias("a"), (-complete).alias("b"), (-micros("loaded")).alias("c"), F.col("seq").alias("d"))
    )
    built = ranked.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("rank"))).alias(c) for c in BUILT),
    )
    return best_members(members, photos).join(built, "group_id").select("group_id", "seq", "n", *BUILT)
