"""Positions in a global order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupe.session import Scratch

#: monotonically_increasing_id counts rows of a partition in its lower 33 bits.
_ROW_BITS = 33


def with_position(rows: DataFrame, order: list[str | Column], name: str = "position", by: str | None = None) -> DataFrame:
    """Adds ``name``: 1, 2, ... along a total order, of all rows or of those of each ``by``.

    A window over all rows, or over those of a large ``by``, would put them into one
    task.  Here the rows are sorted by range into partitions, number themselves as
    they are written, and the rows of the partitions before are added: what is
    gathered is one count per partition.  Of ``by`` only the value that a partition
    goes on with has rows before it, so what is broadcast is one row per partition.
    """
    scratch = Scratch(rows.sparkSession, "positions")
    at = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = rows.select("*", *(c.alias(f"__o{k}") for k, c in enumerate(at)))
    keys = [*([by] if by else []), *(f"__o{k}" for k in range(len(at)))]
    spread = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__row", F.monotonically_increasing_id())
    spread, _ = scratch.cut(spread, "spread")
    spread = spread.withColumn("__part", F.shiftright("__row", _ROW_BITS))
    inside = F.col("__row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    if by is None:
        earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        counts = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
        before = counts.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
        placed = spread.join(F.broadcast(before), "__part").withColumn("__inside", inside)
    else:
        spread = spread.withColumn("__by", F.col(by))
        counts = spread.groupBy("__by", "__part").agg(F.count(F.lit(1)).alias("__n"))
        earlier = Window.partitionBy("__by").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        before = counts.withColumn("__before", F.sum("__n").over(earlier)).filter("__before > 0")
        before = before.select(F.col("__by").alias("__b"), F.col("__part").alias("__p"), "__before")
        met = (F.col("__part") == F.col("__p")) & F.col("__by").eqNullSafe(F.col("__b"))
        placed = spread.join(F.broadcast(before), met, "left")
        placed = placed.withColumn("__inside", F.row_number().over(Window.partitionBy("__by", "__part").orderBy("__row")))
    placed = placed.withColumn(name, (F.col("__inside") + F.coalesce("__before", F.lit(0))).cast("long"))
    return placed.drop("__part", "__inside", "__before", "__row", "__by", "__b", "__p", *(f"__o{k}" for k in range(len(at))))


def with_previous(rows: DataFrame, by: list[str], order: list[str], columns: list[str], prefix: str = "before_") -> DataFrame:
    """Adds the ``columns`` of the row before, along ``order`` within equal ``by``; null for the first.

    A lag without a window: rows are numbered along (by, order) and met by the next
    number, so a ``by`` with any share of the rows spreads over all tasks.
    """
    placed = with_position(rows, [*by, *order], "__at")
    before = placed.select((F.col("__at") + 1).alias("__at"), *(F.col(c).alias(f"__by_{c}") for c in by), *(F.col(c).alias(f"__is_{c}") for c in columns))
    found = placed.join(before, "__at", "left")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    found = found.withColumns({f"{prefix}{c}": F.when(same, F.col(f"__is_{c}")) for c in columns})
    return found.drop("__at", *(f"__by_{c}" for c in by), *(f"__is_{c}" for c in columns))
