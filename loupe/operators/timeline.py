"""Timelines of ordered items: chunks, offsets, durations, fades, pages, pins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupe.functions.keys import _c

# Items per chunk, with much and with little memory; seconds of a transition.
CHUNK, SMALL_CHUNK, TRANSITION = 12, 8, 1.0
LOW_MEMORY = 2 * 1024**3
PAGE = 20


def chunk_size(available_bytes: Column | str) -> Column:
    return F.when(_c(available_bytes) < LOW_MEMORY, SMALL_CHUNK).otherwise(CHUNK)


def chunks(ordered: DataFrame, position: str = "position", size: int = CHUNK) -> DataFrame:
    """Adds chunk and idx (both from 0) to items numbered from 0."""
    p = F.col(position)
    return ordered.withColumn("chunk", F.floor(p / size)).withColumn("idx", p % size)


def first_chunk_by_size(ordered: DataFrame, by: str, position: str = "position", size: str = "file_size", chunk: int = CHUNK) -> DataFrame:
    """Renumbers the items of each ``by``: the first chunk by size, the greatest first; the rest stay."""
    head = F.col(position) < chunk
    # only the first chunk moves, so the window holds that many rows of each
    first = Window.partitionBy(by).orderBy(-F.coalesce(F.col(size), F.lit(0)), position)
    moved = ordered.filter(head).withColumn(position, (F.row_number().over(first) - 1).cast("long"))
    return moved.unionByName(ordered.filter(~head))


def transition_offset(idx: Column | str, seconds: Column | str) -> Column:
    """Where the transition into item idx of a chunk begins; none into the first."""
    return F.when(_c(idx) >= 1, F.greatest(F.lit(0.0), _c(idx) * (_c(seconds) - TRANSITION)))


def chunk_duration(n: Column | str, seconds: Column | str) -> Column:
    return _c(n) * _c(seconds) - F.greatest(F.lit(0), _c(n) - 1) * TRANSITION


def total_duration(n: Column | str, n_chunks: Column | str, seconds: Column | str) -> Column:
    return _c(n) * _c(seconds) - (_c(n) - _c(n_chunks)) * TRANSITION


def fade(duration: Column | str, most: float) -> Column:
    """Seconds of a fade: ``most``, but a quarter of the duration at the most, and none of none."""
    d = _c(duration)
    return F.when(d <= 0, 0.0).otherwise(F.least(F.lit(most), d / 4))


def page_of(position: Column | str, size: int = PAGE) -> Column:
    """Page (from 0) of an item numbered from 0."""
    return F.floor(_c(position) / size)


def pages(n: Column | str, size: int = PAGE) -> Column:
    return F.greatest(F.lit(1), F.ceil(_c(n) / size)).cast("long")


def pinned(ordered: DataFrame, opener: DataFrame | None = None, closer: DataFrame | None = None) -> DataFrame:
    """Adds ``rank``: -1 for openers, 0 for the rest, 1 for closers; sort by rank, then position."""
    out = ordered.withColumn("rank", F.lit(0))
    for frame, rank in ((opener, -1), (closer, 1)):
        if frame is not None:
            out = out.unionByName(frame.withColumn("rank", F.lit(rank)), allowMissingColumns=True)
    return out


def space_needed(n: Column | str, seconds: Column | str) -> Column:
    """Bytes to keep free: 75 MiB a minute begun, 2 GiB at least, in whole numbers."""
    minutes = F.ceil(_c(n) * _c(seconds) / 60).cast("long")
    return F.greatest(F.lit(2 * 1024**3).cast("long"), F.floor(minutes * (50 * 1024 * 1024 * 3) / 2)).cast("long")
