"""Progress of parallel workers: parsing, latest values, rates, throttles, rolling windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupe.functions.keys import _c

# Share of the whole the preparation takes, and where the workers' part ends.
PREPARED, WORKED = 0.20, 0.94
#: Items the rate looks back, least share and chunks done before an estimate, and its rounding in seconds.
RATE_ITEMS, LEAST_SHARE, LEAST_CHUNKS, ROUND_SECONDS = 75, 0.05, 2, 30


def parse_line(line: Column | str) -> Column:
    """STRUCT(key, out_seconds, frame, fps, finished) of a ``key=value`` line, or null.

    out_time_us and out_time_ms both count microseconds.  Lines without a key, with
    an unknown one or with a value that is no number are null.
    """
    text = _c(line)
    at = F.instr(text, "=")
    key, value = F.trim(F.substring(text, F.lit(1), at - 1)), F.trim(F.substring(text, at + 1, F.length(text)))
    us = F.when(key.isin("out_time_us", "out_time_ms"), value.try_cast("long"))
    frame = F.when(key == "frame", value.try_cast("int"))
    fps = F.when(key == "fps", value.try_cast("double"))
    finished = F.when((key == "progress") & (value == "end"), F.lit(True))
    known = us.isNotNull() | frame.isNotNull() | fps.isNotNull() | finished.isNotNull()
    return F.when((at > 1) & known, F.struct(
        key.alias("key"), (us / 1_000_000).alias("out_seconds"), frame.alias("frame"), fps.alias("fps"), finished.alias("finished")
    ))


def latest(lines: DataFrame, by: str, order: str, line: str = "line") -> DataFrame:
    """State per ``by``: the last value seen of each key (by ``order``), and whether it finished."""
    p = lines.withColumn("p", parse_line(line)).filter("p IS NOT NULL")

    def last(c: str) -> Column:
        return F.max_by(F.col(f"p.{c}"), F.when(F.col(f"p.{c}").isNotNull(), F.col(order))).alias(c)

    return p.groupBy(by).agg(last("out_seconds"), last("frame"), last("fps"), F.coalesce(F.bool_or("p.finished"), F.lit(False)).alias("finished"))


def chunk_fraction(out_seconds: Column | str, duration: Column | str) -> Column:
    return F.least(F.lit(1.0), _c(out_seconds) / F.greatest(F.lit(0.001), _c(duration)))


def chunk_done(out_seconds: Column | str, seconds_each: Column | str, n: Column | str) -> Column:
    """Items of a chunk that count as done: whole ones so far and one more, n at the most."""
    return F.least(_c(n), F.floor(_c(out_seconds) / _c(seconds_each)) + 1).cast("long")


def overall_fraction(sum_of_fractions: Column | str, n_chunks: Column | str) -> Column:
    return F.least(F.lit(WORKED), PREPARED + (WORKED - PREPARED) / _c(n_chunks) * _c(sum_of_fractions))


def with_eta(samples: DataFrame, total: Column | int, *, by: str | None = None) -> DataFrame:
    """Adds ``eta_seconds`` to samples (t seconds, done, chunks_complete) with done never falling.

    total: items in all, a number or a column.  Without ``by`` the samples are those of
    one run, whose window is one task.

    The rate is that of the samples at most RATE_ITEMS items behind, from the
    earliest of them.  No estimate below LEAST_SHARE of the total or LEAST_CHUNKS
    chunks, without items or with 0.1 s or less between; else the remaining
    seconds, rounded up to ROUND_SECONDS.
    """
    total = F.lit(total) if isinstance(total, int) else total
    back = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy("done").rangeBetween(-RATE_ITEMS, 0)
    start = F.min(F.struct(F.col("done").alias("d"), F.col("t").alias("s"))).over(back)
    with_start = samples.withColumn("__start", start)
    items, seconds = F.col("done") - F.col("__start.d"), F.col("t") - F.col("__start.s")
    ready = (F.col("done") >= F.ceil(total * LEAST_SHARE)) & (F.col("chunks_complete") >= LEAST_CHUNKS) & (items > 0) & (seconds > 0.1)
    left = F.greatest(F.lit(0), total - F.col("done")) / (items / seconds)
    return with_start.withColumn("eta_seconds", F.when(ready, F.ceil(left / ROUND_SECONDS) * ROUND_SECONDS).cast("long")).drop("__start")


def throttled(rows: DataFrame, number: str, every: int, by: str) -> DataFrame:
    """Every ``every``-th row of each ``by`` by its number (from 1), and the last one."""
    last = F.max(number).over(Window.partitionBy(by))
    return rows.withColumn("__last", last).filter((F.col(number) % every == 0) | (F.col(number) == F.col("__last"))).drop("__last")


def rolling_last(rows: DataFrame, by: str, order: list[str], capacity: int) -> DataFrame:
    """The last ``capacity`` rows of each ``by``, oldest first as ``place`` from 1."""
    if capacity < 1:
        raise ValueError("a rolling window holds one row at least")
    down = Window.partitionBy(by).orderBy(*(F.col(c).desc() for c in order))
    kept = rows.withColumn("__k", F.row_number().over(down)).filter(F.col("__k") <= capacity)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.col("__k").desc()))).drop("__k")


def rolling_evicted(rows: DataFrame, by: str, order: list[str], value: str, capacity: int) -> DataFrame:
    """Adds ``evicted``: what each added row pushes out of a window of ``capacity``, or null."""
    if capacity < 1:
        raise ValueError("a rolling window holds one row at least")
    return rows.withColumn("evicted", F.lag(value, capacity).over(Window.partitionBy(by).orderBy(*order)))
