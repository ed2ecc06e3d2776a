"""Streams: progress lines, latest state, sessions, throttles, provisional results."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loupe.operators.dedup import detect, provisional_groups
from loupe.operators.progress import parse_line
from loupe.operators.sessions import Conflict, SessionTable
from loupe.session import _path, ship_code


def read_lines(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Lines of the text files of a folder, as they arrive."""
    reader = spark.readStream.schema("line string").format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.load(folder)


def run_to_end(stream: DataFrame, out: str, state: str, mode: str = "append") -> None:
    """Writes what is there to a parquet folder, then stops; a later run goes on from there."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def parsed(stream: DataFrame, line: str = "line") -> DataFrame:
    """A stream of lines with their parsed values; malformed and unknown lines are left out."""
    return stream.withColumn("p", parse_line(line)).filter("p IS NOT NULL").select("*", "p.*").drop("p")


def each_batch(stream: DataFrame, state: str, do: Callable[[DataFrame, int], None]) -> None:
    query = stream.writeStream.foreachBatch(do).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_id(spark: SparkSession, state: str) -> str:
    """Identity of the stream whose checkpoint lies in ``state``: another checkpoint is another stream."""
    fs, at = _path(spark, f"{state}/metadata")
    stream = fs.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()


def keep_sessions(stream: DataFrame, store: SessionTable, state: str, *, attempts: int = 5) -> None:
    """Merges each batch of rows (key, t, id) into the stored sessions.

    The store's manifest holds the last batch taken of each stream and is published
    with the batch's sessions, so a batch that is delivered again is left out, and
    batches of other streams or of a new checkpoint are not.  Where another writer
    publishes first, the batch is merged anew.
    """
    def merge(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for attempt in range(attempts):
                try:
                    store.merge(batch, source=(stream_id(store.spark, state), number))
                    return
                except Conflict:
                    if attempt + 1 == attempts:
                        raise
        finally:
            batch.unpersist()

    each_batch(stream, state, merge)


def throttle_stream(stream: DataFrame, key: str, done: str, every: int) -> DataFrame:
    """(key, done): reports of a worker that are ``every`` items past the last one shown, the first included.

    State is one number per worker.
    """

    def pick(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shown = state.get[0] if state.exists else None
        out = []
        for value in sorted(v for f in frames for v in f[done].dropna()):
            if shown is None or value - shown >= every:
                shown = int(value)
                out.append(shown)
        if shown is not None:
            state.update((shown,))
        yield pd.DataFrame({key: [k[0]] * len(out), done: out})

    ship_code(stream.sparkSession)
    schema = stream.select(key, F.col(done).cast("long").alias(done)).schema
    slim = stream.select(key, F.col(done).cast("long").alias(done))
    return slim.groupBy(key).applyInPandasWithState(pick, schema, "shown long", "append", GroupStateTimeout.NoTimeout)


def rolling_stream(stream: DataFrame, key: str, order: str, value: str, capacity: int) -> DataFrame:
    """(key, value, evicted): each value added to a worker's rolling window and what it pushes out.

    State is the window, ``capacity`` values per worker; values of one batch are
    taken by ``order``.
    """
    if capacity < 1:
        raise ValueError("a rolling window holds one row at least")

    def roll(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")[value].tolist()
        evicted = []
        for v in rows:
            window.append(v)
            evicted.append(window.pop(0) if len(window) > capacity else None)
        state.update((window,))
        yield pd.DataFrame({key: [k[0]] * len(rows), value: rows, "evicted": pd.array(evicted, dtype="Int64")})

    ship_code(stream.sparkSession)
    slim = stream.select(key, order, F.col(value).cast("long").alias(value)) if order != value else stream.select(key, F.col(value).cast("long").alias(value))
    kind = dict(stream.dtypes)[key]
    return slim.groupBy(key).applyInPandasWithState(
        roll, f"{key} {kind}, {value} long, evicted long", "items array<long>", "append", GroupStateTimeout.NoTimeout
    )


def provisional_then_final(photos: DataFrame, publish: Callable[[str, DataFrame], None]) -> None:
    """Publishes exact groups first, then the final groups that may take them back.

    ``publish`` gets "provisional" or "final" and the groups; the final frame's
    ``confirmed`` says for exact groups whether they had been provisional.
    """
    early = provisional_groups(photos).groups
    publish("provisional", early)
    final = detect(photos).groups
    marks = early.select("group_id", F.lit("ExactOnly").alias("classification"), F.lit(True).alias("confirmed"))
    publish("final", final.join(marks, ["group_id", "classification"], "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False))))
