"""Sessions: runs of records of one key without a pause longer than a gap (problem 3).

Two ideas keep this safe for a key with any share of the rows.

* Times of one key in the same slot of the calendar, one gap wide, are never more
  than the gap apart, so all of them are in one session.  Records are therefore
  first aggregated by (key, slot), which combines before the shuffle; what is
  left of a key is at most one row per slot of calendar time, however many
  records it has.
* Sessions of one key are pairwise more than the gap apart.  A stored session
  table takes a new batch by sweeping its sessions together with the stored ones
  that can lie within the gap of them: a new session that bridges stored ones joins
  them.  A row that replaces an earlier version of itself takes that version's
  session apart: what is left of it is formed anew from the rows that still count.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loupe.functions.keys import GAP_SECONDS, device_key, micros
from loupe.operators.current import current_photos
from loupe.operators.edges import time_slot
from loupe.session import Scratch, _path, delete

SESSION = "key string, start_us long, end_us long, first_id long, last_id long, n long"


def _sweep(pieces: DataFrame, gap_us: int, *by: str, more: tuple[Column, ...] = ()) -> DataFrame:
    """Join pieces (lo, hi: structs of time and id; n) that are at most the gap apart; ``more``: further aggregates."""
    along = Window.partitionBy(*by).orderBy("lo", "hi")
    before = F.max("hi.t").over(along.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.coalesce((F.col("lo.t") - before > gap_us).cast("long"), F.lit(0))
    numbered = pieces.withColumn("starts", starts)
    numbered = numbered.withColumn("number", F.sum("starts").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "number").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), *more).drop("number")


def _rows(pieces: DataFrame, *extra: str) -> DataFrame:
    return pieces.select(
        *extra, "key", F.col("lo.t").alias("start_us"), F.col("hi.t").alias("end_us"),
        F.col("lo.id").alias("first_id"), F.col("hi.id").alias("last_id"), "n",
    )


def _pieces(sessions: DataFrame, *extra: str) -> DataFrame:
    return sessions.select(
        *extra, "key", F.struct(F.col("start_us").alias("t"), F.col("first_id").alias("id")).alias("lo"),
        F.struct(F.col("end_us").alias("t"), F.col("last_id").alias("id")).alias("hi"), "n",
    )


def local_sessions(rows: DataFrame, gap_us: int = GAP_SECONDS * 1_000_000) -> DataFrame:
    """Sessions (SESSION) of ``rows``: key, t (microseconds), id.

    A pause of exactly the gap does not split.  first_id is the smallest id at the
    earliest time, last_id the greatest at the latest.  Rows with a null key or
    time are left out; a single row makes a session; no rows make none.
    """
    known = rows.filter(F.col("key").isNotNull() & F.col("t").isNotNull())
    slots = known.select("key", F.struct("t", "id").alias("at"), time_slot("t", gap_us).alias("slot"))
    pieces = slots.groupBy("key", "slot").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("n"))
    return _rows(_sweep(pieces.drop("slot"), gap_us, "key"))


#: What a manifest says: data folders by unit, longest session stored, batches taken by stream.
Manifest = dict


class SessionTable:
    """A stored table of sessions that takes batches.

    Sessions lie in units: by key in ``buckets`` and by their start in slices of
    ``slice_days`` of the calendar.  ``merge`` reads the units that can hold sessions
    within the gap of the batch's (the longest stored session bounds how far back
    that is), joins what the batch bridges, writes the units in which a session
    changed, and only these, and publishes a manifest under the next version number
    by one rename.  Readers use the newest manifest, so they see the table before or
    after a batch, never in between; of two writers that start from the same version
    one fails, on a file system whose rename refuses an existing target.  A writer
    lost half way leaves the table as it was.  Data of versions before the last
    ``keep`` are removed when a newer one is published.
    """

    def __init__(
        self, spark: SparkSession, root: str, *, buckets: int = 8, slice_days: int = 730,
        gap_us: int = GAP_SECONDS * 1_000_000, keep: int = 2,
    ):
        if gap_us <= 0 or slice_days <= 0 or buckets <= 0:
            raise ValueError("gap, slices and buckets must be positive")
        self.spark, self.root, self.buckets, self.gap_us = spark, root.rstrip("/"), buckets, gap_us
        self.slice_us, self.keep = slice_days * 86_400_000_000, max(1, keep)

    # -- manifests

    def _versions(self) -> list[int]:
        fs, at = _path(self.spark, f"{self.root}/manifest")
        if not fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit())

    def _manifest(self, version: int | None = None) -> tuple[int, Manifest]:
        """Newest (or given) version and what it says."""
        versions = self._versions()
        if not versions:
            return 0, {"units": {}, "longest": 0, "taken": {}}
        version = versions[-1] if version is None else version
        fs, at = _path(self.spark, f"{self.root}/manifest/{version}")
        stream = fs.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, json.loads(text)

    def _publish(self, version: int, content: Manifest) -> None:
        fs, final = _path(self.spark, f"{self.root}/manifest/{version}")
        _, draft = _path(self.spark, f"{self.root}/manifest/_{uuid.uuid4().hex}")
        fs.mkdirs(final.getParent())
        out = fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"version {version} of {self.root} was published by another writer")

    def _clean(self, version: int) -> None:
        """Removes manifests before the last ``keep``, and data that no later one names."""
        versions = [v for v in self._versions() if v <= version]
        named = {folder for v in versions[-self.keep:] for folder in self._manifest(v)[1]["units"].values()}
        for v in versions[: -self.keep]:
            delete(self.spark, f"{self.root}/manifest/{v}")
        fs, at = _path(self.spark, f"{self.root}/data")
        for status in fs.listStatus(at) if fs.exists(at) else ():
            folder = status.getPath().getName()
            # a folder of a later version belongs to a writer that is still at work
            if folder not in named and int(folder.split("-")[0]) <= version:
                delete(self.spark, f"{self.root}/data/{folder}")

    # -- units

    def _unit(self, time: str) -> Column:
        """Bucket of ``key`` and slice of a time, as one text."""
        bucket = F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("string")
        return F.concat_ws("_", bucket, F.floor(F.col(time) / self.slice_us).cast("string"))

    def _units_around(self, ranges: DataFrame, longest: int) -> list[str]:
        """Units that can hold a session that meets one of ``ranges`` (key, lo_us, hi_us); at most as many as there are units."""
        far = self.gap_us + longest
        first, last = (F.floor((F.col(c) + d) / self.slice_us) for c, d in (("lo_us", -far), ("hi_us", far)))
        bucket = F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("string")
        spans = ranges.select(bucket.alias("bucket"), first.alias("a"), last.alias("b")).distinct()
        units = spans.select("bucket", F.explode(F.sequence("a", "b")).alias("slice")).distinct()
        return [f"{r.bucket}_{r.slice}" for r in units.collect()]

    def _read(self, units: dict[str, str]) -> DataFrame:
        """Sessions of the units given with their data folders, and their ``unit``."""
        schema = SESSION + ", unit string"
        if not units:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/data/{folder}/unit={unit}" for unit, folder in units.items()]
        found = self.spark.read.schema(SESSION).parquet(*paths)
        return found.withColumn("unit", self._unit("start_us"))

    def read(self) -> DataFrame:
        """All sessions as of the newest version (SESSION)."""
        return self._read(self._manifest()[1]["units"]).drop("unit")

    def taken(self, stream: str) -> int:
        """Number of the last batch taken from ``stream``, -1 if none was."""
        return self._manifest()[1]["taken"].get(stream, -1)

    # -- batches

    def merge(
        self, batch: DataFrame, *, replaced: DataFrame | None = None, rest: DataFrame | None = None, source: tuple[str, int] | None = None
    ) -> int:
        """Take a batch of rows (key, t, id); returns the version that holds it.

        replaced: rows (key, t, id) taken before that no longer count, because the
        batch has other versions of them or they are withdrawn; rest: all rows taken
        before that still count.  Sessions that held a replaced row are formed anew
        from ``rest``, of which only rows in their range are read on.  Without
        ``replaced`` a row that is taken twice counts twice in ``n``.

        source: (stream, number) of the batch.  The manifest that publishes a batch
        also says that it was taken, so a batch that comes again, after a crash at
        any point, is left out.  A batch without usable rows publishes nothing, unless
        it has a source.
        """
        if (replaced is None) != (rest is None):
            raise ValueError("replaced rows need the rest of the rows, and the other way round")
        version, content = self._manifest()
        if source and content["taken"].get(source[0], -1) >= source[1]:
            return version
        scratch = Scratch(self.spark, "sessions")
        fresh, seen = scratch.cut(local_sessions(batch, self.gap_us), "fresh", n=F.count(F.lit(1)), longest=F.max(F.col("end_us") - F.col("start_us")))
        gone, n_gone = None, 0
        ranges = fresh.select("key", F.col("start_us").alias("lo_us"), F.col("end_us").alias("hi_us"))
        if replaced is not None:
            gone = replaced.filter(F.col("key").isNotNull() & F.col("t").isNotNull()).select("key", "t").distinct()
            gone, counted = scratch.cut(gone, "gone", n=F.count(F.lit(1)))
            n_gone = counted["n"]
            ranges = ranges.unionByName(gone.select("key", F.col("t").alias("lo_us"), F.col("t").alias("hi_us")))
        taken = content["taken"] | ({source[0]: source[1]} if source else {})
        if not seen["n"] and not n_gone:
            if source:
                self._publish(version + 1, content | {"taken": taken})
                return version + 1
            return version

        held = {u: content["units"][u] for u in self._units_around(ranges, content["longest"]) if u in content["units"]}
        no_unit, no = F.lit(None).cast("string"), F.lit(False)
        together = _pieces(fresh).withColumns({"unit": no_unit, "fresh": F.lit(True), "cut": no})
        if held:
            together = together.unionByName(_pieces(self._read(held), "unit").withColumns({"fresh": no, "cut": no}))
        if n_gone:
            at = F.struct("t", F.lit(None).cast("long").alias("id"))
            together = together.unionByName(gone.select("key", at.alias("lo"), at.alias("hi"), F.lit(0).cast("long").alias("n"))
                                            .withColumns({"unit": no_unit, "fresh": no, "cut": F.lit(True)}))
        more = (F.bool_or("fresh").alias("fresh"), F.bool_or("cut").alias("cut"), F.collect_set("unit").alias("units"))
        swept, _ = scratch.cut(_sweep(together, self.gap_us, "key", more=more), "swept")
        whole = _rows(swept.filter("NOT cut"), "fresh")
        if n_gone:
            whole = whole.unionByName(self._formed_anew(swept.filter("cut"), fresh, rest).withColumn("fresh", F.lit(True)))
        whole, _ = scratch.cut(whole.withColumn("unit", self._unit("start_us")), "whole")
        # units in which a session changed: where its pieces lay and where it lies now
        changed = swept.filter("fresh OR cut").select(F.explode("units").alias("unit")).unionByName(whole.filter("fresh").select("unit")).distinct()
        changed, _ = scratch.cut(changed, "changed")
        folder = f"{version + 1}-{uuid.uuid4().hex}"
        written = whole.drop("fresh").join(F.broadcast(changed), "unit", "left_semi")  # at most as many rows as there are units
        written.hint("rebalance", "unit").write.partitionBy("unit").parquet(f"{self.root}/data/{folder}")
        names = {r[0] for r in changed.collect()}
        full = {r[0] for r in written.select("unit").distinct().collect()} if n_gone else names
        units = {u: f for u, f in content["units"].items() if u not in names} | {u: folder for u in full}
        longest = max(content["longest"], whole.agg(F.max(F.col("end_us") - F.col("start_us"))).first()[0] or 0)
        self._publish(version + 1, {"units": units, "longest": longest, "taken": taken})
        self._clean(version + 1)
        scratch.drop("fresh", "gone", "swept", "whole", "changed")
        return version + 1

    def _formed_anew(self, groups: DataFrame, fresh: DataFrame, rest: DataFrame) -> DataFrame:
        """Sessions of the rows of ``rest`` and of the fresh sessions that lie in the ranges of ``groups``."""
        spans = groups.select("key", F.col("lo.t").alias("a"), F.col("hi.t").alias("b"))
        slots = spans.withColumn("slot", F.explode(F.sequence(*(F.floor(F.col(c) / self.gap_us) for c in ("a", "b")))))

        def within(rows: DataFrame, time: str) -> DataFrame:
            # ranges of one key are disjoint, so a row meets one at the most
            rows = rows.withColumn("slot", F.floor(F.col(time) / self.gap_us))
            return rows.join(slots, ["key", "slot"]).filter((F.col(time) >= F.col("a")) & (F.col(time) <= F.col("b"))).drop("slot", "a", "b")

        back = local_sessions(within(rest.select("key", "t", "id"), "t"), self.gap_us)
        inside = within(fresh, "start_us").select(*back.columns)
        return _rows(_sweep(_pieces(back.unionByName(inside)), self.gap_us, "key"))


class Conflict(RuntimeError):
    """Another writer published the version first."""


def shooting_sessions(photos: DataFrame, *, gap_us: int = GAP_SECONDS * 1_000_000, late_days: int = 30, buckets: int = 8) -> DataFrame:
    """Sessions of each device's photos: device, start_us, end_us, n, first_seq, last_seq.

    Only the current row of each ``seq`` counts; devices are compared without
    surrounding blanks and letter case; photos without a device or a capture time
    are left out.  The session table is built the way it is kept up to date: what
    had been loaded until ``late_days`` before the newest load first, then the rest
    as one batch that is merged into it and replaces the earlier versions of its
    photos.  The split changes nothing in the result.
    """
    spark = photos.sparkSession
    scratch = Scratch(spark, "shooting")
    newest = photos.agg(F.max(micros("loaded_at"))).first()[0] or 0
    late = F.coalesce(micros("loaded_at") > newest - late_days * 86_400_000_000, F.lit(False))

    def current(rows: DataFrame, name: str) -> DataFrame:
        now = current_photos(rows, device_key("device").alias("key"), micros("capture_time").alias("t"))
        now, _ = scratch.cut(now.select("key", "t", F.col("seq").alias("id")), name)
        return now

    usable = F.col("key").isNotNull() & F.col("t").isNotNull()
    before, after = current(photos.filter(~late), "before"), current(photos.filter(late), "after")
    before = before.filter(usable)
    store = SessionTable(spark, f"{scratch.root}/store", buckets=buckets, gap_us=gap_us)
    store.merge(before)
    ids = after.select("id")  # a late row replaces the earlier one, usable or not
    store.merge(after.filter(usable), replaced=before.join(ids, "id", "left_semi"), rest=before.join(ids, "id", "left_anti"))
    scratch.drop("before", "after")
    return store.read().select(
        F.col("key").alias("device"), "start_us", "end_us", "n", F.col("first_id").alias("first_seq"), F.col("last_id").alias("last_seq")
    )
