"""Setting duplicates aside: a plan of moves, collision-free names, an opt-in executor."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.functions.text import ASIDE, file_name, folder
from loupe.session import Scratch, ship_code
from loupe.sources.files import opened

MOST_NAMES = 9999


def _separator(path: Column) -> Column:
    return F.when(path.contains("\\"), "\\").otherwise("/")


def move_targets(losers: DataFrame, writable: DataFrame | None = None, roots: DataFrame | None = None) -> DataFrame:
    """Adds ``target_dir``: the set-aside folder beside the file, or a fallback.

    writable: (dir, ok) of folders that were tried; a folder not named counts as
    writable.  roots: (ordinal, root, ok); the first writable root takes files of
    folders that are not.  target_dir is null where neither can be written.
    """
    out = losers.withColumn("dir", folder("path"))
    ok: Column = F.lit(True)
    if writable is not None:
        out = out.join(writable.select("dir", F.col("ok").alias("__ok")), "dir", "left")
        ok = F.coalesce("__ok", F.lit(True))
    fallback: Column = F.lit(None).cast("string")
    if roots is not None:
        first = roots.filter("ok").agg(F.min_by("root", "ordinal").alias("__root"))
        out = out.crossJoin(F.broadcast(first))  # one row
        fallback = F.col("__root")
    base = F.when(ok, F.col("dir")).otherwise(fallback)
    out = out.withColumn("target_dir", F.concat(base, _separator(F.col("path")), F.lit(ASIDE)))
    return out.drop("dir", "__ok", "__root")


def _name_family(table: pa.Table) -> pa.Table:
    table = table.sort_by([("there", "descending"), ("seq", "ascending")])
    taken: set[str] = set()
    names: list[str | None] = []
    last: dict[tuple[str, str], int] = {}
    for there, name, root, ext in zip(*(table.column(c).to_pylist() for c in ("there", "name", "stem", "ext"))):
        if there:
            taken.add(name.upper())
            names.append(None)
            continue
        chosen: str | None = name
        if name.upper() in taken:
            k = last.get((root.upper(), ext.upper()), 0) + 1
            while k <= MOST_NAMES and f"{root}_{k}{ext}".upper() in taken:
                k += 1
            last[root.upper(), ext.upper()] = k
            chosen = f"{root}_{k}{ext}" if k <= MOST_NAMES else None
        if chosen:
            taken.add(chosen.upper())
        names.append(chosen)
    return pa.table({"seq": table.column("seq"), "target_name": pa.array(names, pa.string())}).filter(pc.invert(table.column("there")))


def collision_free(plan: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Adds ``target_name``: the file's own name, or stem_1, stem_2, ... where it is taken.

    Names are taken, case aside, by ``existing`` (target_dir, name) and by files
    earlier in the plan (by seq).  A name that is made can meet a real one, so names
    are given out in order, but only among names that can meet: those of a folder
    that are equal without their trailing numbers, where one of them repeats.
    """
    ship_code(plan.sparkSession)
    name = file_name("path")
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    root = F.regexp_replace(name, r"\.[^.]*$", "")
    rows = plan.filter("target_dir IS NOT NULL").select("target_dir", "seq", name.alias("name"), root.alias("stem"), ext.alias("ext"), F.lit(False).alias("there"))
    if existing is not None:
        n = F.col("name")
        rows = rows.unionByName(existing.select(
            "target_dir", F.lit(-1).cast("long").alias("seq"), "name", F.regexp_replace(n, r"\.[^.]*$", "").alias("stem"),
            F.regexp_extract(n, r"(\.[^.]*)$", 1).alias("ext"), F.lit(True).alias("there"),
        ))
    rows, _ = Scratch(plan.sparkSession, "names").cut(rows.withColumn("full", F.upper("name")), "rows")
    # a name that nothing else wants, and that no made name can be, is free as it is
    wanted = rows.groupBy("target_dir", "full").agg((F.count(F.lit(1)) > 1).alias("repeats"), F.min("stem").alias("stem"), F.min("ext").alias("ext"))
    wanted, _ = Scratch(plan.sparkSession, "names").cut(wanted, "wanted")
    family = F.upper(F.concat(F.regexp_replace("stem", r"(_\d+)+$", ""), F.lit("\0"), "ext"))
    met = wanted.filter("repeats").select("target_dir", family.alias("family")).distinct()
    rows = rows.withColumn("family", family)
    alone = rows.join(met, ["target_dir", "family"], "left_anti").filter("NOT there").select("seq", F.col("name").alias("target_name"))
    together = rows.join(met, ["target_dir", "family"], "left_semi").drop("full")
    named = together.groupBy("target_dir", "family").applyInArrow(_name_family, "seq long, target_name string")
    return plan.join(named.unionByName(alone), "seq", "left")


def move_plan(losers: DataFrame, *, writable: DataFrame | None = None, roots: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """(seq, path, target_dir, target_name, status): what would be moved where; nothing is moved."""
    named = collision_free(move_targets(losers.select("seq", "path"), writable, roots), existing)
    status = F.when(F.col("target_dir").isNull(), "no writable folder").when(F.col("target_name").isNull(), "no free name").otherwise("planned")
    return named.select("seq", "path", "target_dir", "target_name", status.alias("status"))


_REPORT = "path string, status string, reason string"


def _moved(source: str, folder_: str, name: str) -> tuple[str, str | None]:
    """(status, reason) of moving one file; a target that exists is never replaced."""
    from pyarrow import fs

    try:
        system, at = opened(source)
        _, into = opened(folder_)
        target = f"{into.rstrip('/')}/{name}"
        system.create_dir(into, recursive=True)
        here, there = (i.type != fs.FileType.NotFound for i in system.get_file_info([at, target]))
        if not here and there:
            return "moved", None  # by an earlier attempt of this task
        if there:
            return "failed", f"{name} exists"
        system.move(at, target)
        return "moved", None
    except Exception as error:  # noqa: BLE001 - one file must not stop the rest
        return "failed", str(error).split("\n")[0][:200]


def execute(spark: SparkSession, plan: DataFrame) -> DataFrame:
    """Moves the planned files and reports (path, status, reason).

    Opt-in, for plans a person has reviewed.  Files are moved by the tasks, each once
    (the report is written before it is returned); they are never deleted, and one
    that cannot be moved does not stop the others.  A task that runs again finds its
    files moved and says so.
    """
    ship_code(spark)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            done = [_moved(*r) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())],
                ["path", "status", "reason"],
            )

    planned = plan.filter("status = 'planned'").select("path", "target_dir", "target_name")
    report, _ = Scratch(spark, "moves").cut(planned.mapInArrow(move, _REPORT), "report")
    return report


#: Fewest bytes of a finished file.
LEAST_BYTES = 1024


def _published(part: str, final: str, least: int) -> tuple[str, str | None]:
    from pyarrow import fs

    try:
        system, at = opened(part)
        _, to = opened(final)
        made, old = system.get_file_info([at, to])
        if made.type == fs.FileType.NotFound:
            return ("published", None) if old.type != fs.FileType.NotFound else ("failed", "no file was made")
        if made.size < least:
            return "failed", f"{made.size} bytes only"
        if old.type != fs.FileType.NotFound:
            system.delete_file(to)
        system.move(at, to)
        return "published", None
    except Exception as error:  # noqa: BLE001 - one file must not stop the rest
        return "failed", str(error).split("\n")[0][:200]


def publish(spark: SparkSession, parts: DataFrame, *, least: int = LEAST_BYTES) -> DataFrame:
    """Gives finished files their names: (final, status, reason) of ``parts`` (part, final).

    A file is made under a name of its own and takes the final one, replacing an older
    file, only if it is there and has ``least`` bytes; readers never see half a file.
    The tasks do it; one that runs again finds the file in place.
    """
    ship_code(spark)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            done = [_published(*r, least) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[1] for r in rows], pa.string()), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())],
                ["final", "status", "reason"],
            )

    report, _ = Scratch(spark, "published").cut(parts.select("part", "final").mapInArrow(give, "final string, status string, reason string"), "report")
    return report


def manifest_lines(paths: DataFrame, order: str = "chunk", path: str = "path") -> DataFrame:
    """(order, line): ``file '...'`` lines of a concat list, quotes escaped."""
    quoted = F.replace(F.col(path), F.lit("'"), F.lit("'\\''"))
    return paths.select(order, F.concat(F.lit("file '"), quoted, F.lit("'")).alias("line"))
