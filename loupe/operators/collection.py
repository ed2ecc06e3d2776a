"""From folders to duplicate groups: listing, headers, content hashes of collisions, picture hashes.

Each file's content is read as little as the result needs: headers from the first
bytes, all bytes only of files whose size another file has, pixels once.  A small
file is opened once for all of that.
"""

from __future__ import annotations

import time
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.functions.keys import path_key
from loupe.operators.dedup import size_collisions
from loupe.operators.positions import with_position
from loupe.session import Scratch, passing
from loupe.sources import files


class Indexed(NamedTuple):
    """photos: seq, library, path, file_size, format, width, height, capture_time, dhash,
    sha; metrics: one row a stage with its rows and seconds, as observed."""

    photos: DataFrame
    metrics: DataFrame


def index_folders(spark: SparkSession, roots: list[str], *, library: Column | str = "root_ordinal", pictures: bool = True) -> Indexed:
    """Photos of the folders as ``dedup.detect`` takes them.

    library: what photos are compared within, from the columns of ``files.scan``; the
    folder chosen if not given.  seq numbers the photos along their paths, sha is
    known of photos whose size another of the library has, dhash of those that can be
    decoded, or of none without ``pictures``.
    """
    scratch = Scratch(spark, "index")
    stages: list[tuple[str, int, float]] = []
    began = time.monotonic()

    def over(stage: str, rows: int) -> None:
        nonlocal began
        stages.append((stage, rows, time.monotonic() - began))
        began = time.monotonic()

    with passing(spark):
        found, counted = files.scan_contents(spark, roots)
        n = counted["n_photos"]
        over("unsupported", counted["n_unsupported"])
        over("scanned", n)
        group = (F.col(library) if isinstance(library, str) else library).cast("string")
        placed = with_position(found.withColumn("library", group), [path_key("path"), "path"], "seq").drop("root_ordinal")
        placed = size_collisions(placed)
        known = F.when(F.col("collides"), F.hex("known_sha")).alias("sha")
        columns = [c for c in placed.columns if c not in ("collides", "known_sha")]
        if counted["n_read"] == n:
            with_bytes = placed.select(*columns, known)
        else:
            # conditions do not spare a Python function its rows, so the others are kept from it
            unread = F.col("collides") & F.col("known_sha").isNull()
            hashed = placed.filter(unread).select(*columns, files.content_hash("path").alias("sha"))
            with_bytes = hashed.unionByName(placed.filter(~unread).select(*columns, known))
        photos, seen = scratch.cut(with_bytes, "bytes", hashed=F.count("sha"))
    over("content hashed", seen["hashed"])
    if not pictures:
        photos = photos.withColumn("dhash", F.lit(None).cast("long"))
    else:
        photos = photos if counted["n_decoded"] == n else _with_pictures(spark, roots, photos)
        photos = photos.withColumnRenamed("known_dhash", "dhash")
    photos = photos.drop("turn", "decoded", "known_dhash").withColumn("dhash", _usable("dhash"))
    photos, seen = scratch.cut(photos, "photos", decoded=F.count("dhash"))
    scratch.drop("bytes")
    over("pictures hashed", seen["decoded"])
    return Indexed(photos, spark.createDataFrame(stages, "stage string, rows long, seconds double"))


def index_waves(spark: SparkSession, waves: Iterable[list[str]]) -> DataFrame:
    """path, file_size, width, height, capture_time, dhash and sha (32 bytes) of photos whose files come in waves of folders.

    What is known of a wave is written before the next is asked for, so its files may
    be gone then.  Contents are hashed of all files, as one of another wave may have
    the same size: of small ones along their header, so that these are opened once.
    """
    scratch = Scratch(spark, "waves")
    for k, roots in enumerate(waves):
        with passing(spark):
            found, counted = files.scan_contents(spark, roots, scratch, f"scanned-{k}")
            if not counted["n_read"] == counted["n_decoded"] == counted["n_photos"]:
                unread = found.filter("known_sha IS NULL").withColumn("known_sha", F.unhex(files.content_hash("path")))
                found = _with_pictures(spark, roots, found.filter("known_sha IS NOT NULL").unionByName(unread))
                scratch.cut(found.withColumn("usable", F.lit(True)), f"completed-{k}")
                scratch.drop(f"scanned-{k}")
    # one table, so that the plan does not grow with the waves
    columns = "path string, file_size long, width int, height int, capture_time timestamp, known_dhash long, known_sha binary, usable boolean"
    whole = spark.read.schema(columns).parquet(*scratch.tables.values()).filter("usable").drop("usable")
    return whole.withColumn("known_dhash", _usable("known_dhash")).withColumnsRenamed({"known_dhash": "dhash", "known_sha": "sha"})


def _usable(dhash: str) -> Column:
    return F.nullif(dhash, F.lit(0).cast("long"))


def _with_pictures(spark: SparkSession, roots: list[str], photos: DataFrame) -> DataFrame:
    """``known_dhash`` of all: what the image source decodes meets its row, but for rows that have their hash."""
    others = photos.filter("NOT decoded")
    dhash = files.image_hashes(spark, roots, others.select("path", "turn")).withColumnRenamed("dhash", "known_dhash")
    return others.drop("known_dhash").join(dhash, "path", "left").unionByName(photos.filter("decoded"))
