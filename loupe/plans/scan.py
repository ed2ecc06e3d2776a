"""Queries on scanning: formats, exclusions, paths, headers, hashes of pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.functions import text
from loupe.operators.positions import with_position
from loupe.plans.common import NOW, now
from loupe.plans.registry import query
from loupe.session import Scratch
from loupe.sources import files
from loupe.sources.tables import table

_EXT = "lower(regexp_extract(path, '(\\.[^./\\\\]+)$', 1))"


@query("S2_formats", f"""
WITH {NOW} SELECT seq, CASE WHEN {_EXT} IN ('.jpg', '.jpeg') THEN 'Jpeg' WHEN {_EXT} = '.png' THEN 'Png' WHEN {_EXT} IN ('.heic', '.heif') THEN 'Heic' END AS format FROM now""")
def s2(spark: SparkSession, folder: str) -> DataFrame:
    return now(spark, folder, "path").select("seq", text.supported_format("path").alias("format"))


@query("S3_unsupported_images", f"""
WITH {NOW} SELECT library, count_if({_EXT} IN ('.gif', '.bmp', '.tiff', '.tif', '.webp', '.raw', '.cr2', '.cr3', '.nef', '.arw', '.dng', '.orf'))::BIGINT AS n FROM now GROUP BY library""")
def s3(spark: SparkSession, folder: str) -> DataFrame:
    return now(spark, folder, "library", "path").groupBy("library").agg(F.count_if(text.image_not_supported("path")).alias("n"))


@query("S4_not_set_aside", f"""
WITH {NOW} SELECT seq FROM now WHERE path IS NOT NULL AND NOT list_contains(
  list_transform(string_split_regex(path, '[/\\\\]')[:-2], lambda x: upper(x)), 'POTENTIALDUPLICATES')""")
def s4(spark: SparkSession, folder: str) -> DataFrame:
    return now(spark, folder, "path").filter(F.col("path").isNotNull() & ~text.set_aside("path")).select("seq")


@query("S5_first_by_path", """
SELECT seq, library FROM (SELECT *, row_number() OVER (PARTITION BY upper(path) ORDER BY library NULLS FIRST, seq, loaded_at, path) AS p
  FROM (SELECT DISTINCT seq, library, path, loaded_at FROM photos)) WHERE p = 1""")
def s5(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "photos").select("seq", "library", "path", "loaded_at").distinct()
    return files.first_by_path(rows, "library", "seq", "loaded_at").select("seq", "library")


@query("S6_header_dimensions", f"WITH {NOW} SELECT seq, CASE WHEN width > 0 AND height > 0 THEN width END AS width, CASE WHEN width > 0 AND height > 0 THEN height END AS height FROM now")
def s6(spark: SparkSession, folder: str) -> DataFrame:
    """PNG headers made of the recorded dimensions, parsed again."""
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.lpad(F.hex("width"), 8, "0"), F.lpad(F.hex("height"), 8, "0")))
    made = now(spark, folder, "width", "height").withColumn("content", F.when((F.col("width") > 0) & (F.col("height") > 0), png))
    return made.select("seq", files.header("content").alias("h")).select("seq", "h.width", "h.height")


@query("S8_content_hash", "SELECT doc_id, upper(sha256(text)) AS sha256 FROM documents WHERE text IS NOT NULL")
def s8(spark: SparkSession, folder: str) -> DataFrame:
    content = F.encode("text", "UTF-8")
    return table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", F.upper(F.sha2(content, 256)).alias("sha256"))


@query("S9_folder_selection", "SELECT upper(library) AS folder, min(slideshow_id) AS ordinal FROM slideshows WHERE library IS NOT NULL GROUP BY 1")
def s9(spark: SparkSession, folder: str) -> DataFrame:
    chosen = table(spark, folder, "slideshows").filter("library IS NOT NULL")
    return chosen.groupBy(F.upper("library").alias("folder")).agg(F.min("slideshow_id").alias("ordinal"))


@query("S10_assets", f"""
WITH {NOW}, a AS (SELECT library AS preset, min(path) AS path FROM now WHERE library IS NOT NULL AND path IS NOT NULL GROUP BY 1),
c AS (SELECT *, slideshow_id % 3 AS k, CASE slideshow_id % 3 WHEN 1 THEN (SELECT min(path) FROM a) WHEN 2 THEN '/not/listed' END AS custom_path FROM slideshows)
SELECT c.slideshow_id, CASE k WHEN 0 THEN a.path WHEN 1 THEN custom_path END AS asset FROM c LEFT JOIN a ON a.preset = c.library""")
def s10(spark: SparkSession, folder: str) -> DataFrame:
    """A library stands for a preset, its first path for the preset's file; a third of the choices have a path of their own, a third one that is not listed."""
    photos = now(spark, folder, "library", "path").filter("library IS NOT NULL AND path IS NOT NULL")
    assets = photos.groupBy(F.col("library").alias("preset")).agg(F.min("path").alias("path"))
    shows, kind = table(spark, folder, "slideshows"), F.col("slideshow_id") % 3
    shows = shows.crossJoin(F.broadcast(assets.agg(F.min("path").alias("first"))))  # one row
    path = F.when(kind == 1, F.col("first")).when(kind == 2, F.lit("/not/listed"))
    choices = shows.select("slideshow_id", F.when(kind == 0, F.col("library")).otherwise("Custom").alias("preset"), path.alias("custom_path"))
    return files.resolve_assets(choices, assets).select("slideshow_id", "asset")


@query("S11_probed_durations", "SELECT doc_id, TRY_CAST(trim(coalesce(align_score::VARCHAR, lang)) AS DOUBLE) AS seconds FROM documents")
def s11(spark: SparkSession, folder: str) -> DataFrame:
    """Scores as a prober's output, language codes as its failures."""
    probed = table(spark, folder, "documents").select("doc_id", F.coalesce(F.col("align_score").cast("string"), "lang").alias("output"))
    return files.durations(probed).select("doc_id", "seconds")


@query("S12_progress_lines", "SELECT event_type AS line, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def s12(spark: SparkSession, folder: str) -> DataFrame:
    """Lines read as a stream: the event types, written as text and streamed back until all are read."""
    from loupe.streaming.progress import read_lines, run_to_end

    scratch = Scratch(spark, "lines")
    table(spark, folder, "events").filter("event_type IS NOT NULL").select("event_type").write.text(f"{scratch.root}/in")
    run_to_end(read_lines(spark, f"{scratch.root}/in"), f"{scratch.root}/out", f"{scratch.root}/state")
    return spark.read.parquet(f"{scratch.root}/out").groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("F_grid_hash", """
WITH g AS (SELECT vec_id, list_transform(range(72), lambda i: embedding[(i % 64) + 1]) AS p FROM embeddings),
b AS (SELECT vec_id, list_sum(list_transform(range(64), lambda i: CASE WHEN p[(i // 8) * 9 + i % 8 + 1] > p[(i // 8) * 9 + i % 8 + 2]
  THEN (1::HUGEINT << (63 - i)::INT) ELSE 0::HUGEINT END))::HUGEINT AS h FROM g)
SELECT vec_id, (CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END)::BIGINT AS dhash FROM b""")
def f_grid(spark: SparkSession, folder: str) -> DataFrame:
    grid = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.col("embedding")[i % 64])
    return table(spark, folder, "embeddings").withColumn("grid", grid).select("vec_id", files.grid_hash_column("grid").alias("dhash"))


@query("S13_ordering_dump", f"""
WITH {NOW} SELECT row_number() OVER (ORDER BY seq) AS slot, rtrim(regexp_extract(path, '([^/\\\\]*)$', 1)) AS name, dhash, strftime(capture_time, '%Y-%m-%d %H:%M') AS taken
FROM now WHERE path IS NOT NULL AND dhash IS NOT NULL AND capture_time IS NOT NULL""")
def s13(spark: SparkSession, folder: str) -> DataFrame:
    """The photos written as a listing of slots, names, hashes and minutes, and read again."""
    photos = now(spark, folder, "path", "dhash", "capture_time").filter("path IS NOT NULL AND dhash IS NOT NULL AND capture_time IS NOT NULL")
    minute = F.date_format("capture_time", "yyyy-MM-dd HH:mm")
    line = F.format_string("[%04d] %-50s | %s | %s", F.col("slot"), text.file_name("path"), text.hex16("dhash"), minute)
    scratch = Scratch(spark, "dump")
    with_position(photos, ["seq"], "slot").select(line).write.text(f"{scratch.root}/dump")
    read = files.read_ordering(spark, f"{scratch.root}/dump")
    return read.select(F.col("slot").cast("long").alias("slot"), "name", "dhash", F.date_format("capture_time", "yyyy-MM-dd HH:mm").alias("taken"))
