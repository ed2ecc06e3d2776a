"""Queries on timelines, moves, names and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loupe.functions import keys, text
from loupe.operators import dedup, resolve, timeline
from loupe.operators.positions import with_position
from loupe.plans.common import KEEP, NOW, now
from loupe.plans.registry import query
from loupe.sources.tables import table

_BY_PATH = "row_number() OVER (PARTITION BY library ORDER BY upper(path) NULLS FIRST, path NULLS FIRST, seq) - 1"


def _by_path(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    photos = now(spark, folder, "library", "path", *more).filter("library IS NOT NULL")
    placed = with_position(photos, [F.upper("path"), "path", "seq"], by="library")
    return placed.withColumn("position", F.col("position") - 1)


@query("W7_chunks", f"WITH {NOW}, p AS (SELECT library, seq, {_BY_PATH} AS p FROM now WHERE library IS NOT NULL) SELECT library, seq, p // 12 AS chunk, p % 12 AS idx FROM p")
def w7(spark: SparkSession, folder: str) -> DataFrame:
    return timeline.chunks(_by_path(spark, folder)).select("library", "seq", "chunk", "idx")


@query("W8_first_chunk_by_size", f"""
WITH {NOW}, p AS (SELECT library, seq, file_size, {_BY_PATH} AS p FROM now WHERE library IS NOT NULL)
SELECT library, seq, row_number() OVER (PARTITION BY library ORDER BY CASE WHEN p < 12 THEN 0 ELSE 1 END,
  CASE WHEN p < 12 THEN -coalesce(file_size, 0) END, p) - 1 AS position FROM p""")
def w8(spark: SparkSession, folder: str) -> DataFrame:
    return timeline.first_chunk_by_size(_by_path(spark, folder, "file_size"), "library").select("library", "seq", "position")


@query("W9_transition_offsets", f"""
WITH {NOW}, p AS (SELECT library, seq, {_BY_PATH} AS p FROM now WHERE library IS NOT NULL),
s AS (SELECT slideshow_id, library, coalesce(seconds_per_photo, 4) AS secs FROM slideshows)
SELECT slideshow_id, seq, CASE WHEN p % 12 >= 1 THEN greatest(0, (p % 12) * (secs - 1)) END::DOUBLE AS offset_s FROM p JOIN s USING (library)""")
def w9(spark: SparkSession, folder: str) -> DataFrame:
    shows = table(spark, folder, "slideshows").select("slideshow_id", "library", F.coalesce("seconds_per_photo", F.lit(4.0)).alias("secs"))
    placed = timeline.chunks(_by_path(spark, folder)).join(shows, "library")
    return placed.select("slideshow_id", "seq", timeline.transition_offset("idx", "secs").alias("offset_s"))


_SHOWS = "s AS (SELECT slideshow_id, wanted, coalesce(seconds_per_photo, 4)::DOUBLE AS secs, ceil(wanted / 12)::BIGINT AS n_chunks FROM slideshows)"


def _shows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "slideshows").select(
        "slideshow_id", F.col("wanted").cast("long").alias("wanted"), F.coalesce("seconds_per_photo", F.lit(4.0)).alias("secs"),
        F.ceil(F.col("wanted") / 12).alias("n_chunks"),
    )


@query("W10_durations", f"""
WITH {_SHOWS} SELECT slideshow_id, least(12, wanted) * secs - greatest(0, least(12, wanted) - 1) * 1.0 AS first_chunk_s,
  wanted * secs - (wanted - n_chunks) * 1.0 AS total_s FROM s""")
def w10(spark: SparkSession, folder: str) -> DataFrame:
    return _shows(spark, folder).select(
        "slideshow_id", timeline.chunk_duration(F.least(F.lit(12), "wanted"), "secs").alias("first_chunk_s"),
        timeline.total_duration("wanted", "n_chunks", "secs").alias("total_s"),
    )


@query("W11_fades", f"""
WITH {_SHOWS}, d AS (SELECT slideshow_id, wanted * secs - (wanted - n_chunks) AS d FROM s),
f AS (SELECT *, CASE WHEN d <= 0 THEN 0 ELSE least(2, d / 4) END AS fade_in, CASE WHEN d <= 0 THEN 0 ELSE least(3, d / 4) END AS fade_out FROM d)
SELECT slideshow_id, fade_in::DOUBLE AS fade_in, fade_out::DOUBLE AS fade_out, greatest(0, d - fade_out)::DOUBLE AS fade_out_from FROM f""")
def w11(spark: SparkSession, folder: str) -> DataFrame:
    d = _shows(spark, folder).select("slideshow_id", timeline.total_duration("wanted", "n_chunks", "secs").alias("d"))
    d = d.withColumn("fade_in", timeline.fade("d", 2.0)).withColumn("fade_out", timeline.fade("d", 3.0))
    return d.select("slideshow_id", "fade_in", "fade_out", F.greatest(F.lit(0.0), F.col("d") - F.col("fade_out")).alias("fade_out_from"))


@query("W13_pages", """
WITH g AS (SELECT DISTINCT group_id FROM dup_groups WHERE group_id IS NOT NULL), p AS (SELECT group_id, row_number() OVER (ORDER BY group_id) - 1 AS p FROM g)
SELECT group_id, p // 20 AS page, (SELECT greatest(1, ceil(count(*) / 20))::BIGINT FROM g) AS n_pages FROM p""")
def w13(spark: SparkSession, folder: str) -> DataFrame:
    groups = table(spark, folder, "dup_groups").filter("group_id IS NOT NULL").select("group_id").distinct()
    counted = groups.agg(timeline.pages(F.count(F.lit(1))).alias("n_pages"))  # one row
    placed = with_position(groups, ["group_id"])
    return placed.crossJoin(F.broadcast(counted)).select("group_id", timeline.page_of(F.col("position") - 1).alias("page"), "n_pages")


@query("W16_pinned_order", f"""
WITH {NOW}, p AS (SELECT library, seq, {_BY_PATH} AS p FROM now WHERE library IS NOT NULL),
a AS (SELECT library, seq, p, 0 AS r FROM p UNION ALL SELECT library, min(seq), 0, -1 FROM p GROUP BY 1 UNION ALL SELECT library, max(seq), 0, 1 FROM p GROUP BY 1)
SELECT library, seq, row_number() OVER (PARTITION BY library ORDER BY r, p) AS place FROM a""")
def w16(spark: SparkSession, folder: str) -> DataFrame:
    """The library's first photo as opener and its last as closer around the order by path."""
    placed = _by_path(spark, folder).select("library", "seq", "position")
    zero = F.lit(0).cast("long").alias("position")
    opener = placed.groupBy("library").agg(F.min("seq").alias("seq")).select("library", "seq", zero)
    closer = placed.groupBy("library").agg(F.max("seq").alias("seq")).select("library", "seq", zero)
    listed = timeline.pinned(placed, opener, closer).select("library", "seq", "rank", F.col("position").alias("at"))
    return with_position(listed, ["rank", "at"], "place", by="library").select("library", "seq", "place")


@query("U4_chunks_joined", f"""
WITH {NOW}, p AS (SELECT library, seq, {_BY_PATH} AS p FROM now WHERE library IS NOT NULL)
SELECT library, (p // 12)::BIGINT AS chunk, string_agg(seq::VARCHAR, ',' ORDER BY p) AS seqs FROM p GROUP BY ALL""")
def u4(spark: SparkSession, folder: str) -> DataFrame:
    placed = timeline.chunks(_by_path(spark, folder))
    items = F.array_sort(F.collect_list(F.struct("idx", "seq")))
    return placed.groupBy("library", "chunk").agg(F.array_join(F.transform(items, lambda x: x["seq"]), ",").alias("seqs"))


_LOSERS = f"""
{NOW}, r AS (SELECT seq, path, row_number() OVER (PARTITION BY library, sha ORDER BY {KEEP}) AS place FROM now
  WHERE library IS NOT NULL AND sha IS NOT NULL),
losers AS (SELECT seq, path, regexp_extract(path, '^(.*)[/\\\\][^/\\\\]*$', 1) AS dir FROM r WHERE place > 1)"""


def _losers(spark: SparkSession, folder: str) -> DataFrame:
    photos = now(spark, folder).filter("library IS NOT NULL AND sha IS NOT NULL")
    kept = photos.groupBy("library", "sha").agg(F.min_by("seq", dedup.keep_key()).alias("kept"))
    return photos.join(kept, ["library", "sha"]).filter("seq != kept").select("seq", "path")


@query("K2_move_targets", f"""
WITH {_LOSERS}, t AS (SELECT *, length(dir) % 3 > 0 AS ok FROM losers)
SELECT seq, CASE WHEN ok THEN dir ELSE '/media/pool' END || CASE WHEN contains(path, '\\') THEN '\\' ELSE '/' END || 'PotentialDuplicates' AS target_dir FROM t""")
def k2(spark: SparkSession, folder: str) -> DataFrame:
    """Folders whose path length divides by three count as read-only here."""
    losers = _losers(spark, folder)
    tried = losers.select(text.folder("path").alias("dir")).distinct().withColumn("ok", F.length("dir") % 3 > 0)
    roots = spark.createDataFrame([(1, "/readonly", False), (2, "/media/pool", True), (3, "/other", True)], "ordinal int, root string, ok boolean")
    return resolve.move_targets(losers, tried, roots).select("seq", "target_dir")


#: The name that is free: its own for the first that wants it, else with the number of those before it.
_FREE = "CASE WHEN k = 0 THEN name ELSE regexp_replace(name, '\\.[^.]*$', '') || '_' || k || regexp_extract(name, '(\\.[^.]*)$', 1) END"


@query("K1_move_plan", f"""
WITH {_LOSERS}, n AS (SELECT *, dir || CASE WHEN contains(path, '\\') THEN '\\' ELSE '/' END || 'PotentialDuplicates' AS target_dir,
  regexp_extract(path, '([^/\\\\]*)$', 1) AS name FROM losers),
k AS (SELECT *, row_number() OVER (PARTITION BY target_dir, upper(name) ORDER BY seq) - 1 AS k FROM n)
SELECT seq, path, target_dir, {_FREE} AS target_name, 'planned' AS status FROM k""")
def k1(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.move_plan(_losers(spark, folder))


@query("K3_collision_free_names", f"""
WITH {_LOSERS}, n AS (SELECT seq, regexp_extract(path, '([^/\\\\]*)$', 1) AS name FROM losers),
k AS (SELECT *, row_number() OVER (PARTITION BY upper(name) ORDER BY seq) - 1 AS k FROM n)
SELECT seq, {_FREE} AS target_name FROM k""")
def k3(spark: SparkSession, folder: str) -> DataFrame:
    """All losers into one folder; no name of the tables looks like one that is made."""
    plan = _losers(spark, folder).withColumn("target_dir", F.lit("/pool/" + text.ASIDE))
    return resolve.collision_free(plan).select("seq", "target_name")


@query("K4_staged_names", f"WITH {NOW}, p AS (SELECT library, seq, {_BY_PATH} AS p FROM now WHERE library IS NOT NULL) SELECT library, seq, printf('%05d.jpg', p) AS staged FROM p")
def k4(spark: SparkSession, folder: str) -> DataFrame:
    return _by_path(spark, folder).select("library", "seq", F.format_string("%05d.jpg", "position").alias("staged"))


@query("K5_manifest", f"WITH {NOW} SELECT seq, 'file ''' || replace(path, '''', '''\\''''') || '''' AS line FROM now")
def k5(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.manifest_lines(now(spark, folder, "path"), "seq")


@query("P5_estimated_runtime", f"WITH {_SHOWS} SELECT slideshow_id, wanted * secs AS seconds FROM s")
def p5(spark: SparkSession, folder: str) -> DataFrame:
    return _shows(spark, folder).select("slideshow_id", (F.col("wanted") * F.col("secs")).alias("seconds"))


@query("P6_runtime_text", f"""
WITH {_SHOWS}, t AS (SELECT slideshow_id, trunc(wanted * secs)::BIGINT AS s FROM s)
SELECT slideshow_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's'
  WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS runtime FROM t""")
def p6(spark: SparkSession, folder: str) -> DataFrame:
    return _shows(spark, folder).select("slideshow_id", text.duration_text(F.col("wanted") * F.col("secs")).alias("runtime"))


@query("P8_space_needed", f"WITH {_SHOWS} SELECT slideshow_id, greatest(2147483648, ceil(wanted * secs / 60)::BIGINT * 157286400 // 2) AS bytes FROM s")
def p8(spark: SparkSession, folder: str) -> DataFrame:
    return _shows(spark, folder).select("slideshow_id", timeline.space_needed("wanted", "secs").alias("bytes"))


@query("P9_snapped_seconds", "SELECT event_id, round_even(least(greatest(value, 1), 20) / 0.5, 0) * 0.5 AS seconds FROM events")
def p9(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", text.snapped("value", 1.0, 20.0, 0.5).alias("seconds"))


@query("P14_safe_file_names", f"""
WITH {NOW} SELECT seq, trim(regexp_replace(path, '[\\x00-\\x1f<>:"/\\\\|?*]', '', 'g')) AS name FROM now""")
def p14(spark: SparkSession, folder: str) -> DataFrame:
    return now(spark, folder, "path").select("seq", text.safe_file_name("path").alias("name"))


@query("P17_first_matching_rule", """
SELECT doc_id, CASE WHEN contains(lower(text), 'broken clock') OR contains(lower(text), 'kaputte uhr') THEN 'clock'
  WHEN contains(lower(text), 'photo') THEN 'photo' WHEN contains(lower(text), 'version') THEN 'version' ELSE 'other' END AS topic FROM documents""")
def p17(spark: SparkSession, folder: str) -> DataFrame:
    rules = [("clock", ("broken clock", "kaputte Uhr")), ("photo", ("Photo",)), ("version", ("version",))]
    return table(spark, folder, "documents").select("doc_id", text.first_match("text", rules, "other").alias("topic"))


@query("P20_display_forms", """
SELECT group_id, regexp_replace(trim(classification), '([^A-Z ])([A-Z])', '\\1 \\2', 'g') AS spaced FROM dup_groups""")
def p20(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "dup_groups").select("group_id", text.spaced(F.trim("classification")).alias("spaced"))


@query("P20_percent", "SELECT doc_id, round_even(align_score * 100, 0)::INT AS percent FROM documents")
def p20b(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.percent("align_score").alias("percent"))


@query("F_hex16", f"WITH {NOW} SELECT seq, printf('%016x', dhash) AS hex, dhash AS back FROM now WHERE dhash IS NOT NULL")
def f_hex(spark: SparkSession, folder: str) -> DataFrame:
    h = now(spark, folder, "dhash").filter("dhash IS NOT NULL").select("seq", text.hex16("dhash").alias("hex"))
    return h.withColumn("back", text.from_hex16("hex"))


@query("F_hamming", "SELECT src, dst, bit_count(xor(src, dst))::INT AS bits FROM edges")
def f_hamming(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "edges").select("src", "dst", keys.hamming("src", "dst").alias("bits"))


@query("F_sha256", "SELECT doc_id, upper(sha256(text)) AS sha256 FROM documents")
def f_sha(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.upper(F.sha2("text", 256)).alias("sha256"))


@query("F_times", f"""
WITH {NOW} SELECT seq, epoch_us(capture_time) AS micros, strftime(capture_time, '%Y-%m-%d %H:%M') AS shown, strftime(capture_time, '%Y:%m:%d %H:%M:%S') AS exif FROM now""")
def f_times(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("capture_time")
    return now(spark, folder, "capture_time").select(
        "seq", keys.micros(t).alias("micros"), F.date_format(t, "yyyy-MM-dd HH:mm").alias("shown"), F.date_format(t, "yyyy:MM:dd HH:mm:ss").alias("exif")
    )


@query("F_path_parts", f"""
WITH {NOW} SELECT seq, lower(regexp_extract(path, '(\\.[^./\\\\]+)$', 1)) AS ext, regexp_extract(path, '([^/\\\\]*)$', 1) AS name,
  regexp_extract(path, '^(.*)[/\\\\][^/\\\\]*$', 1) AS dir, regexp_replace(regexp_extract(path, '([^/\\\\]*)$', 1), '\\.[^.]*$', '') AS stem FROM now""")
def f_path(spark: SparkSession, folder: str) -> DataFrame:
    p = now(spark, folder, "path")
    return p.select("seq", text.extension("path").alias("ext"), text.file_name("path").alias("name"), text.folder("path").alias("dir"), text.stem("path").alias("stem"))


@query("F_numbers", """
SELECT doc_id, printf('%05d', doc_id) AS d5, printf('%.4f', align_score) AS f4, lpad(doc_id::VARCHAR, 8, ' ') AS padded FROM documents WHERE align_score IS NOT NULL""")
def f_numbers(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").filter("align_score IS NOT NULL")
    return d.select(
        "doc_id", F.format_string("%05d", "doc_id").alias("d5"), F.format_string("%.4f", "align_score").alias("f4"), F.lpad(F.col("doc_id").cast("string"), 8, " ").alias("padded"),
    )


@query("F_clock_text", f"""
WITH {_SHOWS}, t AS (SELECT slideshow_id, trunc(wanted * secs)::BIGINT AS s FROM s)
SELECT slideshow_id, (s // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock FROM t""")
def f_clock(spark: SparkSession, folder: str) -> DataFrame:
    return _shows(spark, folder).select("slideshow_id", text.clock_text(F.col("wanted") * F.col("secs")).alias("clock"))


@query("F_try_parse", """
SELECT event_id, TRY_CAST(trim(split_part(split_part(props, ':', 2), '}', 1)) AS BIGINT) AS k, TRY_CAST(event_type AS DOUBLE) AS nothing FROM events""")
def f_parse(spark: SparkSession, folder: str) -> DataFrame:
    value = F.trim(F.split_part(F.split_part("props", F.lit(":"), F.lit(2)), F.lit("}"), F.lit(1)))
    return table(spark, folder, "events").select("event_id", value.try_cast("long").alias("k"), F.col("event_type").try_cast("double").alias("nothing"))


@query("F_wrapped_text", """
WITH w AS (SELECT doc_id, text, list_filter(string_split(text, ' '), lambda x: x <> '') AS words FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN len(words) = 0 THEN text ELSE list_reduce(words, lambda acc, x:
  CASE WHEN length(string_split(acc, chr(1))[-1]) + 1 + length(x) <= 40 THEN acc || ' ' || x ELSE acc || chr(1) || x END) END AS lines FROM w""")
def f_wrapped(spark: SparkSession, folder: str) -> DataFrame:
    """Texts in lines of 40 characters; lines are set apart by a character no text has."""
    texts = table(spark, folder, "documents").filter("text IS NOT NULL")
    return texts.select("doc_id", F.array_join(text.wrapped("text", 40), "\x01").alias("lines"))


_TITLE = "regexp_replace(regexp_extract(path, '([^/\\\\]*)$', 1), '[_.-]', ' ', 'g')"


@query("F_fitted_title", f"""
WITH {NOW}, w AS (SELECT seq, list_filter(string_split({_TITLE}, ' '), lambda x: x <> '') AS words FROM now WHERE path IS NOT NULL),
s AS (SELECT seq, words, unnest(range(72, 15, -2)) AS size FROM w WHERE len(words) > 0),
l AS (SELECT seq, size, floor(120 / (size * 0.5))::INT AS most, string_split(list_reduce(words, lambda acc, x:
  CASE WHEN length(string_split(acc, chr(1))[-1]) + 1 + length(x) <= floor(120 / (size * 0.5)) THEN acc || ' ' || x ELSE acc || chr(1) || x END), chr(1)) AS lines FROM s)
SELECT seq, max(size)::INT AS size, arg_max(array_to_string(lines, chr(1)), size) AS lines FROM l
WHERE size = 16 OR (list_max(list_transform(lines, lambda x: length(x))) <= most AND len(lines) * size * 1.2 <= 100) GROUP BY seq""")
def f_fitted(spark: SparkSession, folder: str) -> DataFrame:
    """File names as titles in a box of 120 by 100."""
    title = F.regexp_replace(text.file_name("path"), "[_.-]", " ")
    titles = now(spark, folder, "path").filter("path IS NOT NULL").select("seq", title.alias("title")).filter(F.trim("title") != "")
    fitted = titles.select("seq", text.fitted("title", 120, 100).alias("f"))
    return fitted.select("seq", "f.size", F.array_join("f.lines", "\x01").alias("lines"))
