"""Queries p1, p2 and p4 to p9 over the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm import best, clusters, diverse, groups, leaks, near, split, tokenizer
from loupe.operators.current import current_photos
from loupe.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return groups.photo_groups(table(spark, folder, "photos"), table(spark, folder, "edges"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return best.best_members(table(spark, folder, "group_members"), table(spark, folder, "photos"))


def p2_survivors(spark: SparkSession, folder: str) -> DataFrame:
    return best.surviving_records(table(spark, folder, "group_members"), table(spark, folder, "photos"))


def p4_selection(spark: SparkSession, folder: str) -> DataFrame:
    return diverse.varied_subsets(table(spark, folder, "slideshows"), table(spark, folder, "photos"))


def p4_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """What each selection holds: photos, different ones, greatest place, photos of the library asked for."""
    chosen = p4_selection(spark, folder)
    asked = table(spark, folder, "slideshows").select("slideshow_id", "library").distinct()
    now = current_photos(table(spark, folder, "photos"), "library")
    found = chosen.join(asked, "slideshow_id").join(now.withColumnRenamed("library", "of"), "seq")
    return found.groupBy("slideshow_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("seq").alias("different"), F.max("place").alias("places"),
        F.count_if(F.col("library") == F.col("of")).alias("own"),
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_photos(table(spark, folder, "photos"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return groups.near_groups(table(spark, folder, "photos"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.alike_clusters(table(spark, folder, "photos")).select("cluster", "typical")


def p6_kmeans(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.kmeans_clusters(table(spark, folder, "photos")).select("library", "n", "typical")


def p6_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """What the cells of each library hold: every photo once, and every typical photo in a cell of its own."""
    cells = clusters.kmeans_clusters(table(spark, folder, "photos"))
    return cells.groupBy("library").agg(F.sum("n").alias("n"), (F.count(F.lit(1)) - F.countDistinct("typical")).alias("shared"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode_documents(table(spark, folder, "documents"))


def p7_text(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that the token ids stand for."""
    return tokenizer.decode_column(p7_ids(spark, folder), "ids", keep=["doc_id"])


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "heldout"))


def p8_passages(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_passages(table(spark, folder, "documents"), table(spark, folder, "heldout"))


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.without_leaks(table(spark, folder, "documents"), table(spark, folder, "heldout")).select("doc_id")


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split.split_documents(table(spark, folder, "documents"))


def p9_text(spark: SparkSession, folder: str) -> DataFrame:
    """The texts put together again from their pieces, and how many pieces or overlaps are over the limit."""
    part = F.expr("substring(piece_text, cast(new - start + 1 AS int))")
    pieces = p9_pieces(spark, folder).withColumn("part", part)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "part"))), lambda x: x["part"]), "")
    return pieces.groupBy("doc_id").agg(whole.alias("text"), F.count_if(F.col("tokens") > split.LIMIT_TOKENS).alias("over"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p2_found": p2_found,
        "p2_survivors": p2_survivors,
        "p4_selection": p4_selection,
        "p4_sizes": p4_sizes,
        "p5_found": p5_found,
        "p5_groups": p5_groups,
        "p6_found": p6_found,
        "p6_kmeans": p6_kmeans,
        "p6_sizes": p6_sizes,
        "p7_ids": p7_ids,
        "p7_text": p7_text,
        "p8_found": p8_found,
        "p8_passages": p8_passages,
        "p8_clean": p8_clean,
        "p9_pieces": p9_pieces,
        "p9_text": p9_text,
    }


#: The current photos, as TESTDATA.md words them.
NOW = """
now AS (
  SELECT seq, any_value(library) AS library, any_value(device) AS device, any_value(path) AS path,
         any_value(file_size) AS file_size, any_value(width) AS width, any_value(height) AS height,
         any_value(capture_time) AS capture_time,
         any_value(CASE WHEN dhash <> 0 THEN dhash END) AS dhash,
         any_value(CASE WHEN regexp_full_match(trim(sha256), '[0-9A-Fa-f]{64}') THEN upper(trim(sha256)) END) AS sha
  FROM (SELECT DISTINCT * FROM photos
        QUALIFY rank() OVER (PARTITION BY seq ORDER BY loaded_at DESC NULLS LAST) = 1)
  GROUP BY seq
)"""

P1_SQL = f"""
WITH RECURSIVE {NOW},
tied AS (
  SELECT a.seq AS a, b.seq AS b FROM now a JOIN now b ON a.library = b.library AND a.seq <> b.seq AND a.sha = b.sha
  UNION SELECT a.seq, b.seq FROM now a JOIN now b ON a.library = b.library AND a.seq <> b.seq
    AND bit_count(xor(a.dhash, b.dhash)) <= 8
  UNION SELECT a.seq, b.seq FROM now a JOIN now b ON a.library = b.library AND a.seq <> b.seq
    AND upper(replace(a.path, '/', '\\')) = upper(replace(b.path, '/', '\\'))
  UNION SELECT a.seq, b.seq FROM (SELECT src, dst, kind FROM edges UNION SELECT dst, src, kind FROM edges) e
    JOIN now a ON a.seq = e.src JOIN now b ON b.seq = e.dst
    WHERE a.library = b.library AND a.seq <> b.seq AND lower(e.kind) IN ('exact', 'visual')
),
reached(seq, other) AS (
  SELECT a, a FROM tied UNION SELECT r.seq, t.b FROM reached r JOIN tied t ON r.other = t.a
)
SELECT seq, min(other) AS component FROM reached GROUP BY seq
"""

BEST = """
members AS (SELECT DISTINCT group_id, seq FROM group_members WHERE group_id IS NOT NULL AND seq IS NOT NULL),
best AS (
  SELECT m.group_id, count(*) AS n, arg_min(m.seq, (
      -CASE WHEN width > 0 AND height > 0 THEN width::BIGINT * height ELSE 0 END,
      -coalesce(file_size, -1), coalesce(capture_time, TIMESTAMP '9999-12-31'), coalesce(length(path), 1000000),
      upper(path), m.seq)) AS seq
  FROM members m JOIN now USING (seq) GROUP BY m.group_id HAVING count(*) >= 2
)"""

P2_SQL = f"WITH {NOW}, {BEST} SELECT group_id, seq FROM best"

P2_SURVIVORS_SQL = f"""
WITH {NOW}, {BEST},
latest AS (
  SELECT DISTINCT ON (seq) seq, loaded_at, capture_time, file_size,
         CASE WHEN width > 0 AND height > 0 THEN width END AS width,
         CASE WHEN width > 0 AND height > 0 THEN height END AS height,
         nullif(trim(device), '') AS device, nullif(trim(format), '') AS format
  FROM photos ORDER BY seq, loaded_at DESC NULLS LAST
),
flagged AS (
  SELECT group_id, seq, coalesce(bool_or(is_recommended), false) AS trusted
  FROM group_members WHERE group_id IS NOT NULL GROUP BY ALL
),
ranked AS (
  SELECT *, (NOT trusted,
    -((width IS NOT NULL)::INT + (height IS NOT NULL)::INT + (capture_time IS NOT NULL)::INT
      + (device IS NOT NULL)::INT + (format IS NOT NULL)::INT + (file_size IS NOT NULL)::INT),
    -epoch_us(loaded_at), seq) AS place
  FROM flagged JOIN latest USING (seq)
)
SELECT b.group_id, b.seq, b.n,
  arg_min(r.width, place) FILTER (r.width IS NOT NULL) AS width,
  arg_min(r.height, place) FILTER (r.height IS NOT NULL) AS height,
  arg_min(r.capture_time, place) FILTER (r.capture_time IS NOT NULL) AS capture_time,
  arg_min(r.device, place) FILTER (r.device IS NOT NULL) AS device,
  arg_min(r.format, place) FILTER (r.format IS NOT NULL) AS format,
  arg_min(r.file_size, place) FILTER (r.file_size IS NOT NULL) AS file_size
FROM best b JOIN ranked r USING (group_id) GROUP BY b.group_id, b.seq, b.n
"""

P5_SQL = f"""
WITH {NOW}
SELECT a.seq AS seq_a, b.seq AS seq_b
FROM now a JOIN now b ON a.library = b.library AND a.seq < b.seq
WHERE bit_count(xor(a.dhash, b.dhash)) <= 8 AND (a.sha IS NULL OR b.sha IS NULL OR a.sha <> b.sha)
"""

P5_GROUPS_SQL = f"""
WITH RECURSIVE {NOW},
near AS (
  SELECT a.seq AS a, b.seq AS b FROM now a JOIN now b ON a.library = b.library AND a.seq <> b.seq
  WHERE bit_count(xor(a.dhash, b.dhash)) <= 8 AND (a.sha IS NULL OR b.sha IS NULL OR a.sha <> b.sha)),
reached(seq, other) AS (SELECT DISTINCT a, a FROM near UNION SELECT r.seq, n.b FROM reached r JOIN near n ON r.other = n.a),
first AS (SELECT seq, min(seq) OVER (PARTITION BY library, dhash) AS representative FROM now WHERE library IS NOT NULL AND dhash IS NOT NULL)
SELECT r.seq, any_value(f.representative) AS representative, min(r.other) AS component FROM reached r JOIN first f USING (seq) GROUP BY r.seq
"""

P6_SQL = f"""
WITH RECURSIVE {NOW},
tied AS (
  SELECT a.seq AS a, b.seq AS b FROM now a JOIN now b ON a.library = b.library AND a.seq <> b.seq
    AND bit_count(xor(a.dhash, b.dhash)) <= 8
  UNION
  SELECT * FROM (
    SELECT seq AS a, b FROM (
      SELECT seq, capture_time AS t, lag(seq) OVER w AS b, lag(capture_time) OVER w AS s
      FROM now WHERE library IS NOT NULL AND capture_time IS NOT NULL
      WINDOW w AS (PARTITION BY library ORDER BY capture_time, seq))
    WHERE t - s <= INTERVAL 30 MINUTE)
),
both_ways AS (SELECT a, b FROM tied UNION SELECT b, a FROM tied),
reached(seq, other) AS (
  SELECT a, a FROM both_ways UNION SELECT r.seq, t.b FROM reached r JOIN both_ways t ON r.other = t.a
),
member AS (SELECT seq, min(other) AS cluster FROM reached GROUP BY seq),
sums AS (
  SELECT m.cluster, m.seq, sum(bit_count(xor(x.dhash, y.dhash))) AS s
  FROM member m JOIN now x ON x.seq = m.seq JOIN member o ON o.cluster = m.cluster JOIN now y ON y.seq = o.seq
  WHERE x.dhash IS NOT NULL AND y.dhash IS NOT NULL GROUP BY ALL
)
SELECT m.cluster, coalesce(arg_min(s.seq, (s.s, s.seq)), m.cluster) AS typical
FROM (SELECT DISTINCT cluster FROM member) m LEFT JOIN sums s USING (cluster) GROUP BY m.cluster
"""


P4_SIZES_SQL = f"""
WITH {NOW}, c AS (SELECT library, count(*) AS c FROM now WHERE library IS NOT NULL GROUP BY library)
SELECT slideshow_id, least(wanted, c) AS n, least(wanted, c) AS different, least(wanted, c) AS places, least(wanted, c) AS own
FROM (SELECT DISTINCT slideshow_id, library, wanted FROM slideshows) JOIN c USING (library) WHERE wanted > 0
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_sizes": P4_SIZES_SQL,
        "p6_sizes": f"WITH {NOW} SELECT library, count(*) AS n, 0::BIGINT AS shared FROM now WHERE library IS NOT NULL GROUP BY library",
        "p7_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p9_text": "SELECT doc_id, text, 0::BIGINT AS over FROM documents WHERE text <> ''",
        "p1_found": P1_SQL,
        "p2_found": P2_SQL,
        "p2_survivors": P2_SURVIVORS_SQL,
        "p5_found": P5_SQL,
        "p5_groups": P5_GROUPS_SQL,
        "p6_found": P6_SQL,
    }
