"""Queries on duplicate detection: ties, components, groups, the photo to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loupe.functions.keys import area, path_key
from loupe.operators import dedup, edges, graph, order
from loupe.plans.common import KEEP, NOW, now
from loupe.plans.registry import query
from loupe.session import Scratch
from loupe.sources.tables import table

_NEAR = "bit_count(xor(a.dhash, b.dhash)) <= 8"

#: All ties of detection, their components and the groups made of them.
DETECT = f"""
{NOW},
tied AS (
  SELECT a.seq AS a, b.seq AS b, coalesce(a.sha <> b.sha, true) AS visual
  FROM now a JOIN now b ON a.library = b.library AND a.seq <> b.seq AND (a.sha = b.sha OR {_NEAR})
),
reached(seq, other) AS (
  SELECT DISTINCT a, a FROM tied UNION SELECT r.seq, t.b FROM reached r JOIN tied t ON r.other = t.a
),
label AS (SELECT seq, min(other) AS component FROM reached GROUP BY seq),
visual AS (SELECT DISTINCT component FROM tied t JOIN label l ON l.seq = t.a WHERE t.visual),
placed AS (
  SELECT l.component, v.component IS NOT NULL AS visual, n.seq,
    count(*) OVER w AS copies, min(n.seq) OVER w AS set_id,
    row_number() OVER (PARTITION BY l.component, coalesce(sha, '#' || n.seq) ORDER BY {KEEP}) AS place
  FROM label l JOIN now n USING (seq) LEFT JOIN visual v USING (component)
  WINDOW w AS (PARTITION BY l.component, coalesce(sha, '#' || n.seq))
),
members AS (
  SELECT set_id AS group_id, 'ExactOnly' AS classification, seq FROM placed WHERE copies > 1
  UNION ALL
  SELECT component, 'HasVisualComponent', seq FROM placed WHERE visual AND place = 1
  QUALIFY count(*) OVER (PARTITION BY component) >= 2
),
ranked AS (
  SELECT m.group_id, m.classification, n.*,
    row_number() OVER (PARTITION BY m.group_id, m.classification ORDER BY {KEEP}) AS place,
    count(*) OVER (PARTITION BY m.group_id, m.classification) AS n,
    min(m.seq) OVER (PARTITION BY m.group_id, m.classification) AS first_seq
  FROM members m JOIN now n USING (seq)
),
grouped AS (
  SELECT group_id, classification, n, first_seq, seq AS recommended_seq, path AS recommended_path,
         capture_time AS recommended_time
  FROM ranked WHERE place = 1
)"""


@query("A1_size_collisions", f"""
WITH {NOW} SELECT seq, file_size, library IS NOT NULL AND file_size IS NOT NULL
  AND count(*) OVER (PARTITION BY library, file_size) > 1 AS collides FROM now""")
def a1(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.size_collisions(now(spark, folder, "library", "file_size")).select("seq", "file_size", "collides")


@query("A2_exact_groups", f"""
WITH {NOW}, best AS (
  SELECT library, sha, count(*) OVER (PARTITION BY library, sha) AS n,
    row_number() OVER (PARTITION BY library, sha ORDER BY {KEEP}) AS place, seq, path, min(seq) OVER (PARTITION BY library, sha) AS group_id
  FROM now WHERE library IS NOT NULL AND sha IS NOT NULL)
SELECT group_id, n, seq AS recommended_seq, path AS recommended_path FROM best WHERE n > 1 AND place = 1""")
def a2(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup.provisional_groups(now(spark, folder)).groups
    return found.select("group_id", "n", "recommended_seq", "recommended_path")


@query("J1_near_pairs", f"""
WITH {NOW} SELECT a.seq AS id_a, b.seq AS id_b, bit_count(xor(a.dhash, b.dhash))::INT AS bits
FROM now a JOIN now b ON a.library = b.library AND a.seq < b.seq AND {_NEAR}""")
def j1(spark: SparkSession, folder: str) -> DataFrame:
    return edges.near_hashes(now(spark, folder, "library", "dhash"))


@query("J2_exact_classes", f"""
WITH {NOW}, c AS (SELECT seq, min(seq) OVER w AS leader, count(*) OVER w AS copies FROM now
  WHERE library IS NOT NULL AND sha IS NOT NULL WINDOW w AS (PARTITION BY library, sha))
SELECT * FROM c WHERE copies > 1""")
def j2(spark: SparkSession, folder: str) -> DataFrame:
    return edges.exact_classes(now(spark, folder, "library", "sha"))


@query("J3_visual_pairs", f"""
WITH {NOW} SELECT a.seq AS id_a, b.seq AS id_b
FROM now a JOIN now b ON a.library = b.library AND a.seq < b.seq AND {_NEAR} AND coalesce(a.sha <> b.sha, true)""")
def j3(spark: SparkSession, folder: str) -> DataFrame:
    photos = now(spark, folder, "library", "dhash", "sha")
    shas = photos.select("seq", "sha")
    pairs = edges.near_hashes(photos).join(shas.toDF("id_a", "a"), "id_a").join(shas.toDF("id_b", "b"), "id_b")
    return pairs.filter(~F.coalesce(F.col("a") == F.col("b"), F.lit(False))).select("id_a", "id_b")


_TIME = f"""
WITH {NOW}, s AS (SELECT lag(seq) OVER w AS u, seq AS v, capture_time - lag(capture_time) OVER w AS gap FROM now
  WHERE library IS NOT NULL AND capture_time IS NOT NULL WINDOW w AS (PARTITION BY library ORDER BY capture_time, seq))"""


@query("J4_time_links", _TIME + " SELECT u, v FROM s WHERE gap <= INTERVAL 30 MINUTE")
def j4(spark: SparkSession, folder: str) -> DataFrame:
    return edges.time_links(now(spark, folder, "library", "capture_time"))


SIMILAR = f"""
{NOW},
linked AS (
  SELECT a.seq AS a, b.seq AS b FROM now a JOIN now b ON a.library = b.library AND a.seq <> b.seq AND {_NEAR}
  UNION SELECT u, v FROM (
    SELECT lag(seq) OVER w AS u, seq AS v, capture_time - lag(capture_time) OVER w AS gap FROM now
    WHERE library IS NOT NULL AND capture_time IS NOT NULL WINDOW w AS (PARTITION BY library ORDER BY capture_time, seq))
  WHERE gap <= INTERVAL 30 MINUTE),
both_ways AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
similar_to(seq, other) AS (
  SELECT seq, seq FROM now WHERE library IS NOT NULL UNION SELECT r.seq, t.b FROM similar_to r JOIN both_ways t ON r.other = t.a),
similar_label AS (SELECT seq, min(other) AS component FROM similar_to GROUP BY seq)"""


@query("J5_similar_components", f"WITH RECURSIVE {SIMILAR} SELECT seq, component FROM similar_label")
def j5(spark: SparkSession, folder: str) -> DataFrame:
    return order.similar_clusters(now(spark, folder, "library", "capture_time", "dhash"))


@query("J6_attach_hashes", f"""
WITH {NOW}, known AS (
  SELECT upper(replace(path, '/', '\\')) AS key, min(dhash) AS dhash FROM photos WHERE dhash <> 0 GROUP BY 1)
SELECT n.seq, coalesce(n.dhash, k.dhash) AS dhash FROM now n LEFT JOIN known k ON k.key = upper(replace(n.path, '/', '\\'))""")
def j6(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "photos").select("path", "dhash").filter("dhash != 0")
    return dedup.attach_hashes(now(spark, folder, "path", "dhash"), known).select("seq", "dhash")


@query("G1_components", """
WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
reached(seq, other) AS (SELECT a, a FROM e UNION SELECT r.seq, e.b FROM reached r JOIN e ON r.other = e.a)
SELECT seq, min(other) AS component FROM reached GROUP BY seq""")
def g1(spark: SparkSession, folder: str) -> DataFrame:
    return graph.components(table(spark, folder, "edges"), "src", "dst")


@query("G2_bridged", """
WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
reached(seq, other) AS (SELECT a, a FROM e UNION SELECT r.seq, e.b FROM reached r JOIN e ON r.other = e.a),
label AS (SELECT seq, min(other) AS component FROM reached GROUP BY seq)
SELECT component, count(*) AS n, count(*) * (count(*) - 1) // 2 - any_value(direct) AS bridged
FROM label JOIN (SELECT component, count(*) // 2 AS direct FROM e JOIN label ON label.seq = e.a GROUP BY component) USING (component)
GROUP BY component""")
def g2(spark: SparkSession, folder: str) -> DataFrame:
    """Per component its size and the pairs that are tied only through others."""
    pairs = table(spark, folder, "edges").filter("src != dst").select(F.least("src", "dst").alias("seq"), F.greatest("src", "dst").alias("to")).distinct()
    label = graph.components(pairs, "seq", "to")
    direct = pairs.join(label, "seq").groupBy("component").agg(F.count(F.lit(1)).alias("direct"))
    sizes = label.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(direct, "component").selectExpr("component", "n", "n * (n - 1) div 2 - direct AS bridged")


@query("A3_components_of_two_or_more", f"""
WITH RECURSIVE {SIMILAR} SELECT component, count(*) AS n FROM similar_label GROUP BY component HAVING count(*) >= 2""")
def a3(spark: SparkSession, folder: str) -> DataFrame:
    return j5(spark, folder).groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")


@query("A4_photo_to_keep", f"""
WITH {NOW}, r AS (SELECT library, seq, row_number() OVER (PARTITION BY library ORDER BY {KEEP}) AS place FROM now WHERE library IS NOT NULL)
SELECT library, seq FROM r WHERE place = 1""")
def a4(spark: SparkSession, folder: str) -> DataFrame:
    photos = now(spark, folder, "library", "path", "file_size", "width", "height", "capture_time")
    return photos.filter("library IS NOT NULL").groupBy("library").agg(F.min_by("seq", dedup.keep_key()).alias("seq"))


@query("A5_classified_groups", f"WITH RECURSIVE {DETECT} SELECT classification, count(*) AS n_groups, sum(n)::BIGINT AS n_photos FROM grouped GROUP BY 1")
def a5(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup.detect(now(spark, folder)).groups
    return found.groupBy("classification").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_photos"))


@query("A6_group_members", f"WITH RECURSIVE {DETECT} SELECT group_id, classification, seq FROM members")
def a6(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.detect(now(spark, folder)).members


@query("O1_ordered_groups", f"""
WITH RECURSIVE {DETECT} SELECT *, row_number() OVER (ORDER BY n DESC, recommended_time ASC NULLS LAST, first_seq, classification) AS position
FROM grouped""")
def o1(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.ordered_groups(dedup.detect(now(spark, folder)).groups)


@query("J11_has_visual", f"WITH RECURSIVE {DETECT} SELECT l.component, bool_or(v.component IS NOT NULL) AS visual FROM label l LEFT JOIN visual v USING (component) GROUP BY 1")
def j11(spark: SparkSession, folder: str) -> DataFrame:
    return _visual(*_tied(now(spark, folder, "library", "dhash", "sha")))


def _tied(photos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ties (u, v, visual) by looks and bytes, and the components (seq, component) they make."""
    scratch = Scratch(photos.sparkSession, "tied")
    exact = edges.exact_classes(photos).filter("seq != leader").select(F.col("leader").alias("u"), F.col("seq").alias("v"), F.lit(False).alias("visual"))
    links, _ = scratch.cut(edges.look_links(photos).unionByName(exact), "links")
    label, _ = scratch.cut(graph.components(links, "u", "v"), "label")
    return links, label


def _visual(links: DataFrame, label: DataFrame) -> DataFrame:
    return links.select(F.col("u").alias("seq"), "visual").join(label, "seq").groupBy("component").agg(F.bool_or("visual").alias("visual"))


@query("J12_exact_losers", f"""
WITH {NOW}, r AS (SELECT seq, row_number() OVER (PARTITION BY library, sha ORDER BY {KEEP}) AS place FROM now
  WHERE library IS NOT NULL AND sha IS NOT NULL) SELECT seq FROM r WHERE place > 1""")
def j12(spark: SparkSession, folder: str) -> DataFrame:
    photos = now(spark, folder).filter("library IS NOT NULL AND sha IS NOT NULL")
    kept = photos.groupBy("library", "sha").agg(F.min_by("seq", dedup.keep_key()).alias("seq"))
    return photos.select("seq").join(kept, "seq", "left_anti")


@query("A7_counters", f"""
WITH {NOW}, c AS (SELECT count(*) AS n, count(dhash) AS hashed, count(sha) AS with_bytes FROM now)
SELECT n, hashed, with_bytes, hashed * (hashed - 1) // 2 AS possible_pairs FROM c""")
def a7(spark: SparkSession, folder: str) -> DataFrame:
    c = now(spark, folder, "dhash", "sha").agg(F.count(F.lit(1)).alias("n"), F.count("dhash").alias("hashed"), F.count("sha").alias("with_bytes"))
    return c.selectExpr("n", "hashed", "with_bytes", "hashed * (hashed - 1) div 2 AS possible_pairs")


@query("A8_spare_copies", f"""
WITH {NOW} SELECT library, sum(c - 1)::BIGINT AS spare FROM (SELECT library, sha, count(*) AS c FROM now
  WHERE library IS NOT NULL AND sha IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY library""")
def a8(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.provisional_groups(now(spark, folder)).groups.join(
        now(spark, folder, "library").withColumnRenamed("seq", "first_seq"), "first_seq"
    ).groupBy("library").agg(F.sum(F.col("n") - 1).alias("spare"))


@query("A9_any_signal", f"WITH {NOW} SELECT library, bool_or(dhash IS NOT NULL) AS any_hash, bool_or(capture_time IS NOT NULL) AS any_time FROM now GROUP BY library")
def a9(spark: SparkSession, folder: str) -> DataFrame:
    photos = now(spark, folder, "library", "dhash", "capture_time")
    return photos.groupBy("library").agg(F.bool_or(F.col("dhash").isNotNull()).alias("any_hash"), F.bool_or(F.col("capture_time").isNotNull()).alias("any_time"))


_NAMES = "string_agg(regexp_extract(n.path, '([^/\\\\]*)$', 1), '|' ORDER BY regexp_extract(n.path, '([^/\\\\]*)$', 1))"


@query("A11_members_of_components", f"""
WITH {NOW} SELECT g.group_id, string_agg(g.seq::VARCHAR, ',' ORDER BY g.seq) AS members
FROM (SELECT DISTINCT group_id, seq FROM group_members WHERE group_id IS NOT NULL AND seq IS NOT NULL) g JOIN now n USING (seq) GROUP BY g.group_id""")
def a11(spark: SparkSession, folder: str) -> DataFrame:
    there = _listed(spark, folder).join(now(spark, folder, "library").select("seq"), "seq")
    return there.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_list("seq")), ",").alias("members"))


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "group_members").filter("group_id IS NOT NULL AND seq IS NOT NULL").select("group_id", "seq").distinct()


@query("A12_group_names", f"""
WITH {NOW} SELECT g.group_id, {_NAMES} AS names
FROM (SELECT DISTINCT group_id, seq FROM group_members WHERE group_id IS NOT NULL AND seq IS NOT NULL) g JOIN now n USING (seq)
WHERE n.path IS NOT NULL GROUP BY g.group_id""")
def a12(spark: SparkSession, folder: str) -> DataFrame:
    from loupe.functions.text import file_name

    there = _listed(spark, folder).join(now(spark, folder, "path").filter("path IS NOT NULL"), "seq")
    return there.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_list(file_name("path"))), "|").alias("names"))


@query("A14_distinct_pairs", "SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM edges WHERE src <> dst")
def a14(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "edges").filter("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


@query("A18_resolved_totals", f"""
WITH RECURSIVE {DETECT}, moved AS (
  SELECT DISTINCT m.seq FROM members m JOIN grouped g USING (group_id, classification)
  WHERE classification = 'ExactOnly' AND m.seq <> g.recommended_seq)
SELECT (SELECT count(*) FROM now WHERE library IS NOT NULL) - (SELECT count(*) FROM moved) AS remaining,
       (SELECT count(*) FROM grouped WHERE classification = 'ExactOnly') AS groups_resolved,
       (SELECT count(*) FROM moved) AS photos_moved""")
def a18(spark: SparkSession, folder: str) -> DataFrame:
    photos = now(spark, folder)
    found = dedup.detect(photos)
    exact = found.groups.filter(F.col("classification") == dedup.EXACT)
    moved = found.members.filter(F.col("classification") == dedup.EXACT).join(exact.select("group_id", "recommended_seq"), "group_id")
    moved = moved.filter("seq != recommended_seq").select("seq").distinct()
    totals = photos.filter("library IS NOT NULL").agg(F.count(F.lit(1)).alias("all"))
    counted = moved.agg(F.count(F.lit(1)).alias("photos_moved")).crossJoin(exact.agg(F.count(F.lit(1)).alias("groups_resolved")))
    # three frames of one row each
    return totals.crossJoin(counted).selectExpr("all - photos_moved AS remaining", "groups_resolved", "photos_moved")


@query("J7_remaining_photos", f"""
WITH RECURSIVE {DETECT} SELECT seq FROM now WHERE library IS NOT NULL AND seq NOT IN (
  SELECT m.seq FROM members m JOIN grouped g USING (group_id, classification)
  WHERE classification = 'ExactOnly' AND m.seq <> g.recommended_seq)""")
def j7(spark: SparkSession, folder: str) -> DataFrame:
    photos = now(spark, folder)
    found = dedup.detect(photos)
    exact = found.groups.filter(F.col("classification") == dedup.EXACT).select("group_id", "recommended_seq")
    moved = found.members.filter(F.col("classification") == dedup.EXACT).join(exact, "group_id").filter("seq != recommended_seq")
    return photos.filter("library IS NOT NULL").select("seq").join(moved.select("seq"), "seq", "left_anti")


@query("T2_provisional_and_final", f"""
WITH RECURSIVE {DETECT}, prov AS (
  SELECT min(seq) AS group_id FROM now WHERE library IS NOT NULL AND sha IS NOT NULL GROUP BY library, sha HAVING count(*) > 1),
fin AS (SELECT group_id FROM grouped WHERE classification = 'ExactOnly')
SELECT coalesce(p.group_id, f.group_id) AS group_id, l.component IN (SELECT component FROM visual) AS inside_visual
FROM prov p FULL JOIN fin f ON p.group_id = f.group_id JOIN label l ON l.seq = coalesce(p.group_id, f.group_id)""")
def t2(spark: SparkSession, folder: str) -> DataFrame:
    """Provisional exact groups, and whether the final grouping puts them inside a visual one."""
    photos = now(spark, folder)
    early = dedup.provisional_groups(photos).groups.select("group_id")
    links, label = _tied(photos)
    visual = _visual(links, label)
    return early.join(label.withColumnRenamed("seq", "group_id"), "group_id").join(visual, "component").select("group_id", F.col("visual").alias("inside_visual"))


@query("U2_union_of_ties", f"""
WITH {NOW} SELECT a.seq AS src, b.seq AS dst,
  CASE WHEN a.sha = b.sha THEN 'exact' ELSE 'visual' END AS kind
FROM now a JOIN now b ON a.library = b.library AND a.seq < b.seq AND {_NEAR}
UNION ALL
SELECT min(seq) OVER (PARTITION BY library, sha), seq, 'copy' FROM now WHERE library IS NOT NULL AND sha IS NOT NULL
QUALIFY min(seq) OVER (PARTITION BY library, sha) <> seq""")
def u2(spark: SparkSession, folder: str) -> DataFrame:
    photos = now(spark, folder, "library", "dhash", "sha")
    shas = photos.select("seq", "sha")
    pairs = edges.near_hashes(photos).join(shas.toDF("id_a", "a"), "id_a").join(shas.toDF("id_b", "b"), "id_b")
    kind = F.when(F.col("a") == F.col("b"), "exact").otherwise("visual")
    near = pairs.select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"), kind.alias("kind"))
    copies = edges.exact_classes(photos).filter("seq != leader").select(F.col("leader").alias("src"), F.col("seq").alias("dst"), F.lit("copy").alias("kind"))
    return near.unionByName(copies)


@query("P1_enriched", f"WITH {NOW} SELECT seq, dhash, sha AS sha256 FROM now")
def p1(spark: SparkSession, folder: str) -> DataFrame:
    return now(spark, folder, "dhash", "sha").withColumnRenamed("sha", "sha256")


@query("P2_hashed_only", f"WITH {NOW} SELECT seq FROM now WHERE dhash IS NOT NULL")
def p2(spark: SparkSession, folder: str) -> DataFrame:
    return now(spark, folder, "dhash").filter("dhash IS NOT NULL").select("seq")


@query("P3_visual_groups", "SELECT DISTINCT group_id FROM dup_groups WHERE lower(trim(classification)) = 'hasvisualcomponent'")
def p3(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "dup_groups").filter(F.lower(F.trim("classification")) == dedup.VISUAL.lower()).select("group_id").distinct()


@query("P4_not_recommended", """
SELECT DISTINCT m.group_id, m.seq FROM group_members m JOIN dup_groups g ON g.group_id = m.group_id
WHERE upper(m.path) <> upper(g.recommended_path)""")
def p4(spark: SparkSession, folder: str) -> DataFrame:
    groups = table(spark, folder, "dup_groups").select("group_id", F.upper("recommended_path").alias("kept"))
    return table(spark, folder, "group_members").join(groups, "group_id").filter(F.upper("path") != F.col("kept")).select("group_id", "seq").distinct()


@query("P23_review_flags", f"""
WITH {NOW}, m AS (SELECT DISTINCT group_id, seq FROM group_members WHERE group_id IS NOT NULL AND seq IS NOT NULL)
SELECT m.group_id, m.seq, row_number() OVER (PARTITION BY m.group_id ORDER BY {KEEP.replace(', seq', ', n.seq')}) = 1 AS is_recommended
FROM m JOIN now n ON n.seq = m.seq""")
def p23(spark: SparkSession, folder: str) -> DataFrame:
    photos = now(spark, folder, "path", "file_size", "width", "height", "capture_time")
    place = F.row_number().over(Window.partitionBy("group_id").orderBy(*dedup.keep_order()))
    return _listed(spark, folder).join(photos, "seq").select("group_id", "seq", (place == 1).alias("is_recommended"))


@query("J8_unselected_removed", """
SELECT DISTINCT seq FROM photos p WHERE NOT EXISTS (
  SELECT 1 FROM group_members m WHERE m.seq = p.seq AND NOT coalesce(m.is_recommended, false)) AND seq IS NOT NULL""")
def j8(spark: SparkSession, folder: str) -> DataFrame:
    dropped = table(spark, folder, "group_members").filter(~F.coalesce("is_recommended", F.lit(False))).select("seq")
    return table(spark, folder, "photos").filter("seq IS NOT NULL").select("seq").distinct().join(dropped, "seq", "left_anti")


@query("J9_not_recorded_by_path", f"""
WITH {NOW} SELECT seq FROM now n WHERE path IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM dup_groups g WHERE upper(replace(g.recommended_path, '/', '\\')) = upper(replace(n.path, '/', '\\')))""")
def j9(spark: SparkSession, folder: str) -> DataFrame:
    pinned = table(spark, folder, "dup_groups").select(path_key("recommended_path").alias("key"))
    return now(spark, folder, "path").filter("path IS NOT NULL").withColumn("key", path_key("path")).join(pinned, "key", "left_anti").select("seq")


@query("J10_recorded_by_path", f"""
WITH {NOW} SELECT seq FROM now n WHERE EXISTS (
  SELECT 1 FROM dup_groups g WHERE upper(replace(g.recommended_path, '/', '\\')) = upper(replace(n.path, '/', '\\')))""")
def j10(spark: SparkSession, folder: str) -> DataFrame:
    pinned = table(spark, folder, "dup_groups").select(path_key("recommended_path").alias("key"))
    return now(spark, folder, "path").withColumn("key", path_key("path")).join(pinned, "key", "left_semi").select("seq")


@query("F_area", f"WITH {NOW} SELECT seq, CASE WHEN width > 0 AND height > 0 THEN width::BIGINT * height ELSE 0 END AS area FROM now")
def f_area(spark: SparkSession, folder: str) -> DataFrame:
    return now(spark, folder, "width", "height").select("seq", area("width", "height").alias("area"))


@query("U1_singletons_then_hashed", f"""
WITH {NOW}, c AS (SELECT seq, library IS NOT NULL AND file_size IS NOT NULL AND count(*) OVER (PARTITION BY library, file_size) > 1 AS collides FROM now)
SELECT seq, row_number() OVER (ORDER BY collides, seq) AS position FROM c""")
def u1(spark: SparkSession, folder: str) -> DataFrame:
    """Photos of a size of their own first, then those whose bytes must be compared."""
    from loupe.operators.positions import with_position

    found = dedup.size_collisions(now(spark, folder, "library", "file_size"))
    return with_position(found.select("seq", "collides"), ["collides", "seq"]).select("seq", "position")
