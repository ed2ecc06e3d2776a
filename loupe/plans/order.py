"""Queries on orders, spacing and threshold reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loupe.functions import text
from loupe.operators import order, report
from loupe.operators.positions import with_position
from loupe.plans.common import NOW, now
from loupe.plans.dedup import SIMILAR
from loupe.plans.registry import query
from loupe.session import Scratch
from loupe.sources.tables import table

_MIX = ("library", "path", "dhash", "sha", "capture_time")


@query("W1_time_clusters", f"""
WITH {NOW}, s AS (SELECT library, seq, path, capture_time, CASE WHEN capture_time - lag(capture_time) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS begins
  FROM now WHERE library IS NOT NULL WINDOW w AS (PARTITION BY library ORDER BY capture_time ASC NULLS LAST, upper(path), path, seq))
SELECT seq, (1 + sum(begins) OVER (PARTITION BY library ORDER BY capture_time ASC NULLS LAST, upper(path), path, seq))::BIGINT AS number FROM s""")
def w1(spark: SparkSession, folder: str) -> DataFrame:
    return order.time_clusters(now(spark, folder, "library", "path", "capture_time"))


#: Places of the members of clusters: the smallest path first, then whatever differs most from the last.
_CHAIN = f"""
{SIMILAR},
member AS (SELECT l.component, n.library, n.seq, upper(n.path) AS key, n.path, n.dhash FROM now n JOIN similar_label l USING (seq) WHERE n.library IS NOT NULL),
chain(component, place, seq, placed) AS (
  SELECT component, 0, arg_min(seq, (key, path, seq)), [arg_min(seq, (key, path, seq))] FROM member GROUP BY component
  UNION ALL
  SELECT component, place + 1, next, list_append(placed, next) FROM (
    SELECT c.component, c.place, c.placed, arg_min(m.seq, (-coalesce(bit_count(xor(m.dhash, o.dhash)), 0), m.key, m.path, m.seq)) AS next
    FROM chain c JOIN member o ON o.seq = c.seq JOIN member m ON m.component = c.component AND NOT list_contains(c.placed, m.seq)
    GROUP BY c.component, c.place, c.placed))"""

#: Slots given out in order: the first free one from the aim on, else the first free one.
_GIVEN = """
aims AS (SELECT *, (round_even(k * (n::DOUBLE / size), 0)::BIGINT + number % n) % n AS aim FROM (
  SELECT *, row_number() OVER (PARTITION BY library, number ORDER BY place) - 1 AS k, count(*) OVER (PARTITION BY library, number) AS size,
    count(*) OVER (PARTITION BY library) AS n, row_number() OVER (PARTITION BY library ORDER BY number, place) AS pos FROM listed)),
given(library, pos, slot, free) AS (
  SELECT DISTINCT library, 0::BIGINT, -1::BIGINT, range(n) FROM aims
  UNION ALL
  SELECT library, pos + 1, slot, list_filter(free, lambda x: x <> slot) FROM (
    SELECT g.library, g.pos, g.free, coalesce(list_min(list_filter(g.free, lambda x: x >= a.aim)), list_min(g.free)) AS slot
    FROM given g JOIN aims a ON a.library = g.library AND a.pos = g.pos + 1))"""


@query("W6_best_mix", f"""
WITH RECURSIVE {_CHAIN},
sized AS (SELECT library, component, count(*) AS n, min((key, path, seq)) AS first FROM member GROUP BY library, component),
numbered AS (SELECT library, component, row_number() OVER (PARTITION BY library ORDER BY n DESC, first) - 1 AS number FROM sized),
listed AS (SELECT n.library, c.seq, n.number, c.place FROM chain c JOIN numbered n USING (component)),
{_GIVEN}
SELECT library, seq, slot FROM aims JOIN given USING (library, pos)""")
def w6(spark: SparkSession, folder: str) -> DataFrame:
    return order.best_mix(now(spark, folder, *_MIX)).select("library", "seq", "slot")


@query("W5_variety_chain", f"WITH RECURSIVE {_CHAIN} SELECT component, seq, place::BIGINT AS place FROM chain")
def w5(spark: SparkSession, folder: str) -> DataFrame:
    return order.best_mix(now(spark, folder, *_MIX)).select("component", "seq", "place")


@query("W4_spaced_slots", f"""
WITH RECURSIVE {NOW}, m AS (
  SELECT n.library, g.group_id, n.seq, count(*) OVER (PARTITION BY group_id) AS n, row_number() OVER (PARTITION BY group_id ORDER BY n.seq) AS place
  FROM (SELECT DISTINCT group_id, seq FROM group_members WHERE group_id IS NOT NULL AND seq IS NOT NULL) g JOIN now n USING (seq) WHERE n.library IS NOT NULL),
listed AS (SELECT *, dense_rank() OVER (PARTITION BY library ORDER BY n DESC, group_id) - 1 AS number FROM m),
{_GIVEN.replace("SELECT *, row_number()", "SELECT * EXCLUDE (n), row_number()")}
SELECT library, group_id, seq, slot FROM aims JOIN given USING (library, pos)""")
def w4(spark: SparkSession, folder: str) -> DataFrame:
    """Slots of clusters known by size alone: the duplicate groups of an earlier run, mixed as one list of each library."""
    sizes = table(spark, folder, "group_members").filter("group_id IS NOT NULL AND seq IS NOT NULL").select("group_id", "seq").distinct()
    member = F.row_number().over(Window.partitionBy("group_id").orderBy("seq")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy("group_id"))
    photos = now(spark, folder, "library").filter("library IS NOT NULL")
    libraries = sizes.join(photos, "seq").withColumn("place", member).withColumn("n", n)
    number = F.dense_rank().over(Window.partitionBy("library").orderBy(F.col("n").desc(), "group_id")) - 1
    listed = libraries.withColumn("number", number.cast("long")).withColumn("place", F.col("place").cast("long"))
    keyed = listed.select("library", "group_id", "seq", "number", "place")
    slotted = keyed.groupBy("library").applyInArrow(order._slot, "library string, group_id long, seq long, number long, place long, slot long")
    return slotted.select("library", "group_id", "seq", "slot")


_SLOTTED = f"""
{SIMILAR},
slotted AS (SELECT l.component, n.library, n.seq, row_number() OVER (PARTITION BY library ORDER BY upper(path), path, n.seq) - 1 AS slot
  FROM now n JOIN similar_label l USING (seq) WHERE library IS NOT NULL),
gaps AS (SELECT *, slot - lag(slot) OVER (PARTITION BY library, component ORDER BY slot) AS gap FROM slotted)"""


def _slotted(spark: SparkSession, folder: str) -> DataFrame:
    """Photos in path order, as a plain order whose spacing can be reported."""
    photos = now(spark, folder, *_MIX).filter("library IS NOT NULL")
    placed = with_position(photos, [F.upper("path"), "path", "seq"], "place", by="library")
    return placed.select("library", "seq", (F.col("place") - 1).alias("slot")).join(order.similar_clusters(photos), "seq")


@query("W2_slot_gaps", f"WITH RECURSIVE {_SLOTTED} SELECT library, component, seq, slot, gap FROM gaps")
def w2(spark: SparkSession, folder: str) -> DataFrame:
    return order.slot_gaps(_slotted(spark, folder))


@query("W3_spacing_violations", f"WITH RECURSIVE {_SLOTTED} SELECT seq, gap FROM gaps WHERE gap < 10")
def w3(spark: SparkSession, folder: str) -> DataFrame:
    return order.slot_gaps(_slotted(spark, folder)).filter("gap < 10").select("seq", "gap")


@query("A10_gap_statistics", f"""
WITH RECURSIVE {_SLOTTED} SELECT library, component, count(*) AS n, min(gap) AS min_gap, max(gap) AS max_gap, avg(gap) AS avg_gap
FROM gaps GROUP BY ALL HAVING count(*) >= 2""")
def a10(spark: SparkSession, folder: str) -> DataFrame:
    return order.spacing_report(_slotted(spark, folder)).select("library", "component", "n", "min_gap", "max_gap", "avg_gap")


@query("O6_short_slot_lists", f"""
WITH RECURSIVE {_SLOTTED}, c AS (SELECT library, component, count(*) AS n, list(slot ORDER BY slot) AS s FROM slotted GROUP BY ALL HAVING count(*) >= 2)
SELECT library, component, CASE WHEN n <= 12 THEN array_to_string(s, ', ') ELSE array_to_string(s[1:8], ', ') || ', ..., ' || s[-1] END AS slots FROM c""")
def o6(spark: SparkSession, folder: str) -> DataFrame:
    return order.spacing_report(_slotted(spark, folder)).select("library", "component", "slots")


@query("O5_report_order", f"""
WITH RECURSIVE {_SLOTTED}, c AS (SELECT library, component, count(*) AS n, min(slot) AS first_slot FROM slotted GROUP BY ALL HAVING count(*) >= 2)
SELECT library, component, row_number() OVER (PARTITION BY library ORDER BY n DESC, first_slot) AS number FROM c""")
def o5(spark: SparkSession, folder: str) -> DataFrame:
    found = order.spacing_report(_slotted(spark, folder)).select("library", "component", "n", "first_slot")
    return with_position(found, [-F.col("n"), "first_slot"], "number", by="library").select("library", "component", "number")


@query("J13_slot_by_path", f"""
WITH {NOW}, s AS (SELECT upper(path) AS key, min(seq) AS slot FROM now WHERE path IS NOT NULL GROUP BY 1)
SELECT DISTINCT g.group_id, s.slot FROM dup_groups g JOIN s ON s.key = upper(g.recommended_path)""")
def j13(spark: SparkSession, folder: str) -> DataFrame:
    slots = now(spark, folder, "path").filter("path IS NOT NULL").groupBy(F.upper("path").alias("key")).agg(F.min("seq").alias("slot"))
    wanted = table(spark, folder, "dup_groups").select("group_id", F.upper("recommended_path").alias("key"))
    return wanted.join(slots, "key").select("group_id", "slot").distinct()


@query("O2_path_order", f"WITH {NOW} SELECT seq, row_number() OVER (ORDER BY upper(path) NULLS FIRST, path NULLS FIRST, seq) AS position FROM now")
def o2(spark: SparkSession, folder: str) -> DataFrame:
    photos = now(spark, folder, "path").withColumn("key", F.upper("path"))
    return with_position(photos, ["key", "path", "seq"]).select("seq", "position")


@query("O3_cluster_order", f"""
WITH RECURSIVE {SIMILAR}, c AS (SELECT library, component, count(*) AS n, min((upper(path), path, n.seq)) AS first
  FROM now n JOIN similar_label USING (seq) WHERE library IS NOT NULL GROUP BY ALL)
SELECT library, component, row_number() OVER (PARTITION BY library ORDER BY n DESC, first) AS number FROM c""")
def o3(spark: SparkSession, folder: str) -> DataFrame:
    photos = now(spark, folder, *_MIX).filter("library IS NOT NULL")
    placed = photos.join(order.similar_clusters(photos), "seq")
    sizes = placed.groupBy("library", "component").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.upper("path").alias("k"), "path", "seq")).alias("first"))
    return with_position(sizes, [-F.col("n"), "first"], "number", by="library").select("library", "component", "number")


#: The greatest distance that is listed.
CLOSE_BITS = 22


@query("O4_close_pairs", f"""
WITH {NOW}, p AS (SELECT a.seq AS id_a, b.seq AS id_b, bit_count(xor(a.dhash, b.dhash))::INT AS bits, regexp_extract(a.path, '([^/\\\\]*)$', 1) AS name
  FROM now a JOIN now b ON a.library = b.library AND a.seq < b.seq AND bit_count(xor(a.dhash, b.dhash)) <= {CLOSE_BITS})
SELECT id_a, id_b, bits, row_number() OVER (ORDER BY bits, name NULLS FIRST, id_a, id_b) AS position FROM p""")
def o4(spark: SparkSession, folder: str) -> DataFrame:
    pairs = report.close_pairs(now(spark, folder, "library", "path", "dhash"), CLOSE_BITS)
    return with_position(pairs, ["bits", "name_a", "id_a", "id_b"]).select("id_a", "id_b", "bits", "position")


#: Thresholds of the sweep.
THRESHOLDS = [6, 8, 10, 12, 14, 16, 18, 20, 21, 22]

#: Labels by minimum label propagation, one row a photo and threshold, until none changes.
_SWEEP = f"""
{NOW}, near AS (
  SELECT a.seq AS a, b.seq AS b, bit_count(xor(a.dhash, b.dhash)) AS d
  FROM now a JOIN now b ON a.library = b.library AND a.seq <> b.seq AND bit_count(xor(a.dhash, b.dhash)) <= {max(THRESHOLDS)}),
levels AS (SELECT unnest({THRESHOLDS}) AS t),
label(t, seq, component) USING KEY (t, seq) AS (
  SELECT DISTINCT t, a, a FROM near JOIN levels ON d <= t
  UNION
  SELECT r.t, n.b, min(r.component) FROM label r JOIN near n ON n.a = r.seq AND n.d <= r.t
    JOIN recurring.label old ON old.t = r.t AND old.seq = n.b
  WHERE r.component < old.component GROUP BY r.t, n.b)"""


@query("A13_threshold_sweep", f"WITH RECURSIVE {_SWEEP} SELECT t AS threshold, count(DISTINCT component) AS n_groups, count(*) AS n_photos FROM label GROUP BY t")
def a13(spark: SparkSession, folder: str) -> DataFrame:
    return report.sweep_counts(report.threshold_sweep(now(spark, folder, "library", "dhash"), THRESHOLDS))


@query("U3_new_groups", f"""
WITH RECURSIVE {_SWEEP}, c AS (SELECT t, component, count(*) AS n FROM label GROUP BY ALL), o AS (SELECT t, row_number() OVER (ORDER BY t) AS k FROM levels),
g AS (SELECT k, c.* FROM c JOIN o USING (t))
SELECT l.t AS threshold, l.component, l.seq FROM label l JOIN g ON g.t = l.t AND g.component = l.component
WHERE g.k > 1 AND NOT EXISTS (SELECT 1 FROM g h WHERE h.k = g.k - 1 AND h.component = g.component AND h.n = g.n)""")
def u3(spark: SparkSession, folder: str) -> DataFrame:
    return report.new_groups(report.threshold_sweep(now(spark, folder, "library", "dhash"), THRESHOLDS), THRESHOLDS)


@query("J14_named_pairs", f"""
WITH {NOW}, n AS (SELECT upper(regexp_extract(path, '([^/\\\\]*)$', 1)) AS name, min(seq) AS seq FROM now WHERE path IS NOT NULL GROUP BY 1),
f AS (SELECT n.name, n.seq, now.dhash FROM n JOIN now USING (seq)),
w AS (SELECT group_id, min(upper(regexp_extract(path, '([^/\\\\]*)$', 1))) AS a, max(upper(regexp_extract(path, '([^/\\\\]*)$', 1))) AS b
  FROM group_members WHERE group_id IS NOT NULL AND path IS NOT NULL GROUP BY 1)
SELECT w.group_id, bit_count(xor(x.dhash, y.dhash))::INT AS bits FROM w JOIN f x ON x.name = w.a JOIN f y ON y.name = w.b""")
def j14(spark: SparkSession, folder: str) -> DataFrame:
    from loupe.functions.text import file_name

    name = F.upper(file_name("path"))
    members = table(spark, folder, "group_members").filter("group_id IS NOT NULL AND path IS NOT NULL")
    wanted = members.groupBy("group_id").agg(F.min(name).alias("name_a"), F.max(name).alias("name_b"))
    return report.named_pairs(now(spark, folder, "path", "dhash"), wanted).select("group_id", "bits")


_NAME = "regexp_extract(path, '([^/\\\\]*)$', 1)"


@query("J15_listed_pairs", f"""
WITH {NOW}, l AS (SELECT DISTINCT group_id, upper({_NAME}) AS name FROM group_members WHERE group_id IS NOT NULL AND path IS NOT NULL),
f AS (SELECT upper({_NAME}) AS name, arg_min(struct_pack(h := dhash), seq).h AS dhash FROM now WHERE path IS NOT NULL GROUP BY 1)
SELECT x.group_id, x.name AS name_a, y.name AS name_b, bit_count(xor(a.dhash, b.dhash))::INT AS bits
FROM l x JOIN l y ON x.group_id = y.group_id AND x.name < y.name JOIN f a ON a.name = x.name JOIN f b ON b.name = y.name""")
def j15(spark: SparkSession, folder: str) -> DataFrame:
    """The members of each stored group as a list of names."""
    members = table(spark, folder, "group_members").filter("group_id IS NOT NULL AND path IS NOT NULL")
    names = members.select("group_id", text.file_name("path").alias("name"))
    return report.listed_pairs(now(spark, folder, "path", "dhash"), names, by="group_id")


@query("P15_default_base_name", f"""
WITH {NOW}, f AS (SELECT library, list(DISTINCT regexp_extract(path, '^(.*)[/\\\\][^/\\\\]*$', 1)) AS folders FROM now WHERE library IS NOT NULL AND path IS NOT NULL GROUP BY 1),
n AS (SELECT library, len(folders) AS n, folders[1] AS path, regexp_extract(regexp_replace(folders[1], '[/\\\\]+$', ''), '([^/\\\\]*)$', 1) AS name FROM f)
SELECT library, CASE WHEN n = 1 AND trim(name) <> '' THEN name || ' Slideshow' ELSE 'My Slideshow' END AS name FROM n""")
def p15(spark: SparkSession, folder: str) -> DataFrame:
    paths = now(spark, folder, "library", "path").filter("library IS NOT NULL AND path IS NOT NULL")
    folders = paths.groupBy("library").agg(F.collect_set(text.folder("path")).alias("folders"))
    return folders.select("library", text.default_base_name("folders").alias("name"))


@query("P16_available_names", f"""
WITH {NOW}, e AS (SELECT DISTINCT upper(regexp_extract(path, '^(.*)[/\\\\][^/\\\\]*$', 1)) AS folder, upper(regexp_replace({_NAME}, '\\.[^.]*$', '')) AS name FROM now WHERE path IS NOT NULL),
w AS (SELECT row_number() OVER () AS r, group_id, regexp_extract(path, '^(.*)[/\\\\][^/\\\\]*$', 1) AS folder, regexp_replace({_NAME}, '\\.[^.]*$', '') AS base
  FROM (SELECT group_id, recommended_path AS path FROM dup_groups WHERE recommended_path IS NOT NULL)),
n AS (SELECT r, folder, k, base || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END AS name FROM w, range(1, 1000) AS t(k)),
f AS (SELECT r, arg_min(name, k) AS name FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.folder = upper(n.folder) AND e.name = upper(n.name)) GROUP BY r)
SELECT group_id, coalesce(name, base) AS name FROM w LEFT JOIN f USING (r)""")
def p16(spark: SparkSession, folder: str) -> DataFrame:
    """Names for new files beside the photos recommended."""
    there = now(spark, folder, "path").filter("path IS NOT NULL").select(text.folder("path").alias("folder"), text.stem("path").alias("name"))
    wanted = table(spark, folder, "dup_groups").filter("recommended_path IS NOT NULL")
    wanted = wanted.select("group_id", text.folder("recommended_path").alias("folder"), text.stem("recommended_path").alias("base"))
    return report.available_names(wanted, there).select("group_id", "name")


@query("U5_nothing_lost", f"""
WITH {NOW} SELECT library, count(*) AS n, count(*) AS slots, 0::BIGINT AS first, count(*) - 1 AS last, sum(seq)::BIGINT AS seqs
FROM now WHERE library IS NOT NULL GROUP BY library""")
def u5(spark: SparkSession, folder: str) -> DataFrame:
    """Of each library's order: photos, different slots, first and last slot, sum of the photos' seq; nothing lost, nothing added."""
    mixed, _ = Scratch(spark, "order").cut(w6(spark, folder), "mixed")
    slots = mixed.select("library", "slot").distinct().groupBy("library").agg(F.count(F.lit(1)).alias("slots"))
    found = mixed.groupBy("library").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.sum("seq").alias("seqs"))
    return found.join(slots, "library").select("library", "n", "slots", "first", "last", "seqs")
