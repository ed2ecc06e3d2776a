"""Queries on progress, rates and rolling windows; events stand for the workers' reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loupe.operators import progress
from loupe.plans.registry import query
from loupe.sources.tables import table

_LINES = """
lines AS (
  SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'out_time_us=' || (event_id * 1000) WHEN 'click' THEN ' frame = ' || event_id
    WHEN 'purchase' THEN 'fps=' || value WHEN 'signup' THEN 'progress=end' ELSE 'frame=none' END AS line FROM events),
parsed AS (
  SELECT event_id, user_id, CASE WHEN line LIKE 'out_time_us=%' THEN TRY_CAST(substr(line, 13) AS BIGINT) / 1000000 END AS out_seconds,
    CASE WHEN line LIKE ' frame = %' THEN TRY_CAST(substr(line, 10) AS INT) END AS frame,
    CASE WHEN line LIKE 'fps=%' THEN TRY_CAST(substr(line, 5) AS DOUBLE) END AS fps, line = 'progress=end' AS finished FROM lines)"""


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    line = (
        F.when(kind == "view", F.concat(F.lit("out_time_us="), F.col("event_id") * 1000))
        .when(kind == "click", F.concat(F.lit(" frame = "), "event_id"))
        .when(kind == "purchase", F.concat(F.lit("fps="), "value"))
        .when(kind == "signup", F.lit("progress=end"))
        .otherwise(F.lit("frame=none"))
    )
    return table(spark, folder, "events").select("event_id", "user_id", line.alias("line"))


@query("T1_parsed_lines", f"WITH {_LINES} SELECT event_id, out_seconds, frame, fps, CASE WHEN finished THEN true END AS finished FROM parsed WHERE out_seconds IS NOT NULL OR frame IS NOT NULL OR fps IS NOT NULL OR finished")
def t1(spark: SparkSession, folder: str) -> DataFrame:
    p = _lines(spark, folder).withColumn("p", progress.parse_line("line")).filter("p IS NOT NULL")
    return p.select("event_id", "p.out_seconds", "p.frame", "p.fps", "p.finished")


@query("T3_latest_per_worker", f"""
WITH {_LINES} SELECT user_id, arg_max(out_seconds, event_id) FILTER (out_seconds IS NOT NULL) AS out_seconds,
  arg_max(frame, event_id) FILTER (frame IS NOT NULL) AS frame, arg_max(fps, event_id) FILTER (fps IS NOT NULL) AS fps, bool_or(finished) AS finished
FROM parsed GROUP BY user_id HAVING count(out_seconds) + count(frame) + count(fps) + count_if(finished) > 0""")
def t3(spark: SparkSession, folder: str) -> DataFrame:
    return progress.latest(_lines(spark, folder), "user_id", "event_id")


@query("A15_overall_progress", f"""
WITH {_LINES}, l AS (SELECT user_id, coalesce(arg_max(out_seconds, event_id) FILTER (out_seconds IS NOT NULL), 0) AS s
  FROM parsed GROUP BY user_id HAVING count(out_seconds) + count(frame) + count(fps) + count_if(finished) > 0),
f AS (SELECT least(1, s / 10) AS f, least(12, floor(s / 4) + 1) AS d FROM l)
SELECT round(least(0.94, 0.20 + 0.74 / count(*) * sum(f)), 9)::DOUBLE AS fraction, sum(d)::BIGINT AS done, count_if(f >= 1)::BIGINT AS chunks_complete FROM f""")
def a15(spark: SparkSession, folder: str) -> DataFrame:
    state = t3(spark, folder).withColumn("s", F.coalesce("out_seconds", F.lit(0.0)))
    each = state.select(progress.chunk_fraction("s", F.lit(10.0)).alias("f"), progress.chunk_done("s", F.lit(4.0), F.lit(12)).alias("d"))
    total = each.agg(F.sum("f").alias("f"), F.count(F.lit(1)).alias("n"), F.sum("d").alias("done"), F.count_if(F.col("f") >= 1).alias("chunks_complete"))
    return total.select(F.round(progress.overall_fraction("f", "n"), 9).alias("fraction"), "done", "chunks_complete")


@query("W17_chunk_progress", f"""
WITH {_LINES} SELECT event_id, least(1, out_seconds / 45) AS fraction, least(12, floor(out_seconds / 4) + 1)::BIGINT AS done FROM parsed WHERE out_seconds IS NOT NULL""")
def w17(spark: SparkSession, folder: str) -> DataFrame:
    p = t1(spark, folder).filter("out_seconds IS NOT NULL")
    return p.select("event_id", progress.chunk_fraction("out_seconds", F.lit(45.0)).alias("fraction"), progress.chunk_done("out_seconds", F.lit(4.0), F.lit(12)).alias("done"))


_SAMPLES = """
samples AS (SELECT event_type, event_id, epoch_us(ts) / 1000000 AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS done FROM events)"""


@query("W12_rate_and_eta", f"""
WITH {_SAMPLES}, w AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS total,
  min({{'d': done, 's': t}}) OVER (PARTITION BY event_type ORDER BY done RANGE BETWEEN 75 PRECEDING AND CURRENT ROW) AS b FROM samples)
SELECT event_id, CASE WHEN done >= ceil(total * 0.05) AND done // 12 >= 2 AND done - b.d > 0 AND t - b.s > 0.1
  THEN (ceil(greatest(0, total - done) / ((done - b.d) / (t - b.s)) / 30) * 30)::BIGINT END AS eta_seconds FROM w""")
def w12(spark: SparkSession, folder: str) -> DataFrame:
    """Each kind of event as a run of its own, that ends with its last event."""
    from loupe.functions.keys import micros

    done = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    events = table(spark, folder, "events")
    totals = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("total"))
    samples = events.select("event_type", "event_id", (micros("ts") / 1_000_000).alias("t"), done.alias("done"))
    samples = samples.join(totals, "event_type").withColumn("chunks_complete", F.floor(F.col("done") / 12))
    return progress.with_eta(samples, F.col("total"), by="event_type").select("event_id", "eta_seconds")


@query("W14_rolling_last", """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY k DESC)::INT AS place FROM k WHERE k <= 5""")
def w14(spark: SparkSession, folder: str) -> DataFrame:
    return progress.rolling_last(table(spark, folder, "events"), "user_id", ["ts", "event_id"], 5).select("user_id", "event_id", "place")


@query("W14_rolling_evicted", "SELECT event_id, lag(event_id, 5) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS evicted FROM events")
def w14b(spark: SparkSession, folder: str) -> DataFrame:
    return progress.rolling_evicted(table(spark, folder, "events"), "user_id", ["ts", "event_id"], "event_id", 5).select("event_id", "evicted")


@query("W15_throttled_reports", """
WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events)
SELECT user_id, event_id FROM n WHERE n % 25 = 0 OR n = c""")
def w15(spark: SparkSession, folder: str) -> DataFrame:
    """Every 25th report of a worker and its last, as the feature is."""
    numbered = table(spark, folder, "events").withColumn("number", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return progress.throttled(numbered, "number", 25, "user_id").select("user_id", "event_id")


@query("A16_phase_totals", "SELECT event_type, sum(k)::BIGINT AS total, (sum(k) // greatest(1, count(*)))::BIGINT AS each FROM (SELECT event_type, TRY_CAST(trim(split_part(split_part(props, ':', 2), '}', 1)) AS BIGINT) AS k FROM events) GROUP BY 1")
def a16(spark: SparkSession, folder: str) -> DataFrame:
    value = F.trim(F.split_part(F.split_part("props", F.lit(":"), F.lit(2)), F.lit("}"), F.lit(1))).try_cast("long")
    found = table(spark, folder, "events").groupBy("event_type").agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    return found.selectExpr("event_type", "total", "total div greatest(1, n) AS each")


@query("A17_total_of_phases", "SELECT count(*) AS n, sum(c)::BIGINT AS total FROM (SELECT event_type, count(*) AS c FROM events GROUP BY 1)")
def a17(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("total"))


@query("W1_user_sessions", """
WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM f)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM n GROUP BY user_id, n.n""")
def w1_users(spark: SparkSession, folder: str) -> DataFrame:
    from loupe.functions.keys import micros
    from loupe.operators.sessions import local_sessions

    rows = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("key"), micros("ts").alias("t"), F.col("event_id").alias("id"))
    return local_sessions(rows).select(F.col("key").cast("long").alias("user_id"), "start_us", "end_us", "n")
