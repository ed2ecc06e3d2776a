"""Queries on sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loupe.operators.sessions import shooting_sessions
from loupe.plans.registry import query
from loupe.sources.tables import table

P3_SQL = """
WITH now AS (
  SELECT seq, any_value(lower(trim(device))) AS device, any_value(capture_time) AS t
  FROM (SELECT DISTINCT * FROM photos
        QUALIFY rank() OVER (PARTITION BY seq ORDER BY loaded_at DESC NULLS LAST) = 1)
  GROUP BY seq
),
flagged AS (
  SELECT *, CASE WHEN t - lag(t) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS starts
  FROM now WHERE device IS NOT NULL AND t IS NOT NULL
  WINDOW w AS (PARTITION BY device ORDER BY t, seq)
),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY device ORDER BY t, seq) AS number FROM flagged)
SELECT device, arg_min(seq, (t, seq)) AS first_seq, arg_max(seq, (t, seq)) AS last_seq
FROM numbered GROUP BY device, number
"""


@query("p3_found", P3_SQL)
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return shooting_sessions(table(spark, folder, "photos")).select("device", "first_seq", "last_seq")


@query("p3_sessions", P3_SQL.replace(
    "SELECT device, arg_min(seq, (t, seq)) AS first_seq, arg_max(seq, (t, seq)) AS last_seq",
    "SELECT device, epoch_us(min(t)) AS start_us, epoch_us(max(t)) AS end_us, count(*) AS n,"
    " (epoch_us(max(t)) - epoch_us(min(t))) / 1e6 AS seconds",
))
def p3_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return shooting_sessions(table(spark, folder, "photos")).selectExpr(
        "device", "start_us", "end_us", "n", "(end_us - start_us) / 1e6D AS seconds"
    )
