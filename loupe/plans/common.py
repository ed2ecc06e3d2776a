"""What many queries begin with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.functions.keys import sha_key, usable_hash
from loupe.operators.current import current_photos
from loupe.sources.tables import table


def now(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Current photos with a usable dhash or null, and ``sha`` in upper case or null."""
    wanted = columns or ("library", "device", "path", "file_size", "format", "width", "height", "capture_time", "dhash", "sha")
    made = {"dhash": usable_hash("dhash").alias("dhash"), "sha": F.hex(sha_key("sha256")).alias("sha")}
    return current_photos(table(spark, folder, "photos"), *(made.get(c, c) for c in wanted))


#: The same in SQL.
NOW = """
now AS (
  SELECT seq, any_value(library) AS library, any_value(device) AS device, any_value(path) AS path,
         any_value(file_size) AS file_size, any_value(format) AS format, any_value(width) AS width,
         any_value(height) AS height, any_value(capture_time) AS capture_time,
         any_value(CASE WHEN dhash <> 0 THEN dhash END) AS dhash,
         any_value(CASE WHEN regexp_full_match(trim(sha256), '[0-9A-Fa-f]{64}') THEN upper(trim(sha256)) END) AS sha
  FROM (SELECT DISTINCT * FROM photos
        QUALIFY rank() OVER (PARTITION BY seq ORDER BY loaded_at DESC NULLS LAST) = 1)
  GROUP BY seq
)"""

#: The photo to keep, as an ORDER BY list.
KEEP = """
  (CASE WHEN width > 0 AND height > 0 THEN width::BIGINT * height ELSE 0 END) DESC,
  file_size DESC NULLS LAST, capture_time ASC NULLS LAST, length(path), upper(path), seq"""
