"""Current version of records that are delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.functions.keys import _c


def current_photos(photos: DataFrame, *values, key: str = "seq", version: str = "loaded_at") -> DataFrame:
    """One row per ``key``: the values of its row with the greatest ``version``.

    values: column names, or columns with an alias; they are computed before the
    shuffle, so only what is asked for travels.  Rows with a null key are left
    out; a null version counts as the oldest.  Rows equal in key and version are
    taken to be identical; where they are not, the greatest values win, in the
    order given.  A key with very many rows is reduced before the shuffle.
    """
    columns = [_c(v) for v in values]
    return (
        photos.filter(F.col(key).isNotNull())
        .select(F.col(key), F.struct(F.col(version).alias("__version"), *columns).alias("__row"))
        .groupBy(key)
        .agg(F.max("__row").alias("__row"))
        .select(key, "__row.*")
        .drop("__version")
    )
