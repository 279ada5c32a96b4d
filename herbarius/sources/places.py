"""Tables of places by Z-order key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.zorder import z_key


def save_places(df: DataFrame, path: str, x: str, y: str, key: str = "z", group_bytes: int | None = None) -> None:
    """Write ``df`` with a column of keys, sorted by it over all files, so that row groups are of places near each other.

    Rows are dealt by sampled ranges of keys; crowded places, whose rows have one key, are dealt by the
    coordinates further.  Rows without coordinates have a null key and are kept.
    """
    rows = df.withColumn(key, z_key(x, y))
    order = [F.col(key).asc_nulls_last(), F.col(x), F.col(y)]
    out = rows.repartitionByRange(*order).sortWithinPartitions(*order).write
    (out.option("parquet.block.size", group_bytes) if group_bytes else out).parquet(path)
