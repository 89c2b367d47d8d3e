"""Upsert and delete as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_wins(rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The row with the greatest ``order`` of each key; partitions give out one row a key."""
    latest = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key; within ``new`` the last wins."""
    new = last_wins(new, key, order)
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete(rows: DataFrame, ids: DataFrame | None = None, where: Column | None = None, key: str = "id") -> DataFrame:
    """The rows whose key isn't in ``ids`` and for which ``where`` doesn't hold; neither given: all."""
    if ids is not None:
        rows = rows.join(ids.select(key), key, "left_anti")
    if where is not None:
        rows = rows.where(~F.coalesce(where, F.lit(False)))
    return rows
