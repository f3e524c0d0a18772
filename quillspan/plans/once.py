"""Repeated rows, without moving the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.plans.spool import counted

#: Repeated keys that are sent to all executors at most.
SENT = 1_000_000


def once(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key by `order`; rows without a key are left out.

    Only the keys are counted over all rows; rows of keys that come once, nearly all, go through untouched, and only the
    repeated ones are shuffled, unless there are too many of them to be sent to all executors.
    """
    keyed = rows.where(F.col(key).isNotNull())
    again, number = counted(keyed.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key))
    first = lambda df: df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
    if not number:
        return keyed
    if number > SENT:
        return first(keyed)
    return keyed.join(F.broadcast(again), key, "left_anti").unionByName(first(keyed.join(F.broadcast(again), key, "left_semi")))
