"""Chains of intervals: what is taken one after another from overlapping candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import checkpointed
from .asof import asof_join


def follow(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The rows of ``rows`` that a walk takes: the first of each key, then always the first that starts at or after the end of the one before.

    ``start`` is unique within ``key``; ``end`` is after ``start``. Each row's successor is an as-of lookup. Only what is some row's successor, or a key's
    first, can be on a walk, so the jumps are kept between these. Then jumps are doubled: after k rounds the first 2^k rows of every walk are known and
    jumps are 2^k long, so the rounds are the logarithm of the longest walk, each two joins on the key and the start, and no key's rows are ever gathered.
    """
    # read several times from here on
    rows = checkpointed(rows)
    starts = rows.select(key, F.col(start).alias("_at"), F.col(start).alias("_next"))
    jumps = asof_join(rows.select(key, F.col(start).alias("_from"), F.col(end).alias("_at")), starts, [key], ["_next"], on="_at", direction="forward").filter("_next is not null").select(key, "_from", "_next")
    jumps = checkpointed(jumps)
    walk = rows.groupBy(key).agg(F.min(start).alias("_at"))
    on_walks = walk.unionByName(jumps.select(key, F.col("_next").alias("_at"))).distinct()
    jumps = jumps.join(on_walks.withColumnRenamed("_at", "_from"), [key, "_from"], "left_semi")
    while True:
        jumps = checkpointed(jumps)
        if jumps.isEmpty():
            break
        further = walk.join(jumps.withColumnRenamed("_from", "_at"), [key, "_at"]).select(key, F.col("_next").alias("_at"))
        walk = checkpointed(walk.unionByName(further))
        second = jumps.select(F.col(key), F.col("_from").alias("_next"), F.col("_next").alias("_to"))
        jumps = jumps.join(second, [key, "_next"]).select(key, "_from", F.col("_to").alias("_next"))
    return rows.join(walk.withColumnRenamed("_at", start), [key, start], "left_semi")
