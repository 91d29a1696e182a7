"""Incremental refresh of a stored table: newly landed files are read once and their years replaced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.store import MissingDataset, replace_years, require


def refresh(spark: SparkSession, landing: str, schema: StructType, table: str, checkpoint: str, keys: list[str], transform: Callable[[DataFrame], DataFrame] | None = None, date: str = "date") -> int:
    """Runs all files in ``landing`` that were not read before into ``table``, partitioned by year; returns the batches run.

    Rows of a year that new files touch are merged with the stored ones: of equal ``keys`` the new row stays.
    A batch that is run again after a failure writes the same years again.
    """

    def merge(batch: DataFrame, _: int) -> None:
        fresh = (transform(batch) if transform else batch).withColumn("year", F.year(date)).withColumn("_new", F.lit(1))
        rows = fresh
        try:
            old = require(spark, table, "refresh").join(fresh.select("year").distinct(), "year", "left_semi").withColumn("_new", F.lit(0))
            rows = fresh.unionByName(old)
        except MissingDataset:
            pass
        values = [c for c in rows.columns if c not in keys]
        kept = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct("_new", *[c for c in values if c != "_new"])).alias("_v"))
        # old files go only when the new ones are committed, so the years that are read can be replaced
        replace_years(kept.select(*keys, "_v.*").drop("_new"), table)

    stream = spark.readStream.schema(schema).parquet(landing)
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(1 for p in query.recentProgress if p["numInputRows"])
