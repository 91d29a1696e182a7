"""Corporate actions: long tables, joins onto prices, and back-adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_join


def action_table(quotes: DataFrame, split: str = "split", dividend: str = "dividend", given: dict[str, Column] | None = None) -> DataFrame:
    """``symbol, date, action, value``: the splits and dividends that daily ``quotes`` carry in two columns, as rows.

    A row has an action where its column is neither zero nor null; where rows say so themselves, ``given`` has the condition for
    ``split`` and ``dividend``, and any value counts.
    """
    out = None
    for name, column in (("split", split), ("dividend", dividend)):
        has = given[name] if given is not None else (F.col(column) != 0) & F.col(column).isNotNull()
        part = quotes.filter(has).select("symbol", "date", F.lit(name).alias("action"), F.col(column).cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def with_corporate_actions(prices: DataFrame, actions: DataFrame) -> DataFrame:
    """``prices`` with ``split_ratio`` (1 where there is none) and ``dividend`` (the day's sum, 0 where there is none)."""
    per_day = actions.groupBy("symbol", "date").agg(
        F.max(F.when(F.col("action") == "split", F.col("value"))).alias("split_ratio"),
        F.sum(F.when(F.col("action") == "dividend", F.col("value"))).alias("dividend"),
    )
    out = prices.join(per_day, ["symbol", "date"], "left")
    return out.withColumns({"split_ratio": F.coalesce("split_ratio", F.lit(1.0)), "dividend": F.coalesce("dividend", F.lit(0.0))})


def split_factors(dates: DataFrame, splits: DataFrame) -> DataFrame:
    """``dates (symbol, date)`` with ``factor``: the product of the ratios of all later splits.

    Logarithms summed from the last split back, then one as-of lookup: the range join would repeat each
    date once for every split.
    """
    later = Window.partitionBy("symbol").orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    running = splits.withColumn("_log", F.sum(F.ln("value")).over(later)).select("symbol", "date", "_log")
    out = asof_join(dates, running, ["symbol"], ["_log"], direction="forward", exact=False)
    return out.withColumn("factor", F.coalesce(F.exp("_log"), F.lit(1.0))).drop("_log")
