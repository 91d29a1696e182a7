"""Joins and set operations of the research tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quotes import normal_ticker
from .calendar import grid_of


def filter_to_members(panel: DataFrame, universe: DataFrame, date: str = "date", overrides: dict[str, str] | None = None) -> DataFrame:
    """Rows of names that were members on the day."""
    members = universe.select(F.col("date").alias(date), normal_ticker("symbol", overrides).alias("symbol")).distinct()
    return panel.join(members, [date, "symbol"], "left_semi")


def drop_flagged(panel: DataFrame, flagged: DataFrame, keys: list[str], overrides: DataFrame | None = None) -> DataFrame:
    """Rows without a flag; ``overrides`` take flags back."""
    rows = flagged.select(*keys).distinct()
    if overrides is not None:
        rows = rows.join(overrides.select(*keys).distinct(), keys, "left_anti")
    return panel.join(rows, keys, "left_anti")


def mark_stale(wide: DataFrame, days: DataFrame, keys: list[str], columns: list[str] | dict[str, list[str]]) -> DataFrame:
    """``wide`` on the days in ``days (date, previous)`` with ``stale``: all ``columns`` as on the day before.

    A contract without a quote on the day before is not stale. ``columns`` may name several flags, each with its own columns: all come from one lookup.
    """
    flags = columns if isinstance(columns, dict) else {"stale": columns}
    compared = list(dict.fromkeys(c for own in flags.values() for c in own))
    before = wide.select(F.col("date").alias("_p"), *keys, *(F.col(c).alias(f"_{c}") for c in compared))
    rows = wide.join(days.select("date", F.col("previous").alias("_p")), "date").join(before, ["_p", *keys], "left")
    same = {to: F.coalesce(reduce(Column.__and__, [F.col(c) == F.col(f"_{c}") for c in own]), F.lit(False)) for to, own in flags.items()}
    return rows.withColumns(same).drop("_p", *(f"_{c}" for c in compared))


def lag_key(values: DataFrame, sessions: DataFrame, date: str = "date") -> DataFrame:
    """``values`` moved to the next session, so that what was known at the close before is used today."""
    after = sessions.select("date", F.lead("date").over(Window.orderBy("date")).alias("_next"))
    return values.join(after, date).filter("_next is not null").drop(date).withColumnRenamed("_next", date)


def pair_entries(formation: DataFrame, quotes: DataFrame, keys: list[str] = ("symbol", "entry_day", "expiration", "strike")) -> DataFrame:
    """The quotes on the entry day of the very contracts picked on the formation day."""
    return formation.join(quotes, list(keys))


def outer_by_date(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join with one key column."""
    return a.join(b, on, "full")


def grid(dates: DataFrame, names: DataFrame) -> DataFrame:
    """Every date with every name; the dates are a calendar, whose length is checked."""
    return grid_of(dates, names.distinct())


def holding_paths(contracts: DataFrame, quotes: DataFrame, start: str = "entry_day", end: str = "expiration") -> DataFrame:
    """Quotes of each held contract from entry to expiry, both included."""
    keys = ["symbol", "expiration", "strike"]
    held = contracts.select(*keys, "month", start)
    return quotes.join(held, keys).filter(F.col("date").between(F.col(start), F.col(end)))


def patch_rows(table: DataFrame, patch: DataFrame, keys: list[str], columns: list[str], derived: list[str] = ()) -> DataFrame:
    """``table`` with ``columns`` from ``patch`` where it has the key, and ``derived`` nulled there."""
    marks = patch.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_hit"))
    rows = table.join(marks, keys, "left")
    hit = F.col("_hit").isNotNull()
    kinds = dict(table.dtypes)
    out = []
    for c in table.columns:
        if c in columns:
            out.append(F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c))
        elif c in derived:
            out.append(F.when(hit, F.lit(None).cast(kinds[c])).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return rows.select(*out)


def map_names(rows: DataFrame, names: DataFrame, on: str, to: str) -> tuple[DataFrame, DataFrame]:
    """Rows with ``to`` from ``names (on, to)``, and the keys that have none."""
    joined = rows.join(names.select(on, to), on, "left")
    return joined.filter(F.col(to).isNotNull()), joined.filter(F.col(to).isNull()).select(on).distinct()


def merge_features(panel: DataFrame, *features: tuple[DataFrame, list[str]]) -> DataFrame:
    """``panel`` left-joined with each (features, keys); a feature key that repeats keeps its greatest row."""
    for frame, keys in features:
        values = [c for c in frame.columns if c not in keys]
        one = frame.groupBy(*keys).agg(F.max(F.struct(*values)).alias("_v")).select(*keys, "_v.*")
        panel = panel.join(one, keys, "left")
    return panel


def union_all(*frames: DataFrame, missing: bool = True) -> DataFrame:
    """Rows of all frames by column name; with ``missing``, columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), frames)


def pivot_sides(chain: DataFrame, keys: list[str], values: list[str], right: str = "right") -> DataFrame:
    """Calls and puts side by side: ``call_x`` and ``put_x`` of each value. One pass, no extra scan for the values."""
    aggs = [F.max(F.when(F.col(right) == letter, F.col(v))).alias(f"{side}_{v}") for side, letter in (("call", "C"), ("put", "P")) for v in values]
    return chain.groupBy(*keys).agg(*aggs)


def pivot_wide(rows: DataFrame, key: str, names: list[str], name: str, value: str) -> DataFrame:
    """One column for each of ``names``, known beforehand."""
    return rows.groupBy(key).pivot(name, names).agg(F.first(value))
