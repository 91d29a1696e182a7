"""As-of joins: the nearest earlier or later row of the same key, by union and a window, in one level or two."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Days of a bucket in lookups by name, so that a name with very many rows is spread over tasks.
SPAN = 32


def asof_join(left: DataFrame, right: DataFrame, by: list[str], values: list[str], on: str = "date", direction: str = "backward", exact: bool = True, ties: list[str] | None = None, span: int | None = None) -> DataFrame:
    """All rows of ``left`` with ``values`` of the last row of ``right`` at or before ``on`` (``forward``: the first at or after).

    Both sides share ``by`` and ``on``. With ``exact=False`` an equal ``on`` does not match. Of several right
    rows with one key and ``on``, the greatest by ``ties`` (default: by ``values``) counts. One shuffle on
    ``by``, no row blow-up; left rows without a match get nulls.

    With ``span`` a key's rows are dealt to buckets of so many days (units, if ``on`` is a number), each a window of its own, so a key with very many rows is not one
    task's. What a bucket does not find comes from a summary: the last value of each bucket, carried over the buckets of the key, of which there are as many
    as the time has spans.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction {direction!r}")
    payload = F.struct(*values)
    order = F.struct(*(ties or values))
    rows = right.groupBy(*by, on).agg(F.max_by(payload, order).alias("_value"))
    kept = [c for c in left.columns if c not in by and c != on]
    a = left.select(*by, on, F.struct(*kept).alias("_left") if kept else F.struct(F.lit(1).alias("_")).alias("_left"), F.lit(None).cast(rows.schema["_value"].dataType).alias("_value"))
    b = rows.select(*by, on, F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), "_value")
    # where times are equal, right rows come first if they may match
    is_left = F.when(F.col("_left").isNotNull(), 1 if exact else 0).otherwise(0 if exact else 1)
    both = a.unionByName(b).withColumn("_side", is_left)
    backward = direction == "backward"
    time = F.col(on).asc() if backward else F.col(on).desc()
    keys = list(by)
    if span:
        day = F.unix_date(on) if dict(rows.dtypes)[on] == "date" else F.col(on)
        bucket = F.floor(day / span).cast("long")
        both = both.withColumn("_bucket", bucket)
        keys.append("_bucket")
    seen = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_value", ignorenulls=True).over(seen)).filter("_left is not null")
    value = F.col("_found")
    if span:
        pick = F.max_by if backward else F.min_by
        ends = rows.filter(F.col(on).isNotNull()).groupBy(*by, bucket.alias("_bucket")).agg(pick("_value", on).alias("_end"))
        asked = a.select(*by, bucket.alias("_bucket")).distinct()
        before = Window.partitionBy(*by).orderBy(F.col("_bucket").asc() if backward else F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
        carried = asked.join(ends, keys, "full").withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).filter("_carried is not null").select(*keys, "_carried")
        found = found.join(carried, keys, "left")
        value = F.coalesce("_found", "_carried")
    found = found.withColumn("_found", value)
    return found.select(*(F.col(c) if c in by or c == on else F.col(f"_left.{c}").alias(c) for c in left.columns), *(F.col(f"_found.{c}").alias(c) for c in values))


def event_distance(panel: DataFrame, events: DataFrame) -> DataFrame:
    """``panel (date, symbol)`` with ``days_to_event`` and ``days_since_event``; an event on the day is 0 for both."""
    days = events.select("symbol", "date", F.col("date").alias("event")).distinct()
    out = asof_join(panel, days.withColumnRenamed("event", "_next"), ["symbol"], ["_next"], direction="forward", span=SPAN)
    out = asof_join(out, days.withColumnRenamed("event", "_last"), ["symbol"], ["_last"], direction="backward", span=SPAN)
    return out.withColumns({"days_to_event": F.datediff("_next", "date"), "days_since_event": F.datediff("date", "_last")}).drop("_next", "_last")


def next_event(panel: DataFrame, events: DataFrame, session: str = "event_session") -> DataFrame:
    """``panel (date, symbol)`` with ``next_event``, the first event session on or after the date, and ``days_to_event``."""
    days = events.select("symbol", F.col(session).alias("date"), F.col(session).alias("next_event")).distinct()
    return asof_join(panel, days, ["symbol"], ["next_event"], direction="forward", span=SPAN).withColumn("days_to_event", F.datediff("next_event", "date"))


def next_on_buckets(panel: DataFrame, events: DataFrame) -> DataFrame:
    """``panel (date, symbol, ...)`` with ``next_event``, for tables that lie in buckets of the symbol, as ``write_buckets`` makes them: nothing is shuffled.

    A union would give up the buckets, so a name's events, a few a year, come as one sorted array, joined on the symbol.
    """
    lists = events.groupBy("symbol").agg(F.sort_array(F.collect_set("date")).alias("_events"))
    after = F.filter("_events", lambda e: e >= F.col("date"))
    return panel.join(lists, "symbol", "left").withColumn("next_event", F.try_element_at(after, F.lit(1))).drop("_events")


def count_events(pillars: DataFrame, events: DataFrame, session: str = "event_session") -> DataFrame:
    """``pillars (date, symbol, expiration)`` with ``n_events``: event rows in (date, expiration].

    The difference of two running counts, each an as-of lookup, so a symbol with many events costs no more rows.
    """
    per_day = events.filter(F.col(session).isNotNull()).groupBy("symbol", F.col(session).alias("date")).agg(F.count("*").alias("n"))
    running = per_day.select("symbol", "date", F.sum("n").over(Window.partitionBy("symbol").orderBy("date")).alias("upto"))
    out = asof_join(pillars, running.withColumnRenamed("upto", "_a"), ["symbol"], ["_a"], span=SPAN)
    ends = running.select("symbol", F.col("date").alias("expiration"), F.col("upto").alias("_b"))
    out = asof_join(out, ends, ["symbol"], ["_b"], on="expiration", span=SPAN)
    return out.withColumn("n_events", F.coalesce("_b", F.lit(0)) - F.coalesce("_a", F.lit(0))).drop("_a", "_b")


def flag_events(panel: DataFrame, events: DataFrame, start: str = "entry_day", end: str = "expiration", to: str = "earnings_in_hold") -> DataFrame:
    """``panel`` with whether an event of the symbol falls in [start, end]; false without events."""
    days = events.select("symbol", F.col("date").alias(start), F.col("date").alias("_first")).distinct()
    out = asof_join(panel, days, ["symbol"], ["_first"], on=start, direction="forward", span=SPAN)
    return out.withColumn(to, F.coalesce(F.col("_first") <= F.col(end), F.lit(False))).drop("_first")
