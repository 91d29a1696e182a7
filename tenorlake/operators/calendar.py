"""Trading calendars as small tables: session indexes, schedules, event windows, membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_join


def session_index(dates: DataFrame) -> DataFrame:
    """``date, session_index`` from 0 for the distinct dates. A calendar is a few thousand rows, so one ordered window is fine."""
    days = dates.select("date").filter("date is not null").distinct()
    return days.withColumn("session_index", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))


#: Calendar days that may be paired with names: some 270 years.
MOST_DAYS = 100_000


def grid_of(days: DataFrame, names: DataFrame) -> DataFrame:
    """Every day with every name. The days are a calendar, counted to be one and broadcast; names stay spread over all tasks."""
    days = days.distinct()
    if days.count() > MOST_DAYS:
        raise ValueError(f"a calendar has at most {MOST_DAYS} days")
    return names.crossJoin(F.broadcast(days))


def shift_sessions(df: DataFrame, sessions: DataFrame, n: int, date: str = "date", to: str = "shifted", clamp: bool = False) -> DataFrame:
    """Adds ``to``: the session ``n`` after (before, if negative) the session ``date``; null outside, unless clamped to the ends."""
    here = sessions.select(F.col("date").alias(date), F.col("session_index").alias("_i"))
    place = F.col("_i") + n
    if clamp:
        ends = sessions.agg(F.max("session_index").alias("_last"))
        here = here.crossJoin(F.broadcast(ends))
        place = F.greatest(F.lit(0), F.least(place, F.col("_last")))
    moved = here.withColumn("_i", place).join(sessions.select(F.col("date").alias(to), F.col("session_index").alias("_i")), "_i", "left").select(date, to)
    return df.join(moved, date, "left")


def sessions_between(df: DataFrame, sessions: DataFrame, start: str, end: str, to: str = "n_sessions") -> DataFrame:
    """Adds the number of sessions from ``start`` to ``end``, both sessions, the first not counted."""
    a = sessions.select(F.col("date").alias(start), F.col("session_index").alias("_a"))
    b = sessions.select(F.col("date").alias(end), F.col("session_index").alias("_b"))
    return df.join(a, start, "left").join(b, end, "left").withColumn(to, F.col("_b") - F.col("_a")).drop("_a", "_b")


def period_starts(sessions: DataFrame, period: str = "month") -> DataFrame:
    """The first session of each month or ISO week; the first session of all is one."""
    previous = F.lag("date").over(Window.orderBy("date"))
    return sessions.withColumn("_p", previous).filter(F.coalesce(F.date_trunc(period, "_p") != F.date_trunc(period, "date"), F.lit(True))).drop("_p")


def third_friday(month: Column) -> Column:
    """Of the month that ``month`` (its first day) begins."""
    return F.date_add(F.next_day(F.date_sub(month, 1), "Fri"), 14)


def monthly_schedule(sessions: DataFrame) -> DataFrame:
    """``month, previous_day, formation_day, entry_day, expiration`` of each month with all of them.

    The formation day is the session after the month's expiry; the expiry is the third Friday, or the last
    session before it. Entry is the session after formation, and the position expires on the next month's expiry.
    """
    months = sessions.agg(F.min(F.trunc("date", "month")).alias("a"), F.max(F.trunc("date", "month")).alias("b"))
    months = months.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    fridays = months.withColumn("date", third_friday(F.col("month")))
    days = sessions.select("date", F.col("date").alias("expiry"), F.col("session_index").alias("i"))
    found = asof_join(fridays.withColumn("_one", F.lit(1)), days.withColumn("_one", F.lit(1)), by=["_one"], values=["expiry", "i"], direction="backward")
    nxt = Window.orderBy("month")
    plan = found.select("month", "i", F.lead("expiry").over(nxt).alias("expiration"))
    at = sessions.select(F.col("session_index").alias("i"), F.col("date").alias("day"))
    for name, step in (("previous_day", 0), ("formation_day", 1), ("entry_day", 2)):
        plan = plan.join(at.select((F.col("i") - step).alias("i"), F.col("day").alias(name)), "i", "left")
    return plan.select("month", "previous_day", "formation_day", "entry_day", "expiration").dropna()


def session_of_day(sessions: DataFrame, first: DataFrame) -> DataFrame:
    """``date, same, after``: for each calendar day up to the last session the session on or after it and the next one.

    Days begin with the date of ``first``, one row, if that is before the first session. As long as the calendar.
    """
    w = Window.orderBy("date")
    days = sessions.select("date", F.lag("date").over(w).alias("_previous"), F.lead("date").over(w).alias("after")).crossJoin(F.broadcast(first.select(F.col("date").alias("_first"))))
    start = F.coalesce(F.date_add("_previous", 1), F.least("_first", "date"))
    return days.select(F.explode(F.sequence(start, F.col("date"))).alias("day"), F.col("date").alias("same"), "after").withColumnRenamed("day", "date")


def event_sessions(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """``symbol, event_date, session, event_session``: the session that carries each announcement's move.

    An announcement falls on its own session, or on the next if it is none; one after the close (``amc``)
    moves the session after that. Events without such a session are dropped. Events meet a table of days by an
    equal date, so they stay spread over all tasks.
    """
    days = session_of_day(sessions, events.agg(F.min("date").alias("date")))
    found = events.join(days, "date")
    return found.select("symbol", F.col("date").alias("event_date"), "session", F.when(F.col("session") == "amc", F.col("after")).otherwise(F.col("same")).alias("event_session")).filter("event_session is not null")


def event_windows(events: DataFrame, sessions: DataFrame, before: int = 1, after: int = 0, runup: int = 5) -> DataFrame:
    """Adds ``runup_day, entry_day, exit_day`` to ``events (event_session)``, by session offsets; events without all are dropped."""
    out = events
    for name, n in (("runup_day", -runup), ("entry_day", -before), ("exit_day", after)):
        out = shift_sessions(out, sessions, n, "event_session", name)
    return out.dropna(subset=["runup_day", "entry_day", "exit_day"])


def members_as_of(current: DataFrame, changes: DataFrame, sessions: DataFrame) -> DataFrame:
    """``date, ticker``: who was a member on each session, from today's members and the log of changes.

    ``current (ticker)``; ``changes (effective_date, ticker, action)`` with ``Added`` and ``Removed``. A ticker
    is a member on a day if its first change after that day is a removal, or if there is none and it is a
    member today. Changes that fall on no session are ignored, as later sessions do not undo them.
    """
    log = changes.join(sessions.select(F.col("date").alias("effective_date")), "effective_date", "left_semi").select("ticker", F.date_sub("effective_date", 1).alias("date"), "action")
    log = log.groupBy("ticker", "date").agg(F.max("action").alias("action"))
    tickers = current.select("ticker").unionByName(log.select("ticker")).distinct()
    # a row for each ticker and session, the size of the result at most
    grid = grid_of(sessions.select("date"), tickers)
    found = asof_join(grid, log, by=["ticker"], values=["action"], direction="forward")
    today = current.select("ticker", F.lit(True).alias("today")).distinct()
    out = found.join(today, "ticker", "left")
    return out.filter((F.col("action") == "Removed") | (F.col("action").isNull() & F.col("today"))).select("date", "ticker")
