"""Contract picks and stock-month, event and index panels made from option chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quotes import days_to, has_valid_iv, is_clean, is_monthly, is_quoted, mid
from .joins import pair_entries


def first_by(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in a total order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", place).filter(F.col("_n") <= n).drop("_n")


def liquid_units(chain: DataFrame, max_spread: float, min_oi: int) -> DataFrame:
    """``date, symbol, expiration, strike, min_oi, spread`` of straddles whose legs both have open interest and a narrow spread."""
    spread = F.try_divide(F.col("ask") - F.col("bid"), mid())
    units = chain.groupBy("date", "symbol", "expiration", "strike").agg(F.min("oi").alias("min_oi"), F.count("oi").alias("_legs"), F.max(spread).alias("spread"))
    return units.filter((F.col("_legs") == 2) & (F.col("min_oi") >= min_oi) & (F.col("spread") <= max_spread)).drop("_legs")


def exit_marks(entries: DataFrame, sessions: DataFrame, marks: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """``entries (symbol, entry_day)`` by ``horizon``: the session that many later (the last one at most) and its mark, or null."""
    last = F.broadcast(sessions.agg(F.max("session_index").alias("_last")))
    rows = entries.join(sessions.select(F.col("date").alias("entry_day"), F.col("session_index").alias("_i")), "entry_day")
    rows = rows.withColumn("horizon", F.explode(F.array(*(F.lit(h) for h in horizons)))).crossJoin(last)
    rows = rows.withColumn("_i", F.least(F.col("_i") + F.col("horizon"), F.col("_last")))
    rows = rows.join(sessions.select(F.col("date").alias("exit_day"), F.col("session_index").alias("_i")), "_i")
    return rows.join(marks, ["symbol", "exit_day"], "left").select("symbol", "entry_day", "horizon", "exit_day", "exit_mark")


def pick_straddles(chain: DataFrame, min_dte: int = 20, max_dte: int = 90, target_dte: int = 45, max_moneyness: float = 0.2, monthly_only: bool = False) -> DataFrame:
    """``date, symbol, expiration, strike, dte``: each day's straddle of each symbol.

    Both rights quoted; nearest to the target life, the longer of two as near, nearest to spot, the lower strike.
    """
    rows = chain.filter(is_quoted()).withColumn("dte", days_to()).filter(F.col("dte").between(min_dte, max_dte))
    if monthly_only:
        rows = rows.filter(is_monthly())
    pairs = rows.groupBy("date", "symbol", "expiration", "strike", "dte").agg(F.count_distinct("right").alias("_rights"), F.min("underlying").alias("underlying")).filter("_rights = 2")
    pairs = pairs.withColumn("_away", F.abs(F.col("strike") / F.col("underlying") - 1)).filter(F.col("_away") <= max_moneyness)
    order = [F.abs(F.col("dte") - target_dte), F.col("dte").desc(), F.col("_away"), F.col("strike")]
    return first_by(pairs, ["date", "symbol"], order).select("date", "symbol", "expiration", "strike", "dte")


def mark_units(units: DataFrame, chain: DataFrame, values: tuple[str, ...] = ("bid", "ask", "mid", "delta")) -> DataFrame:
    """``units (date, symbol, expiration, strike)`` with the sums over both legs; null unless both can be marked."""
    usable = chain.filter((F.col("ask") > 0) & (F.col("bid") >= 0) & (F.col("ask") >= F.col("bid")))
    sums = usable.groupBy("date", "symbol", "expiration", "strike").agg(F.count("*").alias("_legs"), *(F.sum(v).alias(f"unit_{v}") for v in values))
    return units.join(sums.filter("_legs >= 2").drop("_legs"), ["date", "symbol", "expiration", "strike"], "left")


def nearest_expiry(chain: DataFrame, target: int, low: int, high: int, keys: tuple[str, ...] = ("date", "symbol")) -> DataFrame:
    """``keys, expiration``: the expiry within [low, high] days that is nearest to ``target``, the earlier of two as near."""
    rows = chain.select(*keys, "expiration", days_to().alias("_d")).filter(F.col("_d").between(low, high))
    return rows.groupBy(*keys).agg(F.min_by("expiration", F.struct(F.abs(F.col("_d") - target), "expiration")).alias("expiration"))


def atm_iv(chain: DataFrame, right: str = "C", keys: tuple[str, ...] = ("date", "symbol", "expiration")) -> DataFrame:
    """``keys, atm_iv``: IV of the strike nearest to spot, the lower of two as near."""
    rows = chain.filter((F.col("right") == right) & (F.col("iv") > 0))
    return rows.groupBy(*keys).agg(F.min_by("iv", F.struct(F.abs(F.col("strike") / F.col("underlying") - 1), "strike")).alias("atm_iv"))


def skew_and_slope(chain: DataFrame, otm: float = 0.9, near: tuple[int, int, int] = (30, 10, 50), far: tuple[int, int, int] = (75, 51, 120)) -> DataFrame:
    """``date, symbol, skew, slope``: OTM put less ATM call IV of the near expiry; near less far ATM call IV."""
    def at(window):
        return chain.join(nearest_expiry(chain, *window), ["date", "symbol", "expiration"], "left_semi")

    close, distant = at(near), at(far)
    day = ("date", "symbol")
    call = atm_iv(close, "C", day)
    put = close.filter((F.col("right") == "P") & (F.col("iv") > 0)).groupBy(*day).agg(F.min_by("iv", F.struct(F.abs(F.col("strike") / F.col("underlying") - otm), "strike")).alias("put_iv"))
    skew = put.join(call, list(day)).select(*day, (F.col("put_iv") - F.col("atm_iv")).alias("skew"))
    slope = call.join(atm_iv(distant, "C", day).withColumnRenamed("atm_iv", "far_iv"), list(day)).select(*day, (F.col("atm_iv") - F.col("far_iv")).alias("slope"))
    return skew.join(slope, list(day), "full")


def top_mean(rows: DataFrame, keys: list[str], order: list[Column], value: str, n: int = 2) -> DataFrame:
    """Mean ``value`` of the first ``n`` rows of each key."""
    return first_by(rows, keys, order, n).groupBy(*keys).agg(F.avg(value).alias(value))


def event_straddles(events: DataFrame, quotes: DataFrame, entry: str = "entry_day") -> DataFrame:
    """``symbol, event_session, expiration, strike``: for each event the nearest expiry after it, then the strike nearest to spot, from pairs quoted on ``entry``."""
    both = quotes.filter(is_quoted()).groupBy("date", "symbol", "expiration", "strike").agg(F.count_distinct("right").alias("_r"), F.min("underlying").alias("underlying")).filter("_r = 2")
    rows = events.join(both.withColumnRenamed("date", entry), ["symbol", entry]).filter(F.col("expiration") >= F.col("event_session"))
    order = [F.col("expiration"), F.abs(F.col("strike") / F.col("underlying") - 1), F.col("strike")]
    return first_by(rows, ["symbol", "event_session"], order).select("symbol", "event_session", entry, "expiration", "strike")


def stock_months(wide: DataFrame, schedule: DataFrame, traded: bool = True) -> DataFrame:
    """One contract for each symbol and month: picked on the formation day, with its entry quotes and payoff at expiry.

    ``wide``: contract-days with calls and puts side by side (``call_bid`` ...), ``underlying``, ``hv``,
    ``spot_at_expiry`` and ``call_stale``/``put_stale``. Both sides must be clean on both days and have a
    valid IV on the first; the strike nearest to spot wins, the lower of two as near. Index options need a
    quote only, no volume: ``traded=False``.
    """
    clean = is_clean("call_") & is_clean("put_") if traded else is_quoted("call_") & is_quoted("put_")
    valid = has_valid_iv("call_iv", "call_iv_error") & has_valid_iv("put_iv", "put_iv_error")
    plan = schedule.select("month", F.col("formation_day").alias("date"), "entry_day", "expiration")
    formed = wide.join(plan, ["date", "expiration"]).filter(clean & valid & F.col("hv").isNotNull())
    formed = formed.withColumn("moneyness", F.col("strike") / F.col("underlying"))
    formed = first_by(formed, ["symbol", "month"], [F.abs(F.col("moneyness") - 1), F.col("strike")])
    formed = formed.select("symbol", "month", F.col("date").alias("formation_day"), "entry_day", "expiration", "strike", "moneyness", "hv", ((F.col("call_iv") + F.col("put_iv")) / 2).alias("iv"))
    entry = wide.filter(clean & (F.col("spot_at_expiry") > 0)).select(
        "symbol", F.col("date").alias("entry_day"), "expiration", "strike", F.col("underlying").alias("spot_entry"), "spot_at_expiry",
        *(f"{s}_{c}" for s in ("call", "put") for c in ("bid", "ask", "delta")),
    )
    out = pair_entries(formed, entry)
    return out.withColumns({
        "call_mid": mid("call_bid", "call_ask"), "put_mid": mid("put_bid", "put_ask"),
        "call_payoff": F.greatest(F.col("spot_at_expiry") - F.col("strike"), F.lit(0.0)),
        "put_payoff": F.greatest(F.col("strike") - F.col("spot_at_expiry"), F.lit(0.0)),
        "signal": F.ln("hv") - F.ln("iv"),
    })
