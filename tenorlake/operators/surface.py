"""Implied-volatility pillars, constant-maturity surfaces and the variance of announcement jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quotes import days_to, is_quoted
from .asof import count_events, next_event
from .rolling import rolling_quantile

YEAR = 365.0


def atm_pillars(chain: DataFrame, min_dte: int = 7, max_dte: int = 180, delta_band: tuple[float, float] = (0.25, 0.75), both: bool = True) -> DataFrame:
    """``date, symbol, expiration, dte, atm_iv, underlying``: the IV nearest to 0.50 absolute delta, averaged over rights.

    Ties go to the lower strike. With ``both`` an expiry needs a call and a put.
    """
    distance = F.abs(F.abs("delta") - 0.5)
    rows = chain.filter(F.col("iv").isNotNull() & is_quoted() & F.abs("delta").between(*delta_band)).withColumn("dte", days_to()).filter(F.col("dte").between(min_dte, max_dte))
    best = rows.groupBy("date", "symbol", "expiration", "right").agg(F.min_by(F.struct("iv", "dte", "underlying"), F.struct(F.round(distance, 9), "strike")).alias("b"))
    out = best.groupBy("date", "symbol", "expiration").agg(F.first("b.dte").alias("dte"), F.avg("b.iv").alias("atm_iv"), F.min("b.underlying").alias("underlying"), F.count("*").alias("_rights"))
    return (out.filter("_rights = 2") if both else out).drop("_rights")


def constant_maturity(pillars: DataFrame, tenors: tuple[int, ...] = (30, 60, 90), keys: tuple[str, ...] = ("date", "symbol"), extrapolate: bool = False) -> DataFrame:
    """``keys, iv30, ...``: IV at each tenor, linear in total variance between the pillars around it.

    Pillars that are not positive are dropped, equal ``dte`` averaged. Outside the pillars, and with a single
    one unless it is at the tenor, the value is null, or the nearest pillar's with ``extrapolate``.
    """
    clean = pillars.filter((F.col("dte") > 0) & (F.col("atm_iv") > 0) & (F.col("atm_iv") < float("inf")))
    clean = clean.groupBy(*keys, "dte").agg(F.avg("atm_iv").alias("iv")).withColumn("w", F.col("iv") * F.col("iv") * F.col("dte"))
    aggs = []
    for t in tenors:
        aggs.append(F.max(F.when(F.col("dte") <= t, F.struct("dte", "w", "iv"))).alias(f"_lo{t}"))
        aggs.append(F.min(F.when(F.col("dte") >= t, F.struct("dte", "w", "iv"))).alias(f"_hi{t}"))
    ends = clean.groupBy(*keys).agg(*aggs)
    out = []
    for t in tenors:
        lo, hi = F.col(f"_lo{t}"), F.col(f"_hi{t}")
        share = F.coalesce(F.try_divide(F.lit(t) - lo["dte"], hi["dte"] - lo["dte"]), F.lit(0.0))
        w = lo["w"] + share * (hi["w"] - lo["w"])
        inside = F.sqrt(F.greatest(w, F.lit(0.0)) / t)
        flat = F.coalesce(lo["iv"], hi["iv"]) if extrapolate else F.lit(None).cast("double")
        out.append(F.when(lo.isNotNull() & hi.isNotNull(), inside).otherwise(flat).alias(f"iv{t}"))
    return ends.select(*keys, *out)


def jump_variance(pillars: DataFrame, events: DataFrame, window: int = 250, least: int = 20, max_gap: int = 90) -> DataFrame:
    """``date, symbol, next_event, days_to_event, jump_var, method`` from the term structure around the next event.

    The last pillar before the event gives the diffusive variance a day; what the first pillar after it holds
    beyond that is the jump, floored at 0. Without such pillars (or with a gap above ``max_gap`` days) the
    trailing median of the name's own earlier estimates stands in.
    """
    days = next_event(pillars.select("date", "symbol").distinct(), events)
    rows = pillars.join(days, ["date", "symbol"]).withColumn("w", F.col("atm_iv") ** 2 * F.col("dte") / YEAR)
    after, known = F.col("expiration") >= F.col("next_event"), F.col("next_event").isNotNull()
    point = F.struct("dte", "w")
    ends = rows.groupBy("date", "symbol").agg(F.max(F.when(known & ~after, point)).alias("b"), F.min(F.when(after, point)).alias("a"))
    term = F.when(F.col("a.dte") - F.col("b.dte") <= max_gap, F.greatest(F.col("a.w") - F.col("b.w") / F.col("b.dte") * F.col("a.dte"), F.lit(0.0)))
    rows = days.join(ends, ["date", "symbol"], "left").withColumn("jump_term", term)
    rows = rolling_quantile(rows.select("date", "symbol", "next_event", "days_to_event", "jump_term"), "jump_term", "history", window, least, skip=1)
    known = F.col("next_event").isNotNull()
    method = F.when(~known, "none").when(F.col("jump_term").isNotNull(), "term").when(F.col("history").isNotNull(), "history").otherwise("none")
    return rows.select("date", "symbol", "next_event", "days_to_event", F.coalesce("jump_term", "history").alias("jump_var"), method.alias("method"))


def adjust_pillars(pillars: DataFrame, events: DataFrame, jumps: DataFrame, floor: float = 0.25) -> DataFrame:
    """``pillars`` without the variance of the events that they span; at least ``floor`` of a pillar's variance stays."""
    rows = count_events(pillars, events).join(jumps.select("date", "symbol", "jump_var"), ["date", "symbol"], "left")
    whole = F.col("atm_iv") ** 2
    left = whole - F.col("n_events") * F.coalesce("jump_var", F.lit(0.0)) * YEAR / F.col("dte")
    return rows.withColumn("atm_iv", F.sqrt(F.greatest(left, whole * floor))).select(pillars.columns)


def adjusted_surface(pillars: DataFrame, events: DataFrame, tenors: tuple[int, ...] = (30, 60, 90)) -> DataFrame:
    """Surface of the adjusted pillars with each day's jump estimate."""
    jumps = jump_variance(pillars, events)
    return constant_maturity(adjust_pillars(pillars, events, jumps), tenors).join(jumps, ["date", "symbol"], "left")
