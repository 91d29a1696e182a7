"""Position returns, hedged paths, target sizing, books and the rolled reference unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import average_rank, by, fill_forward
from ..sources.store import checkpointed
from .asof import asof_join
from .calendar import grid_of
from .chains import follow
from .panels import pick_straddles

MULTIPLIER = 100.0


def entry_price(side: str, fraction: float | Column, sign: int) -> Column:
    """Mid of ``side`` plus (long) or less (short) a fraction of the half spread."""
    return F.col(f"{side}_mid") + sign * fraction * (F.col(f"{side}_ask") - F.col(f"{side}_bid")) / 2


def hold_to_expiry(panel: DataFrame, fraction: float | Column = 0.0, side: str = "long") -> DataFrame:
    """Adds returns held to expiry: ``straddle, call_hedged, put_hedged, call_naked, put_naked, stock``.

    Only the entry pays a spread. A hedged option's gain is over the absolute initial investment.
    """
    sign = 1 if side == "long" else -1
    call, put = entry_price("call", fraction, sign), entry_price("put", fraction, sign)
    move = F.col("spot_at_expiry") - F.col("spot_entry")
    call_gain = F.col("call_payoff") - call - F.col("call_delta") * move
    put_gain = F.col("put_payoff") - put - F.col("put_delta") * move
    return panel.withColumns({
        "straddle": F.try_divide(F.col("call_payoff") + F.col("put_payoff"), call + put) - 1,
        "call_hedged": F.try_divide(call_gain, F.abs(F.col("call_delta") * F.col("spot_entry") - call)),
        "put_hedged": F.try_divide(put_gain, F.abs(put - F.col("put_delta") * F.col("spot_entry"))),
        "call_naked": F.try_divide(F.col("call_payoff"), call) - 1,
        "put_naked": F.try_divide(F.col("put_payoff"), put) - 1,
        "stock": F.try_divide(F.col("spot_at_expiry"), F.col("spot_entry")) - 1,
    })


def zero_delta_straddle(panel: DataFrame) -> DataFrame:
    """Adds ``zero_delta``: the straddle whose call and put weights cancel their deltas, held to expiry."""
    call_weight = F.try_divide(-F.col("put_delta") * F.col("call_mid"), F.col("call_delta") * F.col("put_mid") - F.col("put_delta") * F.col("call_mid"))
    call, put = (F.try_divide(F.col(f"{s}_payoff"), F.col(f"{s}_mid")) - 1 for s in ("call", "put"))
    return panel.withColumn("zero_delta", call_weight * call + (1 - call_weight) * put)


def early_exit(panel: DataFrame, marks: DataFrame, fraction: float = 0.0) -> DataFrame:
    """``symbol, month, horizon, straddle`` of positions sold at ``marks`` (exit bids and asks by horizon), less a share of the exit's half spread."""
    rows = panel.join(marks, ["symbol", "month"])
    exit_value = F.col("exit_mid") - fraction * (F.col("exit_ask") - F.col("exit_bid")) / 2
    paid = entry_price("call", fraction, 1) + entry_price("put", fraction, 1)
    return rows.select("symbol", "month", "horizon", (F.try_divide(exit_value, paid) - 1).alias("straddle"))


def daily_hedge(paths: DataFrame) -> DataFrame:
    """``symbol, month, option_pnl, hedge_pnl, n_days`` of short straddles hedged at each close.

    ``paths (symbol, month, date, spot, straddle_mid, net_delta)``. Days without a mark are skipped: the next
    one takes the move since the last that had it.
    """
    w = by("symbol", "month")
    rows = paths.filter("straddle_mid is not null and spot is not null")
    rows = rows.withColumns({"option": -(F.col("straddle_mid") - F.lag("straddle_mid").over(w)), "hedge": F.lag("net_delta").over(w) * (F.col("spot") - F.lag("spot").over(w))})
    return rows.groupBy("symbol", "month").agg(F.sum("option").alias("option_pnl"), F.sum("hedge").alias("hedge_pnl"), F.count("*").alias("n_days"))


def realized_over_hold(panel: DataFrame, returns: DataFrame, year: float = 252.0) -> DataFrame:
    """``panel (symbol, month, entry_day, expiration)`` with ``realized_var`` and ``n_days`` of the sessions in (entry, expiry].

    Differences of running sums, looked up as of both ends.
    """
    run = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    sums = returns.filter("r is not null").select("symbol", "date", F.sum(F.col("r") ** 2).over(run).alias("s"), F.count("r").over(run).alias("c"))
    out = panel
    for day, tag in (("entry_day", "a"), ("expiration", "b")):
        out = asof_join(out, sums.select("symbol", F.col("date").alias(day), F.col("s").alias(f"_s{tag}"), F.col("c").alias(f"_c{tag}")), ["symbol"], [f"_s{tag}", f"_c{tag}"], on=day)
    n = F.coalesce("_cb", F.lit(0)) - F.coalesce("_ca", F.lit(0))
    total = F.coalesce("_sb", F.lit(0.0)) - F.coalesce("_sa", F.lit(0.0))
    return out.withColumns({"realized_var": total * year / F.greatest(n, F.lit(1)), "n_days": n}).drop("_sa", "_sb", "_ca", "_cb")


def option_cost(contracts: Column, bid: Column, ask: Column, fraction: float = 1.0, fee: float = 0.0) -> Column:
    """Half spread and fee of a fill."""
    return F.abs(contracts) * (fraction * (ask - bid) / 2 * MULTIPLIER + fee)


def share_cost(shares: Column, per_share: float = 0.005) -> Column:
    return F.abs(shares) * per_share


def rank_targets(scores: DataFrame, gross: float = 1000.0, scheme: str = "linear", quantile: float = 0.1, short_rich: bool = True, min_names: int = 10, score: str = "signal", keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, date, symbol, target_vega`` of every date: weights by centred rank, or the two tails, of absolute sum ``gross``.

    Null scores are dropped. Dates with fewer than ``min_names`` have no targets.
    """
    day = Window.partitionBy(*keys, "date")
    rows = scores.filter(F.col(score).isNotNull()).withColumns({"_n": F.count(F.lit(1)).over(day), "_rank": average_rank(score, *keys, "date")}).filter(F.col("_n") >= min_names)
    if scheme == "linear":
        raw = F.col("_rank") - (F.col("_n") + 1) / 2
    elif scheme == "quantile":
        k = F.greatest(F.lit(1), F.bround(F.col("_n") * quantile))
        raw = F.when(F.col("_rank") <= k, -1.0).when(F.col("_rank") > F.col("_n") - k, 1.0).otherwise(0.0)
    else:
        raise ValueError(f"unknown scheme {scheme!r}")
    rows = rows.withColumn("_raw", -raw if short_rich else raw).withColumn("_sum", F.sum(F.abs("_raw")).over(day))
    return rows.filter("_sum > 0").select(*keys, "date", "symbol", (F.col("_raw") * gross / F.col("_sum")).alias("target_vega"))


def eligible_scores(scores: DataFrame, present: DataFrame, universe: DataFrame, held: DataFrame) -> DataFrame:
    """Scores of each date's names that have a chain row and are in the universe, or that the book holds.

    ``present, universe, held (date, symbol)``; ``held``: what the book holds when the date begins, so a name that has
    left the universe can be unwound by the sizer, and one whose last target was zero no longer counts.
    """
    pairs = lambda df: df.select("date", "symbol").distinct()
    allowed = pairs(present).join(pairs(universe), ["date", "symbol"], "left_semi").unionByName(pairs(held)).distinct()
    return scores.filter("signal is not null").join(allowed, ["date", "symbol"], "left_semi")


def held_before(records: DataFrame) -> DataFrame:
    """``date, symbol``: for each day of a book's records the names whose units were not zero on the one before."""
    days = records.select("date").distinct()
    following = days.withColumn("next", F.lead("date").over(Window.orderBy("date")))
    return records.filter("units <> 0").join(following, "date").filter("next is not null").select(F.col("next").alias("date"), "symbol")


def closed_loop(scores: DataFrame, present: DataFrame, universe: DataFrame, rebalances: DataFrame, score: str = "signal", **sizing) -> DataFrame:
    """``date, symbol, target_vega``: targets of each rebalance that depend on what the book holds by then.

    ``present (date, symbol, dollar_vega)`` has a row for each session of a name; ``scores``, ``universe`` are by ``date, symbol``. Scored at a
    rebalance are the names that are present and in the universe, and those that are held: a name that has left the universe is kept as long as its rank
    gives it a target, it has a score, and no session misses its row. ``sizing`` is that of ``rank_targets``; what is held without a target gets none
    and is closed by the book.

    Whether a name is held follows from its targets before, and its target from the ranks of all names that are held with it. Given which targets are not
    zero, every name's holding is a matter of runs: held is what has been set since it was last reset, two running maxima by name. So all
    names and rebalances are worked out at once, starting from "no target is zero", then again with the targets that come out, until
    nothing changes. A round is right for one rebalance more than the last at least, as ranks look only back, so it ends, and it ends in the session loop's
    result; with linear weights only a middle rank is zero, and two or three rounds do.
    """
    marked = present.filter("dollar_vega is not null").select("date", "symbol", "dollar_vega")
    sessions = present.select("date").distinct()
    marks = rebalances.select("date").distinct().join(sessions, "date", "left_semi")
    # each session's rebalance, on it or after; calendars are a few thousand rows
    back = Window.orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    spans = sessions.join(marks.withColumn("_mark", F.col("date")), "date", "left").select("date", F.last("_mark", ignorenulls=True).over(back).alias("next")).filter("next is not null")
    place = spans.groupBy(F.col("next").alias("date")).agg(F.count("*").alias("_sessions")).withColumn("_place", F.row_number().over(Window.orderBy("date")))
    on = F.col("date") == F.col("next")
    rows = marked.join(F.broadcast(spans), "date").groupBy("symbol", F.col("next").alias("date")).agg(F.count_distinct("date").alias("_rows"), F.max(F.when(on, F.col("dollar_vega"))).alias("_vega"))
    named = scores.filter(F.col(score).isNotNull()).select("date", "symbol", F.col(score).alias("_score"))
    member = universe.select("date", "symbol").distinct().withColumn("_member", F.lit(True))
    state = rows.join(F.broadcast(place), "date").join(named, ["date", "symbol"], "left").join(member, ["date", "symbol"], "left")
    order = by("symbol")
    here = F.col("_vega").isNotNull()
    scored = here & F.col("_score").isNotNull()
    # no session without the name's row since the rebalance before
    whole = (F.col("_rows") == F.col("_sessions")) & (F.coalesce(F.lag("_place").over(order), F.lit(-1)) == F.col("_place") - 1)
    kept_columns = ["date", "symbol", "_score", "_vega", "_member", "_whole", "_n", "_kept"]
    state = state.withColumns({"_whole": whole & here, "_member": F.coalesce("_member", F.lit(False)), "_n": F.row_number().over(order), "_kept": F.lit(True)}).select(*kept_columns)
    last = lambda c: F.coalesce(F.max(F.when(c, F.col("_n"))).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    trades = F.col("_vega") > 0
    while True:
        sets = scored & trades & F.col("_member") & F.col("_kept")
        holds = F.col("_whole") & F.when(trades, scored & F.col("_kept")).otherwise(True)
        state = checkpointed(state).withColumns({"_set": last(sets), "_reset": last(~holds)})
        state = state.withColumn("_held", (F.col("_set") > 0) & (F.col("_set") >= F.col("_reset")))
        state = checkpointed(state.select(*kept_columns, (scored & (F.col("_member") | (F.col("_whole") & F.coalesce(F.lag("_held").over(order), F.lit(False))))).alias("_now")))
        sized = rank_targets(state.filter("_now").select("date", "symbol", F.col("_score").alias(score)), score=score, **sizing)
        state = checkpointed(state.join(sized, ["date", "symbol"], "left").withColumn("_fresh", ~F.col("_now") | (F.coalesce("target_vega", F.lit(0.0)) != 0)))
        if state.filter(F.col("_fresh") != F.col("_kept")).isEmpty():
            return state.filter(F.col("_now") & F.col("target_vega").isNotNull()).select("date", "symbol", "target_vega")
        state = state.withColumn("_kept", F.col("_fresh")).select(*kept_columns)


def fixed_targets(rebalances: DataFrame, targets: dict[str, float]) -> DataFrame:
    """``date, symbol, target_vega``: the same targets at each rebalance."""
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("symbol"), F.lit(float(v)).alias("target_vega")) for s, v in targets.items())))
    return rebalances.select("date", pairs.alias("t")).select("date", "t.*")


def unit_targets(present: DataFrame) -> DataFrame:
    """One unit's vega for every name with a row: ``date, symbol, target_vega``."""
    return present.select("date", "symbol", F.col("dollar_vega").alias("target_vega"))


def book(reference: DataFrame, targets: DataFrame, rebalances: DataFrame, cost_fraction: float = 0.0, labels: list[str] | None = None) -> DataFrame:
    """Daily records of a book that holds units of each name's reference position.

    ``reference (date, symbol, pnl_per_vega, cost_per_vega, exit_cost_per_vega, entry_vega, dollar_vega, event)``;
    ``targets (date, symbol, target_vega)`` at ``rebalances (date)``. Units become target / unit vega at a
    rebalance, 0 if the name has no target there, and stay in between; a session without the name's row closes
    it until the next rebalance. A rebalance at which the unit vega is not positive changes nothing.
    All names run in parallel, each in one ordered window; sessions are those of the reference. With ``labels``,
    the names of a few books, targets and records have a column ``label`` too, and all books run at once.
    """
    keys = ["label"] if labels else []
    marks = rebalances.select("date", F.lit(True).alias("_rebalance")).distinct()
    rows = grid_of(reference.select("date"), reference.select("symbol").distinct()).join(marks, "date", "left").join(reference, ["date", "symbol"], "left")
    if labels:
        rows = rows.withColumn("label", F.explode(F.array(*(F.lit(x) for x in labels))))
    rows = rows.join(targets.select(*keys, "date", "symbol", "target_vega"), [*keys, "date", "symbol"], "left")
    here = F.col("dollar_vega").isNotNull()
    w = by(*keys, "symbol")
    # what the session sets the units to: null leaves them
    sets = F.when(~here, F.lit(0.0)).when(F.col("_rebalance") & (F.col("dollar_vega") > 0), F.coalesce("target_vega", F.lit(0.0)) / F.when(F.col("dollar_vega") > 0, F.col("dollar_vega")))
    rows = rows.withColumn("units", F.coalesce(fill_forward(sets, w), F.lit(0.0)))
    rows = rows.withColumn("_held", F.coalesce(F.lag("units").over(w), F.lit(0.0)))
    # a missing row closes first, so a trade is measured from what is left
    before = F.when(here, F.col("_held")).otherwise(F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    fresh = F.when(F.col("event").isin("open", "roll"), zero("dollar_vega")).otherwise(zero("entry_vega"))
    half = zero("exit_cost_per_vega") * fresh
    traded = F.when(here, F.col("units") - before).otherwise(F.lit(0.0))
    kind = F.when(~here & (F.col("_held") != 0), "forced_close").when((traded != 0) & (F.col("_held") == 0), "open").when((traded != 0) & (F.col("units") == 0), "close").when((traded != 0) & (zero_text("event") == ""), "trade").otherwise(zero_text("event"))
    rows = rows.select(
        *keys, "date", "symbol", "units",
        F.when(here, F.col("_held") * zero("entry_vega") * zero("pnl_per_vega")).otherwise(0.0).alias("option_pnl"),
        ((F.when(here, F.abs("_held") * zero("entry_vega") * zero("cost_per_vega")).otherwise(0.0) + F.abs(traded) * half) * cost_fraction).alias("option_cost"),
        (F.col("units") * zero("dollar_vega")).alias("dollar_vega"),
        (F.abs("units") * half).alias("exit_cost"),
        (~here).alias("stale"),
        kind.alias("event"),
        "_held",
    )
    return rows.filter((F.col("units") != 0) | (F.col("_held") != 0)).drop("_held")


def zero_text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def reference_unit(chain: DataFrame, roll_dte: int = 14, max_stale: int = 5, min_dte: int = 20, max_dte: int = 90, target_dte: int = 45) -> DataFrame:
    """``date, symbol, opened, expiration, strike, unit_mid, unit_bid, unit_ask, unit_delta, unit_vega, underlying, event, last_mid, prior_delta, mid_change, hedge_pnl, pnl``: one straddle a name, rolled.

    A name opens the day's pick, is marked each session, rolls to that day's pick on the first mark with at most
    ``roll_dte`` days left, and is closed by force at expiry or after more than ``max_stale`` sessions without a
    mark; it may open again that day. Where a name has no pick on its roll day it closes and opens at the next pick.
    ``unit_vega`` and ``last_mid`` are the last mark's (vega null if the chain has none); ``prior_delta`` the delta that the session
    was hedged with. On sessions without a mark the hedge still moves with the underlying.

    ``chain`` is read several times and should be a stored or kept table. The tables of a row for each name and session are checkpointed after each step,
    as a chain that is laid out by symbol would have all lookups in the one task, each with memory of its own.

    The sessions of a name are those on which its chain has rows. (1) The pick of each day. (2) For each pick the
    session that ends it, by as-of lookups among its own marks. (3) The picks that are really held, by doubling jumps
    from one to the next. (4) Marks, lags and P&L per position.
    """
    never = F.lit(1 << 30)
    quotes = chain.withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    if "vega" not in chain.columns:
        quotes = quotes.withColumn("vega", F.lit(None).cast("double"))
    spot = F.min_by("underlying", F.struct("expiration", "strike", "right"))
    days = checkpointed(quotes.groupBy("symbol", "date").agg(spot.alias("underlying")).withColumn("session", F.row_number().over(by("symbol"))))
    picks = pick_straddles(quotes, min_dte, max_dte, target_dte, max_moneyness=1.0).drop("dte")
    sums = quotes.filter((F.col("ask") > 0) & (F.col("bid") >= 0) & (F.col("ask") >= F.col("bid"))).groupBy("symbol", "expiration", "strike", "date").agg(
        F.count("*").alias("_legs"), *(F.sum(c).alias(f"unit_{c}") for c in ("mid", "ask", "bid", "delta", "vega"))
    ).filter("_legs >= 2").drop("_legs")
    unit = ["symbol", "expiration", "strike"]
    marks = sums.join(days.select("symbol", "date", "session"), ["symbol", "date"]).select(*unit, "date", "session")
    # (2) a roll: the first later mark near expiry; a forced close: the first session that is at expiry or too stale
    held = checkpointed(picks.join(days.select("symbol", "date", F.col("session").alias("start")), ["symbol", "date"]))
    near = marks.filter(F.datediff("expiration", "date") <= roll_dte).select(*unit, "date", F.col("session").alias("roll"))
    held = checkpointed(asof_join(held, near, unit, ["roll"], direction="forward", exact=False))
    gap = F.lead("session").over(Window.partitionBy(*unit).orderBy("session")) - F.col("session")
    breaks = marks.withColumn("_gap", gap).filter(F.coalesce("_gap", never) > max_stale + 1).select(*unit, "date", (F.col("session") + max_stale + 1).alias("stale"))
    held = checkpointed(asof_join(held, breaks, unit, ["stale"], direction="forward")).withColumnRenamed("date", "opened")
    held = held.withColumn("_end", F.greatest(F.col("expiration"), F.date_add("opened", 1)))
    held = asof_join(held, days.select("symbol", F.col("date").alias("_end"), F.col("session").alias("expiry")), ["symbol"], ["expiry"], on="_end", direction="forward")
    # at expiry a mark means a roll, no mark a forced close
    forced = F.least(F.coalesce("stale", never), F.coalesce("expiry", never))
    rolled = F.coalesce(F.col("roll"), never) <= forced
    ends = held.select(*unit, "opened", "start", F.least(F.coalesce("roll", never), forced).alias("end"), rolled.alias("rolled"))
    # (3) hold one until its end, then take the first that starts there or later
    runs = follow(ends, "symbol", "start", "end")
    # (4) each position's own sessions
    last = days.groupBy("symbol").agg(F.max("session").alias("_last"))
    runs = runs.join(last, "symbol").withColumn("session", F.explode(F.sequence("start", F.least("end", "_last"))))
    path = runs.join(days, ["symbol", "session"]).join(sums, [*unit, "date"], "left")
    w = Window.partitionBy("symbol", "opened").orderBy("session")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    prior = lambda c: F.last(c, ignorenulls=True).over(before)
    path = path.withColumn("prior_delta", prior("unit_delta")).withColumns({
        "mid_change": F.col("unit_mid") - prior("unit_mid"),
        "hedge_pnl": -F.col("prior_delta") * (F.col("underlying") - F.lag("underlying").over(w)),
        "unit_vega": fill_forward(F.col("unit_vega"), w),
        "last_mid": fill_forward(F.col("unit_mid"), w),
    })
    event = F.when(F.col("session") == F.col("start"), "open").when(F.col("session") == F.col("end"), F.when(F.col("rolled"), "roll").otherwise("forced_close")).otherwise("")
    pnl = F.coalesce("mid_change", F.lit(0.0)) + F.coalesce("hedge_pnl", F.lit(0.0))
    return path.select("date", "symbol", "opened", "expiration", "strike", "unit_mid", "unit_bid", "unit_ask", "unit_delta", "unit_vega", "underlying", event.alias("event"), "last_mid", "prior_delta", "mid_change", "hedge_pnl", pnl.alias("pnl"))


def unit_records(path: DataFrame, fraction: float = 1.0, per_share: float = 0.005) -> DataFrame:
    """``date, symbol, event, option_pnl, hedge_pnl, option_cost, hedge_cost, exit_cost, dollar_vega, mid, underlying, dte``: one contract's day.

    ``path``: the rows of ``reference_unit``; on a day on which one unit ends and the next begins both are added up. The
    event is ``roll`` for both on one day, ``roll_failed_closed`` for a roll without a new unit, ``open`` also for a
    unit that follows a forced close at once. Options cost ``fraction`` of the half spread where they are traded by
    choice (a forced close has no quote), shares ``per_share`` each.
    """
    is_ = lambda *e: F.col("event").isin(*e)
    half = (F.col("unit_ask") - F.col("unit_bid")) / 2 * MULTIPLIER
    only = lambda c, condition: F.max(F.when(condition, c))
    left = ~is_("roll", "forced_close")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    day = path.groupBy("date", "symbol").agg(
        F.sum(F.coalesce("mid_change", F.lit(0.0)) * MULTIPLIER).alias("option_pnl"),
        F.sum(F.coalesce("hedge_pnl", F.lit(0.0)) * MULTIPLIER).alias("hedge_pnl"),
        *(F.max(is_(e)).alias(f"_{e}") for e in ("open", "roll", "forced_close")),
        (F.sum(F.when(is_("open", "roll"), F.coalesce(half, F.lit(0.0))).otherwise(0.0)) * fraction).alias("option_cost"),
        only(-F.col("prior_delta") * MULTIPLIER, ~is_("open")).alias("_old"),
        only(-F.col("unit_delta") * MULTIPLIER, left).alias("_marked"),
        only(half, left).alias("_half"),
        F.coalesce(only(F.col("unit_vega") * MULTIPLIER, left), F.lit(0.0)).alias("dollar_vega"),
        only(F.col("last_mid"), left).alias("mid"),
        F.max("underlying").alias("underlying"),
        only(F.datediff("expiration", "date"), left).alias("dte"),
    )
    event = F.when(F.col("_roll") & F.col("_open"), "roll").when(F.col("_roll"), "roll_failed_closed").when(F.col("_open"), "open").when(F.col("_forced_close"), "forced_close").otherwise("")
    old, marked = zero("_old"), zero("_marked")
    shares = F.when(F.col("_forced_close"), F.abs(old) + F.abs(marked)).when(F.col("_marked").isNull() & ~F.col("_roll"), 0.0).otherwise(F.abs(marked - old))
    return day.select("date", "symbol", event.alias("event"), "option_pnl", "hedge_pnl", "option_cost", (shares * per_share).alias("hedge_cost"), zero("_half").alias("exit_cost"), "dollar_vega", "mid", "underlying", "dte")


def per_vega(records: DataFrame) -> DataFrame:
    """``pnl_per_vega, cost_per_vega, exit_cost_per_vega`` of unit records, by the vega at inception.

    ``records``: those of ``unit_records``. P&L and cost of a session are over the inception vega of the unit held
    into it, the exit cost over that of today's unit. A name's first session has neither P&L nor cost.
    """
    w = by("symbol")
    rows = records.withColumn("inception_vega", fill_forward(F.when(F.col("event").isin("open", "roll"), F.col("dollar_vega")), w)).withColumn("entry_vega", F.lag("inception_vega").over(w))
    over = lambda c, v: F.when(F.col(v) > 0, c / F.col(v))
    return rows.select(
        "date", "symbol", over(F.col("option_pnl") + F.col("hedge_pnl"), "entry_vega").alias("pnl_per_vega"), over(F.col("option_cost") + F.col("hedge_cost"), "entry_vega").alias("cost_per_vega"),
        over(F.col("exit_cost"), "inception_vega").alias("exit_cost_per_vega"), "dollar_vega", "entry_vega", "mid", "underlying", "dte", "event",
    )


def dollar_vega(vega: Column, contracts: Column) -> Column:
    """P&L of ``contracts`` straddles for one volatility point."""
    return vega * MULTIPLIER * contracts


def hedge_shares(delta: Column, contracts: Column) -> Column:
    return -delta * MULTIPLIER * contracts
