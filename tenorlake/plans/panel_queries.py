"""Queries of picks (T), aggregates (A), positions (B) and surfaces (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pricing
from ..functions.windows import bucket, by, quantiles
from ..operators import calendar, panels, pnl, reports, risk, surface, vol
from ..operators.joins import pivot_sides
from ..sources.roles import Roles, with_roles
from .registry import query, r6, rounded

# ---- selection -------------------------------------------------------------------------------------------------


@query(with_roles("chain", """p as (select date, symbol, expiration, strike, cast(expiration - date as integer) as dte, abs(strike / 100.0 - 1) as m from chain where bid > 0 and ask > bid and expiration - date between 10 and 90
        group by 1, 2, 3, 4, 5 having count(distinct "right") = 2),
    r as (select *, row_number() over (partition by date, symbol order by abs(dte - 45), dte desc, m, strike) as n from p where m <= 0.2) select date, symbol, expiration, strike, dte from r where n = 1"""))
def t2_straddle_pick(r: Roles):
    return panels.pick_straddles(r.chain, 10, 90, 45, 0.2)


@query(with_roles("chain", """u as (select distinct date, symbol, expiration, strike from chain), s as (select date, symbol, expiration, strike, sum((bid + ask) / 2) as mid, sum(delta) as delta from chain where ask > 0 and bid >= 0 and ask >= bid group by all having count(*) = 2)
    select date, symbol, expiration, strike, round(mid, 6) as unit_mid, round(delta, 6) + 0.0 as unit_delta from u left join s using (date, symbol, expiration, strike)"""))
def t3_unit_marks(r: Roles):
    units = r.chain.select("date", "symbol", "expiration", "strike").distinct()
    return rounded(panels.mark_units(units, r.chain.withColumn("mid", (F.col("bid") + F.col("ask")) / 2), ("mid", "delta")))


_PILLARS = """best as (select date, symbol, expiration, cast(expiration - date as integer) as dte, "right", min_by(iv, (round(abs(abs(delta) - 0.5), 9), strike)) as iv from chain
        where bid > 0 and ask > bid and abs(delta) between 0.25 and 0.75 and expiration - date between 7 and 180 group by 1, 2, 3, 4, 5),
    pillars as (select date, symbol, expiration, dte, avg(iv) as atm_iv from best group by 1, 2, 3, 4 having count(*) = 2)"""


@query(with_roles("chain", f"{_PILLARS} select date, symbol, expiration, dte, round(atm_iv, 8) as atm_iv from pillars"))
def t4_atm_pillars(r: Roles):
    return surface.atm_pillars(r.chain).select("date", "symbol", "expiration", "dte", r6("atm_iv", 8))


@query(with_roles("chain", """e as (select date, symbol, expiration, expiration - date as d from chain) select date, symbol, min_by(expiration, (abs(d - 40), expiration)) as expiration from e where d between 10 and 80 group by 1, 2"""))
def t5_nearest_expiry(r: Roles):
    return panels.nearest_expiry(r.chain, 40, 10, 80)


_SKEW = """e as (select *, expiration - date as d from chain), n as (select date, symbol, min_by(expiration, (abs(d - 30), expiration)) as x from e where d between 10 and 50 group by 1, 2),
    f as (select date, symbol, min_by(expiration, (abs(d - 75), expiration)) as x from e where d between 51 and 120 group by 1, 2),
    nq as (select c.* from chain c join n on n.date = c.date and n.symbol = c.symbol and n.x = c.expiration), fq as (select c.* from chain c join f on f.date = c.date and f.symbol = c.symbol and f.x = c.expiration),
    ca as (select date, symbol, min_by(iv, (abs(strike / underlying - 1), strike)) as v from nq where "right" = 'C' and iv > 0 group by 1, 2), pu as (select date, symbol, min_by(iv, (abs(strike / underlying - 0.9), strike)) as v from nq where "right" = 'P' and iv > 0 group by 1, 2),
    fa as (select date, symbol, min_by(iv, (abs(strike / underlying - 1), strike)) as v from fq where "right" = 'C' and iv > 0 group by 1, 2),
    sk as (select date, symbol, pu.v - ca.v as skew from pu join ca using (date, symbol)), sl as (select date, symbol, ca.v - fa.v as slope from ca join fa using (date, symbol))"""


@query(with_roles("chain", f"{_SKEW} select date, symbol, round(skew, 6) + 0.0 as skew, round(slope, 6) + 0.0 as slope from sk full join sl using (date, symbol)"))
def t6_skew_and_slope(r: Roles):
    return rounded(panels.skew_and_slope(r.chain))


@query(with_roles("chain", """k as (select date, symbol, iv, row_number() over (partition by date, symbol order by abs(strike - 100), expiration, "right", strike) as n from chain) select date, symbol, round(avg(iv), 8) as iv from k where n <= 2 group by 1, 2"""))
def t7_top_two_mean(r: Roles):
    return rounded(panels.top_mean(r.chain, ["date", "symbol"], [F.abs(F.col("strike") - 100), F.col("expiration"), F.col("right"), F.col("strike")], "iv"), 8)


_EVENT_DAYS = """weeks as (select date, row_number() over (order by date) - 1 as i from (select distinct date from chain)),
    ev as (select distinct a.symbol, w.date as event_session, w.i from announcements a asof join weeks w on w.date >= a.date), ew as (select e.symbol, e.event_session, p.date as entry_day from ev e join weeks p on p.i = e.i - 1)"""


@query(with_roles("chain announcements", f"""{_EVENT_DAYS}, q as (select date, symbol, expiration, strike, min(underlying) as u from chain where bid > 0 and ask > bid group by 1, 2, 3, 4 having count(distinct "right") = 2),
    r as (select ew.*, q.expiration, q.strike, row_number() over (partition by ew.symbol, ew.event_session order by q.expiration, abs(q.strike / u - 1), q.strike) as n from ew join q on q.symbol = ew.symbol and q.date = ew.entry_day and q.expiration >= ew.event_session)
    select symbol, event_session, entry_day, expiration, strike from r where n = 1"""))
def t8_event_straddles(r: Roles):
    weeks = calendar.session_index(r.chain.select("date"))
    events = calendar.event_sessions(r.announcements.withColumn("session", F.lit("bmo")), weeks).select("symbol", "event_session").distinct()
    events = calendar.shift_sessions(events, weeks, -1, "event_session", "entry_day").filter("entry_day is not null")
    return panels.event_straddles(events, r.chain)


@query(with_roles("xs_bars", """m as (select date as month, round(avg(close / open - 1), 6) as ret from xs_bars group by 1) select * from ((select *, 'worst' as tail from m order by ret, month limit 8) union all (select *, 'best' as tail from m order by ret desc, month limit 5))"""))
def t9_tails(r: Roles):
    months = r.xs_bars.groupBy(F.col("date").alias("month")).agg(F.round(F.avg(F.col("close") / F.col("open") - 1), 6).alias("ret"))
    return reports.tails(months, "ret")


@query(with_roles("chain", """select date, symbol, expiration, strike, max(case when "right" = 'C' then bid end) as call_bid, max(case when "right" = 'P' then bid end) as put_bid, max(case when "right" = 'C' then iv end) as call_iv, max(case when "right" = 'P' then iv end) as put_iv from chain group by 1, 2, 3, 4"""))
def a18_pivot_sides(r: Roles):
    return pivot_sides(r.chain, ["date", "symbol", "expiration", "strike"], ["bid", "iv"])


@query(with_roles("chain", """n as (select date, avg(cast(ask > 0.25 as integer)) as s from chain where expiration - date between 7 and 60 and abs(strike / underlying - 1) <= 0.1 group by 1) select date, round(s, 6) as quoted_share from n where s < 0.95"""))
def a13_unquoted_sessions(r: Roles):
    return rounded(reports.unquoted_sessions(r.chain.withColumn("ask", F.when(F.col("ask") > 0.25, F.col("ask")).otherwise(0.0)), 0.95))


# ---- deciles and summaries -------------------------------------------------------------------------------------

_PANEL = """px as (select date as month, symbol, close, open, volume, lead(close) over (partition by symbol order by date) / close - 1 as ret,
        case when count(lr) over w = 6 then stddev_samp(lr) over w end as signal from (select *, ln(close / lag(close) over (partition by symbol order by date)) as lr from xs_bars) window w as (partition by symbol order by date rows between 5 preceding and current row)),
    panel as (select *, (row_number() over (partition by month order by round(signal, 9), symbol) - 1) * 10 // count(*) over (partition by month) + 1 as decile from px where signal is not null and ret is not null)"""
_PORT = """pm as (select month, decile, count(*) as names, avg(ret) as ret from panel group by 1, 2),
    port as (select month, cast(decile as integer) as decile, names, ret from pm union all select t.month, 0, t.names + b.names, t.ret - b.ret from pm t join pm b on b.month = t.month and b.decile = 1 where t.decile = 10)"""
_SUMMARY = """count(v) as months, round(avg(v), 6) + 0.0 as mean, round(stddev_samp(v), 6) as std, round(avg(v) / nullif(stddev_samp(v), 0) * sqrt(count(v)), 5) + 0.0 as t_stat, round(min(v), 6) + 0.0 as min, round(max(v), 6) + 0.0 as max,
    round(avg(v) / nullif(stddev_samp(v), 0), 6) + 0.0 as sharpe, round(case when min(1 + v) > 0 then pow(avg(case when 1 + v > 0 then pow(1 + v, -2.0) end), -0.5) - 1 end, 5) + 0.0 as ce_gamma3, round(case when min(1 + v) > 0 then pow(avg(case when 1 + v > 0 then pow(1 + v, -6.0) end), -1.0 / 6) - 1 end, 5) + 0.0 as ce_gamma7"""


def stock_panel(r: Roles):
    """Months of a trailing-volatility signal and the next month's return."""
    w = by("symbol")
    rows = r.xs_bars.withColumn("lr", vol.log_return())
    frame = w.rowsBetween(-5, 0)
    rows = rows.select(F.col("date").alias("month"), "symbol", "close", "open", "volume", (F.lead("close").over(w) / F.col("close") - 1).alias("ret"), F.when(F.count("lr").over(frame) == 6, F.stddev_samp("lr").over(frame)).alias("signal"))
    rows = rows.filter("signal is not null and ret is not null").withColumn("_s", F.round("signal", 9))
    return rows.withColumn("decile", bucket("_s", ["month"], 10)).drop("_s")


def summarized(df, digits: int = 6):
    """Summary columns rounded as the oracles do."""
    fewer = {"t_stat", "ce_gamma3", "ce_gamma7"}
    return df.select(*(r6(c, 5 if c in fewer else digits) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(with_roles("xs_bars", f"""{_PANEL}, {_PORT} select case decile when 0 then '10-1' else cast(decile as varchar) end as decile, 'ret' as strategy, {_SUMMARY.replace('v)', 'ret)').replace('(v', '(ret').replace('1 + v', '1 + ret')} from port group by 1"""))
def decile_table_trailing_vol(r: Roles):
    return summarized(reports.returns_table(reports.portfolio_returns(stock_panel(r), ["ret"]), ["ret"]))


@query(with_roles("xs_bars", f"{_PANEL}, {_PORT} select month, decile, names, round(ret, 6) + 0.0 as ret from port"))
def a4_decile_portfolios(r: Roles):
    return rounded(reports.portfolio_returns(stock_panel(r), ["ret"]))


@query(with_roles("xs_bars", f"""{_PANEL}, m as (select month, decile, count(*) as names, avg(signal) as signal, avg(close) as close, avg(volume) as volume from panel group by 1, 2)
    select cast(decile as integer) as decile, round(avg(names), 6) as names, round(avg(signal), 6) as signal, round(avg(close), 4) as close, round(avg(volume), 4) as volume from m group by 1"""))
def a6_formation_table(r: Roles):
    out = reports.two_stage_mean(stock_panel(r), "decile", "month", ["signal", "close", "volume"])
    return out.select("decile", r6("names"), r6("signal"), r6("close", 4), r6("volume", 4))


@query(with_roles("xs_bars", f"{_PANEL}, {_PORT} select cast(year(month) as integer) as year, round(avg(ret), 6) + 0.0 as spread, count(*) as months from port where decile = 0 group by 1"))
def a10_annual_means(r: Roles):
    port = reports.portfolio_returns(stock_panel(r), ["ret"]).filter("decile = 0")
    return rounded(port.groupBy(F.year("month").alias("year")).agg(F.avg("ret").alias("spread"), F.count("*").alias("months")))


@query(with_roles("xs_bars", f"{_PANEL} select month, count(*) as rows, count(distinct symbol) as symbols from panel group by 1"))
def a11_coverage(r: Roles):
    return stock_panel(r).groupBy("month").agg(F.count("*").alias("rows"), F.count_distinct("symbol").alias("symbols"))


@query(with_roles("xs_bars", f"""{_PANEL}, v as (select month, symbol, ret, 'low_vol' as variant, -round(signal, 9) as score from panel union all select month, symbol, ret, 'volume', volume from panel union all select month, symbol, ret, 'late', close from panel where month >= date '1998-01-01'),
    d as (select *, (row_number() over (partition by variant, month order by score, symbol) - 1) * 10 // count(*) over (partition by variant, month) + 1 as d from v), m as (select variant, month, d, avg(ret) as ret from d group by 1, 2, 3),
    s as (select t.variant, t.ret - b.ret as v from m t join m b on b.variant = t.variant and b.month = t.month and b.d = 1 where t.d = 10) select variant, {_SUMMARY} from s group by 1"""))
def a9_b10_variants(r: Roles):
    rows = reports.variants(stock_panel(r), {"low_vol": -F.round("signal", 9), "volume": F.col("volume").cast("double"), "late": F.col("close")}, {"late": F.col("month") >= "1998-01-01"})
    return summarized(reports.sort_variants(rows, "ret"))


@query(with_roles("xs_bars sectors", """w as (select date, round(sum(close * volume) / sum(volume), 6) as ret from xs_bars group by 1), s as (select date, sector, round(sum(close * volume) / sum(volume), 6) as ret from xs_bars join sectors using (symbol) group by 1, 2) select date, 'MKT' as factor, ret from w union all select date, sector, ret from s"""))
def a2_weighted_means(r: Roles):
    rows = r.xs_bars
    mkt = risk.weighted_mean(rows, ["date"], "close", "volume").withColumn("factor", F.lit("MKT"))
    sec = risk.weighted_mean(rows.join(r.sectors, "symbol"), ["date", "sector"], "close", "volume").withColumnRenamed("sector", "factor")
    return rounded(mkt.unionByName(sec))


@query(with_roles("chain", """select symbol, date, round(quantile_cont(strike + delta, 0.5), 9) as median_spot, max_by(strike + delta, (expiration, strike, "right")) as last_spot from chain group by 1, 2"""))
def a1_daily_spot(r: Roles):
    spot = F.col("strike") + F.col("delta")
    return r.chain.groupBy("symbol", "date").agg(F.round(F.percentile(spot, F.lit(0.5)), 9).alias("median_spot"), F.max_by(spot, F.struct("expiration", "strike", "right")).alias("last_spot"))


@query(with_roles("ticks actions", """o as (select symbol, date, close, case when cast(symbol as integer) % 3 = 0 then close * (1 + day(date) % 2 * 0.03) else close end as other from ticks),
    p as (select symbol, date, close / lag(close) over w - 1 as a, other / lag(other) over w - 1 as b from o where close <> 0 window w as (partition by symbol order by date)),
    j as (select p.*, abs(a - b) as diff, s.symbol is not null as act from p left join (select distinct symbol, date from actions where action = 'split') s using (symbol, date)),
    g as (select cast(year(date) as integer) as year, symbol, count(*) as overlap_days, corr(a, b) as c, quantile_cont(diff, 0.5) as m, count(*) filter (diff > 0.01 and act) as action_gap_days from j group by 1, 2)
    select year, symbol, overlap_days, round(case when isnan(c) then null else c end, 5) + 0.0 as return_correlation, round(m, 6) + 0.0 as median_gap, action_gap_days, case when overlap_days < 15 then 'short' when action_gap_days > 0 then 'action_gap' when coalesce(c, 0.0) < 0.95 then 'mismatch' when m > 0.01 then 'drift' else 'ok' end as status from g"""))
def a12_symbology_verdict(r: Roles):
    ours = r.ticks.filter("close <> 0")
    theirs = ours.withColumn("close", F.when(F.col("symbol").cast("int") % 3 == 0, F.col("close") * (1 + F.dayofmonth("date") % 2 * 0.03)).otherwise(F.col("close")))
    out = reports.symbology_verdict(ours, theirs, r.actions.filter("action = 'split'"), 15)
    return out.withColumns({"return_correlation": F.round("return_correlation", 5) + 0.0, "median_gap": F.round("median_gap", 6) + 0.0})


@query(with_roles("xs_bars", f"""{_PANEL}, t as (select *, quantile_cont(signal, 0.5) over () as med from panel), s as (select ret, signal, unnest([case when signal > med then 'high_vol' end, case when month(month) = 1 then 'january' end, 'all']) as state from t)
    select state, count(*) as n, round(avg(ret), 6) + 0.0 as ret, round(avg(signal), 6) as signal from s where state is not null group by 1"""))
def a15_state_table(r: Roles):
    rows = stock_panel(r)
    median = quantiles(rows, [], "signal", {"med": 0.5})
    states = F.array(F.when(F.col("signal") > F.col("med"), "high_vol"), F.when(F.month("month") == 1, "january"), F.lit("all"))
    return rounded(reports.state_table(rows.crossJoin(F.broadcast(median)), states, ["ret", "signal"]))


@query(with_roles("bars", "select count(*) as n, round(corr(close - open, high - open), 6) as correlation, round(avg((close - open) - (high - open)), 6) as mean_gap, round(avg(cast(sign(close - open) = sign(high - open) as integer)), 6) as sign_agreement from bars"))
def a16_validation(r: Roles):
    return rounded(reports.validation(r.bars.select((F.col("close") - F.col("open")).alias("a"), (F.col("high") - F.col("open")).alias("b")), "a", "b"))


@query(with_roles("bars", """l as (select close as actual, unnest(['open', 'high', 'low']) as predictor, unnest([open, high, low]) as value from bars),
    k as (select *, rank() over (partition by predictor order by actual) + (count(*) over (partition by predictor, actual) - 1) / 2 as ra, rank() over (partition by predictor order by value) + (count(*) over (partition by predictor, value) - 1) / 2 as rb from l)
    select predictor, count(*) as n, round(corr(ra, rb), 6) as spearman, round(avg(ln(value) - ln(actual)), 6) + 0.0 as mean_log_error, round(sqrt(avg((ln(value) - ln(actual)) ** 2)), 6) as rms_log_error from k group by 1"""))
def a17_forecast_quality(r: Roles):
    return rounded(reports.forecast_quality(r.bars.select(F.col("close").alias("actual"), "open", "high", "low"), "actual", ["open", "high", "low"]))


@query(with_roles("xs_bars", "s as (select date, volume / sum(volume) over (partition by date) as s from xs_bars) select date, round(1 / sum(s * s), 6) as effective_names from s group by 1"))
def a20_effective_names(r: Roles):
    return rounded(reports.effective_names(r.xs_bars, "volume"))


@query(with_roles("xs_bars", f"""{_PANEL}, q as (select month, avg(ret) as ret, avg(signal) as level from panel group by 1), p as (select q.*, u.rule, u.position from q cross join lateral (values ('always', 1.0), ('high_only', case when level > 0.95 then 1.0 else 0.0 end), ('flip', case when level > 0.95 then 1.0 else -1.0 end)) u(rule, position)),
    s as (select rule, f as fraction, position * ret - case when position <> 0 then f * 0.01 else 0 end as v from p cross join (values (0.0::double), (0.5::double)) x(f)) select rule, fraction, {_SUMMARY} from s group by 1, 2"""))
def b8_timing_rules(r: Roles):
    months = stock_panel(r).groupBy("month").agg(F.avg("ret").alias("ret"), F.avg("signal").alias("level")).withColumn("cost", F.lit(0.01))
    high = F.col("level") > 0.95
    return summarized(reports.timing_rules(months, {"always": F.lit(1.0), "high_only": F.when(high, 1.0).otherwise(0.0), "flip": F.when(high, 1.0).otherwise(-1.0)}, (0.0, 0.5)))


# ---- option panels ---------------------------------------------------------------------------------------------

_OPT = """w as (select date, symbol, expiration, strike, max(case when "right" = 'C' then bid end) as call_bid, max(case when "right" = 'C' then ask end) as call_ask, max(case when "right" = 'C' then delta end) as call_delta,
        max(case when "right" = 'P' then bid end) as put_bid, max(case when "right" = 'P' then ask end) as put_ask, max(case when "right" = 'P' then delta end) as put_delta, avg(iv) as iv, count(distinct "right") as n from chain group by 1, 2, 3, 4),
    pick as (select *, row_number() over (partition by date, symbol order by expiration, abs(strike - 100), strike) as k from w where n = 2 and expiration - date >= 20),
    spots as (select date as expiration, symbol, 100 * avg(iv) / 0.15 as spot_at_expiry from chain group by 1, 2),
    opt as (select date as month, symbol, strike, call_bid, call_ask, call_delta, put_bid, put_ask, put_delta, (call_bid + call_ask) / 2 as call_mid, (put_bid + put_ask) / 2 as put_mid, 100.0 as spot_entry, spot_at_expiry,
        greatest(spot_at_expiry - strike, 0) as call_payoff, greatest(strike - spot_at_expiry, 0) as put_payoff, iv as signal, date as entry_day, expiration, 1 + (row_number() over (partition by date order by round(iv, 9), symbol) - 1) * 2 // count(*) over (partition by date) as decile from pick join spots using (expiration, symbol) where k = 1)"""


def option_panel(r: Roles):
    """One straddle a name and week with its payoff; two buckets by IV."""
    wide = pivot_sides(r.chain, ["date", "symbol", "expiration", "strike"], ["bid", "ask", "delta"])
    ivs = r.chain.groupBy("date", "symbol", "expiration", "strike").agg(F.avg("iv").alias("signal"))
    rows = wide.join(ivs, ["date", "symbol", "expiration", "strike"]).filter("call_bid is not null and put_bid is not null and datediff(expiration, date) >= 20")
    rows = panels.first_by(rows, ["date", "symbol"], [F.col("expiration"), F.abs(F.col("strike") - 100), F.col("strike")])
    spots = r.chain.groupBy(F.col("date").alias("expiration"), "symbol").agg((100 * F.avg("iv") / 0.15).alias("spot_at_expiry"))
    rows = rows.join(spots, ["expiration", "symbol"]).withColumns({
        "month": F.col("date"), "entry_day": F.col("date"), "call_mid": (F.col("call_bid") + F.col("call_ask")) / 2, "put_mid": (F.col("put_bid") + F.col("put_ask")) / 2, "spot_entry": F.lit(100.0),
        "call_payoff": F.greatest(F.col("spot_at_expiry") - F.col("strike"), F.lit(0.0)), "put_payoff": F.greatest(F.col("strike") - F.col("spot_at_expiry"), F.lit(0.0)), "_s": F.round("signal", 9),
    })
    return rows.withColumn("decile", bucket("_s", ["month"], 2)).drop("_s", "date")


@query(with_roles("chain", f"""{_OPT} select month, symbol, round((call_payoff + put_payoff) / (call_mid + put_mid) - 1, 8) + 0.0 as straddle, round((call_payoff - call_mid - call_delta * (spot_at_expiry - spot_entry)) / abs(call_delta * spot_entry - call_mid), 8) + 0.0 as call_hedged,
    round((put_payoff - put_mid - put_delta * (spot_at_expiry - spot_entry)) / abs(put_mid - put_delta * spot_entry), 8) + 0.0 as put_hedged, round(call_payoff / call_mid - 1, 8) + 0.0 as call_naked, round(put_payoff / put_mid - 1, 8) + 0.0 as put_naked, round(spot_at_expiry / spot_entry - 1, 8) + 0.0 as stock from opt"""))
def b1_hold_to_expiry(r: Roles):
    out = pnl.hold_to_expiry(option_panel(r))
    return out.select("month", "symbol", *(r6(c, 8) for c in ("straddle", "call_hedged", "put_hedged", "call_naked", "put_naked", "stock")))


@query(with_roles("chain", f"""{_OPT}, z as (select month, symbol, -put_delta * call_mid / (call_delta * put_mid - put_delta * call_mid) as w, call_payoff / call_mid - 1 as c, put_payoff / put_mid - 1 as p from opt) select month, symbol, round(w * c + (1 - w) * p, 5) + 0.0 as zero_delta from z"""))
def b2_zero_delta(r: Roles):
    return pnl.zero_delta_straddle(option_panel(r)).select("month", "symbol", r6("zero_delta", 5))


_LEGS = """f as (select x.f::double as f, opt.* from opt cross join (values (0.0), (0.5), (1.0)) x(f)),
    lg as (select f, month, avg((call_payoff + put_payoff) / (call_mid + f * (call_ask - call_bid) / 2 + put_mid + f * (put_ask - put_bid) / 2) - 1) as long from f where decile = 2 group by 1, 2),
    sh as (select f, month, avg((call_payoff + put_payoff) / (call_mid - f * (call_ask - call_bid) / 2 + put_mid - f * (put_ask - put_bid) / 2) - 1) as short from f where decile = 1 group by 1, 2),
    l3 as (select f, unnest(['long', 'short', 'long_short']) as leg, unnest([long, short, long - short]) as v from lg join sh using (f, month))"""


@query(with_roles("chain", f"{_OPT}, {_LEGS} select f as effective_spread, leg, count(v) as months, round(avg(v), 5) + 0.0 as mean, round(stddev_samp(v), 5) as std, round(avg(v) / nullif(stddev_samp(v), 0) * sqrt(count(v)), 4) + 0.0 as t_stat from l3 group by 1, 2"))
def a7_cost_table(r: Roles):
    out = reports.cost_table(option_panel(r), (0.0, 0.5, 1.0), top=2)
    return out.select("effective_spread", "leg", "months", r6("mean", 5), r6("std", 5), r6("t_stat", 4))


@query(with_roles("chain", f"""{_OPT}, s as (select *, (call_ask - call_bid + put_ask - put_bid) / (call_mid + put_mid) as sp from opt), h as (select *, case when sp <= quantile_cont(sp, 0.5) over (partition by month) then 'liquid' else 'illiquid' end as liquidity from s)
    select liquidity, count(*) as n, round(avg((call_payoff + put_payoff) / (call_mid + put_mid) - 1), 5) + 0.0 as straddle from h group by 1"""))
def a8_liquidity_halves(r: Roles):
    rows = option_panel(r)
    out = reports.liquidity_halves(pnl.hold_to_expiry(rows))
    return out.groupBy("liquidity").agg(F.count("*").alias("n"), (F.round(F.avg("straddle"), 5) + 0.0).alias("straddle"))


_PATHS = """held as (select symbol, expiration, strike, min(date) as month from chain group by 1, 2, 3),
    ms as (select date, symbol, expiration, strike, sum((bid + ask) / 2) as m, sum(delta) as d, 100 * (1 + avg(iv)) as spot from chain group by 1, 2, 3, 4 having count(*) = 2),
    pa as (select h.symbol, h.month || '/' || h.expiration || '/' || cast(h.strike as integer) as month, ms.date, ms.m, ms.d, ms.spot from held h join ms using (symbol, expiration, strike) where ms.date between h.month and h.expiration)"""


@query(with_roles("chain", f"""{_PATHS}, l as (select *, -(m - lag(m) over w) as o, lag(d) over w * (spot - lag(spot) over w) as hd from pa window w as (partition by symbol, month order by date))
    select symbol, month, round(sum(o), 5) + 0.0 as option_pnl, round(sum(hd), 5) + 0.0 as hedge_pnl, count(*) as n_days from l group by 1, 2"""))
def b3_daily_hedge(r: Roles):
    at = r.chain
    held = at.groupBy("symbol", "expiration", "strike").agg(F.min("date").alias("first"))
    marks = at.groupBy("date", "symbol", "expiration", "strike").agg(F.sum((F.col("bid") + F.col("ask")) / 2).alias("straddle_mid"), F.sum("delta").alias("net_delta"), (100 * (1 + F.avg("iv"))).alias("spot"), F.count("*").alias("n")).filter("n = 2")
    paths = held.join(marks, ["symbol", "expiration", "strike"]).filter(F.col("date").between(F.col("first"), F.col("expiration")))
    paths = paths.withColumn("month", F.concat_ws("/", F.col("first").cast("string"), F.col("expiration").cast("string"), F.col("strike").cast("int").cast("string")))
    return rounded(pnl.daily_hedge(paths), 5)


@query(with_roles("bars chain", """h as (select distinct symbol, date as entry_day, expiration from chain), rr as (select symbol, date, ln(close / lag(close) over (partition by symbol order by date)) as r from bars)
    select h.symbol, h.entry_day, h.expiration, round(coalesce(sum(r * r), 0) * 252 / greatest(count(r), 1), 5) as realized_var, count(r) as n_days from h left join rr on rr.symbol = h.symbol and rr.date > h.entry_day and rr.date <= h.expiration group by 1, 2, 3"""))
def b4_realized_over_hold(r: Roles):
    returns = r.bars.select("symbol", "date", vol.log_return().alias("r"))
    return rounded(pnl.realized_over_hold(r.chain.select("symbol", F.col("date").alias("entry_day"), "expiration").distinct(), returns), 5)


# ---- surfaces and jumps ----------------------------------------------------------------------------------------


def _tenor(t: int) -> str:
    return f"""case when max(case when dte <= {t} then dte end) is not null and max(case when dte >= {t} then dte end) is not null then sqrt((arg_max(iv * iv * dte, dte) filter (dte <= {t})
        + case when min(dte) filter (dte >= {t}) = max(dte) filter (dte <= {t}) then 0 else ({t} - max(dte) filter (dte <= {t})) / (min(dte) filter (dte >= {t}) - max(dte) filter (dte <= {t}))
        * ((arg_min(iv * iv * dte, dte) filter (dte >= {t})) - (arg_max(iv * iv * dte, dte) filter (dte <= {t}))) end) / {t}) end"""


@query(with_roles("chain", f"{_PILLARS}, c as (select date, symbol, dte, avg(atm_iv) as iv from pillars group by 1, 2, 3) select date, symbol, round({_tenor(30)}, 6) as iv30, round({_tenor(60)}, 6) as iv60 from c group by 1, 2"))
def m1_constant_maturity(r: Roles):
    return rounded(surface.constant_maturity(surface.atm_pillars(r.chain), (30, 60)))


_JUMP = _PILLARS + """, ne as (select d.date, d.symbol, (select min(e.date) from announcements e where e.symbol = d.symbol and e.date >= d.date) as next_event from (select distinct date, symbol from pillars) d),
    x as (select p.*, atm_iv * atm_iv * dte / 365 as w, next_event from pillars p join ne using (date, symbol)),
    en as (select date, symbol, max(dte) filter (expiration < next_event) as tb, arg_max(w, dte) filter (expiration < next_event) as wb, min(dte) filter (expiration >= next_event) as ta, arg_min(w, dte) filter (expiration >= next_event) as wa from x group by 1, 2),
    tm as (select ne.*, case when ta - tb <= 90 then greatest(wa - wb / tb * ta, 0) end as term from ne left join en using (date, symbol)),
    hs as (select *, case when count(term) over w >= 20 then quantile_cont(term, 0.5) over w end as hist from tm window w as (partition by symbol order by date rows between 250 preceding and 1 preceding)),
    jumps as (select date, symbol, next_event, cast(next_event - date as integer) as days_to_event, coalesce(term, hist) as jump_var, case when next_event is null then 'none' when term is not null then 'term' when hist is not null then 'history' else 'none' end as method from hs)"""


@query(with_roles("chain announcements", f"{_JUMP} select date, symbol, next_event, days_to_event, round(jump_var, 7) + 0.0 as jump_var, method from jumps"))
def m4_jump_variance(r: Roles):
    out = surface.jump_variance(surface.atm_pillars(r.chain), r.announcements.withColumnRenamed("date", "event_session"))
    return rounded(out, 7)


@query(with_roles("chain announcements", f"""{_JUMP}, n as (select p.*, (select count(*) from announcements e where e.symbol = p.symbol and e.date > p.date and e.date <= p.expiration) as n_events from pillars p)
    select date, symbol, expiration, dte, round(sqrt(greatest(atm_iv * atm_iv - n_events * coalesce(jump_var, 0) * 365.0 / dte, atm_iv * atm_iv * 0.25)), 8) as atm_iv from n left join jumps using (date, symbol)"""))
def m5_adjusted_pillars(r: Roles):
    events = r.announcements.withColumnRenamed("date", "event_session")
    pillars = surface.atm_pillars(r.chain)
    out = surface.adjust_pillars(pillars, events, surface.jump_variance(pillars, events))
    return out.select("date", "symbol", "expiration", "dte", r6("atm_iv", 8))


@query(with_roles("chain announcements", f"""{_JUMP}, n as (select p.*, (select count(*) from announcements e where e.symbol = p.symbol and e.date > p.date and e.date <= p.expiration) as n_events from pillars p),
    c as (select date, symbol, dte, avg(sqrt(greatest(atm_iv * atm_iv - n_events * coalesce(jump_var, 0) * 365.0 / dte, atm_iv * atm_iv * 0.25))) as iv from n left join jumps using (date, symbol) group by 1, 2, 3),
    s as (select date, symbol, {_tenor(30)} as iv30, {_tenor(60)} as iv60 from c group by 1, 2)
    select s.date, s.symbol, round(iv30, 8) as iv30, round(iv60, 8) as iv60, next_event, days_to_event, round(jump_var, 8) + 0.0 as jump_var, method from s left join jumps on jumps.date = s.date and jumps.symbol = s.symbol"""))
def b23_adjusted_surface(r: Roles):
    return rounded(surface.adjusted_surface(surface.atm_pillars(r.chain), r.announcements.withColumnRenamed("date", "event_session"), (30, 60)), 8)


_BS = """g as (select date, symbol, expiration, strike, "right", underlying as s, strike as k, datediff('day', date, expiration) / 365.0::double as t, iv as v from chain),
    h as (select *, (ln(s / k) + v * v / 2 * t) / (v * sqrt(t)) as a, (ln(s / k) + v * v / 2 * t) / (v * sqrt(t)) - v * sqrt(t) as b from g),
    tt as (select *, 1 / (1 + 0.2316419 * abs(a)) as ta, 1 / (1 + 0.2316419 * abs(b)) as tb, exp(-a * a / 2) / sqrt(2 * pi()) as pa, exp(-b * b / 2) / sqrt(2 * pi()) as pb from h),
    u as (select *, pa * ta * (0.319381530 + ta * (-0.356563782 + ta * (1.781477937 + ta * (-1.821255978 + ta * 1.330274429)))) as ua, pb * tb * (0.319381530 + tb * (-0.356563782 + tb * (1.781477937 + tb * (-1.821255978 + tb * 1.330274429)))) as ub from tt),
    n as (select *, case when a >= 0 then 1 - ua else ua end as na, case when b >= 0 then 1 - ub else ub end as nb from u)"""


@query(with_roles("chain", f"""{_BS} select date, symbol, expiration, strike, "right", round(case when "right" = 'C' then s * na - k * nb else s * na - k * nb - s + k end, 5) + 0.0 as price, round(case when "right" = 'C' then na else na - 1 end, 6) + 0.0 as delta,
    round(pa / (s * v * sqrt(t)), 6) as gamma, round(s * pa * sqrt(t) / 100, 6) as vega, round(-s * pa * v / (2 * sqrt(t)) / 365, 6) + 0.0 as theta from n"""))
def m2_black_scholes(r: Roles):
    """Prices and greeks of every contract of the chain at its own IV."""
    rows = r.chain.withColumns({"years": F.datediff("expiration", "date") / 365.0, "is_call": F.col("right") == "C"})
    out = pricing.with_greeks(rows.drop("delta"), "underlying", "strike", "years", "iv", "is_call")
    return out.select("date", "symbol", "expiration", "strike", "right", r6("price", 5), *(r6(c) for c in ("delta", "gamma", "vega", "theta")))


@query(with_roles("chain", f"""{_BS} select date, symbol, expiration, strike, "right", case when abs(k / s - 1) <= 0.1 then round(v, 4) end as iv, round(case when "right" = 'C' then s * na - k * nb else s * na - k * nb - s + k end, 4) + 0.0 as price from n"""))
def m3_implied_vol_round_trip(r: Roles):
    """IVs found again from prices, and the prices that they give; far from the money, where many IVs give one price, only the price is compared."""
    rows = r.chain.withColumns({"years": F.datediff("expiration", "date") / 365.0, "is_call": F.col("right") == "C"})
    rows = pricing.with_greeks(rows.drop("delta"), "underlying", "strike", "years", "iv", "is_call")
    rows = rows.withColumn("found", pricing.implied_vol("price", "underlying", "strike", "years", "is_call", F.lit(0.0))).drop("price", "delta", "gamma", "vega", "theta")
    again = pricing.with_greeks(rows, "underlying", "strike", "years", "found", "is_call")
    worth = F.greatest(F.when(F.col("is_call"), F.col("underlying") - F.col("strike")).otherwise(F.col("strike") - F.col("underlying")), F.lit(0.0))
    near = F.abs(F.col("strike") / F.col("underlying") - 1) <= 0.1
    return again.select("date", "symbol", "expiration", "strike", "right", F.when(near, F.round("found", 4)).alias("iv"), r6(F.coalesce("price", worth), 4).alias("price"))


_BUMPED = _BS.replace("iv as v from chain", "iv + bump as v, bump from chain cross join (values (0.0::double), (0.01::double)) b(bump)")


@query(with_roles("chain", f"""{_BUMPED}, p as (select date, symbol, expiration, strike, "right", bump, case when "right" = 'C' then s * na - k * nb else s * na - k * nb - s + k end as price, s * pa * sqrt(t) / 100 as vega from n),
    m as (select max(case when bump = 0 then vega end) as vega, max(case when bump > 0 then price end) - max(case when bump = 0 then price end) as move from p group by date, symbol, expiration, strike, "right")
    select count(*) as n, round(avg(cast(abs(vega - move) < abs(vega / 100 - move) as double)), 3) as per_point_share, avg(cast(abs(vega - move) < abs(vega / 100 - move) as double)) >= 2.0 / 3 as per_point from m where vega >= 1e-6"""))
def a21_vega_convention(r: Roles):
    """Share of contracts whose vega, taken as of one point, reprices a one-point move better than taken as of a unit; two thirds decide."""
    rows = r.chain.withColumns({"years": F.datediff("expiration", "date") / 365.0, "is_call": F.col("right") == "C", "up": F.col("iv") + 0.01}).drop("delta")
    rows = pricing.with_greeks(rows, "underlying", "strike", "years", "iv", "is_call").withColumnRenamed("price", "before").drop("delta", "gamma", "theta")
    rows = pricing.with_greeks(rows.withColumnRenamed("vega", "own_vega"), "underlying", "strike", "years", "up", "is_call")
    return rounded(pricing.vega_convention(rows.select("own_vega", (F.col("price") - F.col("before")).alias("move")), "own_vega", "move"), 3)
