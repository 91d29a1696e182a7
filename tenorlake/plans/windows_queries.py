"""Queries of the window operators (R) and ranks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.windows import ahead, average_rank, bucket, by, clip, fill_forward, quantiles, rolling, zscore
from ..operators import vol
from ..operators.corporate import split_factors
from ..operators.rolling import rolling_quantile
from ..operators.signals import past_return_signal, time_series_zscore
from ..sources.roles import Roles, with_roles
from .registry import query, rounded

LOGRET = "rets as (select *, ln(close / lag(close) over (partition by symbol order by date)) as r from bars)"


@query(with_roles("xs_bars", """select date, symbol,
    cast((row_number() over (partition by date order by close, symbol) - 1) * 10 // count(*) over (partition by date) + 1 as integer) as d_floor,
    cast(least(10, greatest(1, ceil(row_number() over (partition by date order by close, symbol) * 10 / count(*) over (partition by date)))) as integer) as d_ceil,
    cast(least(10, greatest(1, ceil((rank() over (partition by date order by close) + (count(*) over (partition by date, close) - 1) / 2) * 10 / count(*) over (partition by date)))) as integer) as d_average
    from xs_bars"""))
def r1_deciles(r: Roles):
    return r.xs_bars.select("date", "symbol", *(bucket("close", ["date"], 10, m).alias(f"d_{m}") for m in ("floor", "ceil", "average")))


@query(with_roles("ticks actions", """splits as (select symbol, date, max(value) as ratio from actions where action = 'split' group by all)
    select symbol, date, round(close * coalesce(ratio, 1.0) / lag(close) over (partition by symbol order by date) - 1, 6) + 0.0 as ret
    from ticks left join splits using (symbol, date)"""))
def r2_split_adjusted_return(r: Roles):
    splits = r.actions.filter("action = 'split'").groupBy("symbol", "date").agg(F.max("value").alias("ratio"))
    rows = r.ticks.join(splits, ["symbol", "date"], "left").withColumn("ratio", F.coalesce("ratio", F.lit(1.0)))
    return rounded(rows.select("symbol", "date", vol.split_adjusted_return("close", "ratio").alias("ret")))


@query(with_roles("bars", f"""{LOGRET} select date, symbol, round(case when count(r) over w >= 20 then stddev_samp(r) over w * sqrt(252) end, 6) as hv
    from rets window w as (partition by symbol order by date rows between 19 preceding and current row)"""))
def r3_close_to_close_vol(r: Roles):
    return rounded(vol.realized_volatility(r.bars, 20).select("date", "symbol", "hv"))


def _yz(n: int, frame: str) -> str:
    k = vol.yang_zhang_weight(n)
    guard = f"count(overnight) over {frame} = {n}"
    return f"sqrt(252 * case when {guard} then var_samp(overnight) over {frame} + {k} * var_samp(dayret) over {frame} + {1 - k} * avg(rng) over {frame} end)"


_YZ = """parts as (select date, symbol, ln(open / lag(close) over (partition by symbol order by date)) as overnight, ln(close / open) as dayret,
    ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) as rng from bars where close >= 1.0)"""
_YZ_WINDOWS = """window w5 as (partition by symbol order by date rows between 4 preceding and current row), w22 as (partition by symbol order by date rows between 21 preceding and current row),
    f60 as (partition by symbol order by date rows between 1 following and 60 following)"""


@query(with_roles("bars", f"""{_YZ} select date, symbol, round(sqrt(252 * (overnight * overnight + rng)), 6) as rv_1, round({_yz(5, 'w5')}, 6) as rv_5, round({_yz(22, 'w22')}, 6) as rv_22 from parts {_YZ_WINDOWS}"""))
def r4_yang_zhang(r: Roles):
    return rounded(vol.yang_zhang_panel(r.bars).drop("rv_fwd"))


@query(with_roles("bars", f"{_YZ} select date, symbol, round({_yz(60, 'f60')}, 6) as rv_fwd from parts {_YZ_WINDOWS}"))
def r5_forward_vol(r: Roles):
    return rounded(vol.yang_zhang_panel(r.bars).select("date", "symbol", "rv_fwd"))


@query(with_roles("bars announcements", """sq as (select date, symbol, ln(close / lag(close) over (partition by symbol order by date)) ** 2 as s from bars where close >= 1.0),
    ex as (select sq.date, sq.symbol, case when a.symbol is null then s end as s from sq left join (select distinct date, symbol from announcements) a using (date, symbol))
    select date, symbol, round(sqrt(252 * s), 6) as rv_1, round(sqrt(252 * case when count(*) over w5 = 5 and count(s) over w5 > 0 then coalesce(sum(s) over w5, 0) / count(s) over w5 end), 6) as rv_5,
    round(sqrt(252 * case when count(*) over f10 = 10 and count(s) over f10 > 0 then coalesce(sum(s) over f10, 0) / count(s) over f10 end), 6) as rv_fwd
    from ex window w5 as (partition by symbol order by date rows between 4 preceding and current row), f10 as (partition by symbol order by date rows between 1 following and 10 following)"""))
def r6_close_to_close_excluding(r: Roles):
    return rounded(vol.close_to_close_panel(r.bars, (1, 5), 10, r.announcements.select("date", "symbol")))


@query(with_roles("bars", """rets as (select *, ln(close / lag(close) over (partition by symbol order by date)) as ret from bars),
    mk as (select date, avg(ret) as m from rets group by date),
    j as (select date, symbol, ret, close, volume, case when m is not null then ret end as p, case when ret is not null then m end as m, m as mm from rets left join mk using (date)),
    a as (select *, case when count(p) over w >= 60 then covar_samp(p, m) over w / var_samp(m) over w end as beta,
        case when count(ret) over w >= 60 then stddev_samp(ret) over w end as sd, case when count(*) over w >= 60 then avg(ln(close * volume)) over w end as log_size
        from j window w as (partition by symbol order by date rows between 119 preceding and current row)),
    b as (select *, ret - beta * mm as resid, cast(abs(ret) > 2.0 * sd as integer) as g from a)
    select date, symbol, round(ret, 6) + 0.0 as ret, round(beta, 6) + 0.0 as beta, round(case when count(resid) over w >= 60 then stddev_samp(resid) over w * sqrt(252) end, 6) as idio_vol, round(log_size, 6) as log_size,
    round(case when count(g) over w >= 60 then avg(g) over w end, 6) as gap_freq
    from b window w as (partition by symbol order by date rows between 119 preceding and current row)"""))
def r7_stock_features(r: Roles):
    rets = r.bars.select("date", "symbol", vol.log_return().alias("x"))
    market = rets.groupBy("date").agg(F.avg("x").alias("market_return"))
    return rounded(vol.stock_features(r.bars, market, 120, 60, 2.0))


@query(with_roles("bars", """rets as (select date, symbol, close / lag(close) over (partition by symbol order by date) - 1 as r from bars),
    mk as (select date, avg(r) as market from rets group by date), j as (select date, symbol, r, market, case when r is not null then market end as m from rets join mk using (date))
    select date, symbol, round(market, 6) + 0.0 as market, round(case when count(r) over w >= 60 then sqrt(252 * greatest(0, var_samp(r) over w - (covar_samp(r, m) over w) ** 2 / var_samp(m) over w)) end, 2) as idio_vol
    from j window w as (partition by symbol order by date rows between 119 preceding and current row)"""))
def r8_one_factor_idio_vol(r: Roles):
    return vol.one_factor_idio_vol(r.bars, 120, 60).withColumns({"market": F.round("market", 6) + 0.0, "idio_vol": F.round("idio_vol", 2)})


@query(with_roles("bars", f"""{LOGRET} select date, symbol, round(case when count(r) over w >= 200 then stddev_samp(r) over w * sqrt(252) end, 6) as hv,
    round(case when count(r) over m = 21 then sum(r) over m end, 6) + 0.0 as return_1m from rets
    window w as (partition by symbol order by date rows between 251 preceding and current row), m as (partition by symbol order by date rows between 20 preceding and current row)"""))
def r9_trailing_vol_and_return(r: Roles):
    rows = vol.realized_volatility(r.bars, 252, 200).withColumn("r", vol.log_return())
    return rounded(rows.select("date", "symbol", "hv", rolling(F.sum, F.col("r"), by("symbol"), 21).alias("return_1m")))


@query(with_roles("bars announcements", """rets as (select b.date, b.symbol, ln(close / lag(close) over (partition by b.symbol order by b.date)) as r, a.symbol as e
        from bars b left join (select distinct date, symbol from announcements) a on a.date = b.date and a.symbol = b.symbol),
    calm as (select *, case when e is null and lag(e) over (partition by symbol order by date) is null then r end as c from rets)
    select date, symbol, round(case when count(r) over w >= 22 then stddev_samp(r) over w * sqrt(252) end, 6) as hv, round(case when count(c) over w >= 11 then stddev_samp(c) over w * sqrt(252) end, 6) as hv_ex
    from calm window w as (partition by symbol order by date rows between 21 preceding and current row)"""))
def r10_vol_without_events(r: Roles):
    return rounded(vol.hv_without_events(r.bars, r.announcements))


_IV = "ivs as (select date, symbol, avg(iv) as iv60 from chain group by date, symbol)"


@query(with_roles("chain", f"""{_IV}, s as (select *, count(*) over w as n, avg(ln(iv60)) over w as m, stddev_samp(ln(iv60)) over w as sd from ivs
        window w as (partition by symbol order by date rows between 249 preceding and current row))
    select date, symbol, round(greatest(-3, least(3, (ln(iv60) - m) / sd)), 5) + 0.0 as signal from s where n >= 120 and sd > 0"""))
def r11_time_series_zscore(r: Roles):
    surface = r.chain.groupBy("date", "symbol").agg(F.avg("iv").alias("iv60"))
    return rounded(time_series_zscore(surface, "iv60"), 5)


@query(with_roles("chain", f"""{_IV} select date, symbol, round(case when count(*) over w >= 26 then avg(iv60) over w end, 6) as mean_iv, round(case when count(*) over w >= 26 then (iv60 - avg(iv60) over w) / nullif(stddev_samp(iv60) over w, 0) end, 5) + 0.0 as z
    from ivs window w as (partition by symbol order by date rows between 51 preceding and current row)"""))
def r12_trailing_year_level(r: Roles):
    w = by("symbol")
    rows = r.chain.groupBy("date", "symbol").agg(F.avg("iv").alias("iv60"))
    mean, sd = (rolling(f, F.col("iv60"), w, 52, 26) for f in (F.avg, F.stddev_samp))
    return rows.select("date", "symbol", F.round(mean, 6).alias("mean_iv"), (F.round(F.try_divide(F.col("iv60") - mean, sd), 5) + 0.0).alias("z"))


@query(with_roles("xs_bars", """p as (select date, symbol, 100 * ln(close / lag(close) over (partition by symbol order by date)) as pnl from xs_bars),
    s as (select date, symbol, case when count(pnl) over w >= 6 then sum(pnl) over w end as past_return from p window w as (partition by symbol order by date rows between 12 preceding and 1 preceding)),
    c as (select *, count(*) over (partition by date) as n, avg(past_return) over (partition by date) as m, stddev_samp(past_return) over (partition by date) as sd from s where past_return is not null)
    select date, symbol, round(past_return, 5) + 0.0 as past_return, round(greatest(-3, least(3, -(past_return - m) / sd)), 5) + 0.0 as signal from c where n >= 50"""))
def r13_past_return_signal(r: Roles):
    pnl = r.xs_bars.select("date", "symbol", (100 * vol.log_return()).alias("pnl_per_vega"))
    return rounded(past_return_signal(pnl, window=12, skip=1), 5)


@query(with_roles("xs_bars", """p as (select date, symbol, close, 100 * ln(close / lag(close) over (partition by symbol order by date)) as pnl from xs_bars)
    select date, symbol, round(case when count(*) over f = 3 then sum(coalesce(pnl, 0)) over f end, 5) + 0.0 as gross_fwd, lead(close, 3) over (partition by symbol order by date) as close_at_horizon
    from p window f as (partition by symbol order by date rows between 1 following and 3 following)"""))
def r14_forward_sum(r: Roles):
    w = by("symbol")
    pnl = r.xs_bars.withColumn("pnl", F.coalesce(100 * vol.log_return(), F.lit(0.0)))
    return pnl.select("date", "symbol", (F.round(ahead(F.sum, F.col("pnl"), w, 3), 5) + 0.0).alias("gross_fwd"), F.lead("close", 3).over(w).alias("close_at_horizon"))


@query(with_roles("xs_bars", """s as (select date, symbol, avg(close) over (partition by symbol order by date rows between 4 preceding and current row) as smooth from xs_bars),
    z as (select *, avg(smooth) over (partition by date) as m, stddev_samp(smooth) over (partition by date) as sd from s)
    select date, symbol, round(greatest(-3, least(3, (smooth - m) / nullif(sd, 0))), 5) + 0.0 as signal from z"""))
def r15_smooth_then_zscore(r: Roles):
    rows = r.xs_bars.withColumn("smooth", rolling(F.avg, F.col("close"), by("symbol"), 5, 1))
    return rounded(rows.select("date", "symbol", clip(zscore("smooth", "date"), -3, 3).alias("signal")), 5)


@query(with_roles("xs_bars sectors", """select date, symbol, sector, round(avg(close) over (partition by date), 6) as market_mean, round(quantile_cont(close, 0.5) over (partition by date, sector), 9) as sector_median from xs_bars join sectors using (symbol)"""))
def r16_market_mean_sector_median(r: Roles):
    day, group = Window.partitionBy("date"), Window.partitionBy("date", "sector")
    return r.xs_bars.join(r.sectors, "symbol").select("date", "symbol", "sector", F.round(F.avg("close").over(day), 6).alias("market_mean"), F.round(F.percentile("close", F.lit(0.5)).over(group), 9).alias("sector_median"))


@query(with_roles("bars announcements", """e as (select a.symbol, a.date, abs(ln(close / open)) as move from announcements a join bars b on a.symbol = b.symbol and a.date = b.date)
    select symbol, date, round(case when count(move) over w = 4 then avg(move) over w end, 6) as history from e window w as (partition by symbol order by date rows between 4 preceding and 1 preceding)"""))
def r17_event_history(r: Roles):
    moves = r.announcements.join(r.bars, ["symbol", "date"]).withColumn("move", F.abs(F.ln(F.col("close") / F.col("open"))))
    return rounded(moves.select("symbol", "date", rolling(F.avg, F.col("move"), by("symbol"), 4, skip=1).alias("history")))


@query(with_roles("bars", f"""{LOGRET} select date, symbol, round(case when count(r) over w >= 20 then quantile_cont(r, 0.5) over w end, 6) + 0.0 as jump_history
    from rets window w as (partition by symbol order by date rows between 60 preceding and 1 preceding)"""))
def r18_lagged_median(r: Roles):
    rows = r.bars.withColumn("r", vol.log_return())
    return rounded(rolling_quantile(rows.select("date", "symbol", "r"), "r", "jump_history", 60, 20, skip=1).drop("r"))


@query(with_roles("bars", """i as (select *, last_value(case when volume % 3 = 0 then close end ignore nulls) over (partition by symbol order by date rows between unbounded preceding and current row) as inception from bars)
    select date, symbol, inception, lag(inception) over (partition by symbol order by date) as entry from i"""))
def r19_fill_forward_and_lag(r: Roles):
    w = by("symbol")
    rows = r.bars.withColumn("inception", fill_forward(F.when(F.col("volume") % 3 == 0, F.col("close")), w))
    return rows.select("date", "symbol", "inception", F.lag("inception").over(w).alias("entry"))


@query(with_roles("bars", f"""{LOGRET}, c as (select date, symbol, sum(r) over w as cum from rets window w as (partition by symbol order by date rows between unbounded preceding and current row)),
    p as (select *, max(cum) over (partition by symbol order by date rows between unbounded preceding and current row) as peak from c)
    select symbol, round(min(cum - peak), 6) + 0.0 as max_drawdown, round(max(peak), 6) + 0.0 as peak from p group by symbol"""))
def r20_drawdown(r: Roles):
    w = by("symbol").rowsBetween(Window.unboundedPreceding, 0)
    rows = r.bars.withColumn("r", vol.log_return()).withColumn("cum", F.sum("r").over(w)).withColumn("peak", F.max("cum").over(w))
    return rounded(rows.groupBy("symbol").agg(F.min(F.col("cum") - F.col("peak")).alias("max_drawdown"), F.max("peak").alias("peak")))


@query(with_roles("xs_bars", """select date, symbol, round((rank() over (partition by date order by close) + (count(*) over (partition by date, close) - 1) / 2) / count(*) over (partition by date)
    + (rank() over (partition by date order by volume) + (count(*) over (partition by date, volume) - 1) / 2) / count(*) over (partition by date), 6) as score from xs_bars"""))
def r21_rank_sum(r: Roles):
    n = F.count(F.lit(1)).over(Window.partitionBy("date"))
    return rounded(r.xs_bars.select("date", "symbol", (average_rank("close", "date") / n + average_rank("volume", "date") / n).alias("score")))


@query(with_roles("bars", "select date, symbol, abs(volume - coalesce(lag(volume) over (partition by symbol order by date), 0)) as traded from bars"))
def r22_position_change(r: Roles):
    return r.bars.select("date", "symbol", F.abs(F.col("volume") - F.coalesce(F.lag("volume").over(by("symbol")), F.lit(0))).alias("traded"))


@query(with_roles("ticks actions", """splits as (select symbol, date as ex, max(value) as ratio from actions where action = 'split' group by all)
    select t.symbol, t.date, round(coalesce(product(ratio), 1.0), 6) as factor from ticks t left join splits s on s.symbol = t.symbol and s.ex > t.date group by t.symbol, t.date"""))
def r23_back_adjustment(r: Roles):
    splits = r.actions.filter("action = 'split'").groupBy("symbol", "date").agg(F.max("value").alias("value"))
    return rounded(split_factors(r.ticks.select("symbol", "date"), splits))


@query(with_roles("bars", """select symbol, round(avg(close), 6) as mean_close, round(quantile_cont(close, 0.5), 9) as median_close,
    list_sort(list(close))[cast(round(0.25 * (count(close) - 1)) as integer) + 1] as q25_nearest, list_sort(list(close))[cast(round(0.75 * (count(close) - 1)) as integer) + 1] as q75_nearest,
    round(avg(cast(close > open as integer)), 6) as share_up from bars group by symbol"""))
def a14_distribution(r: Roles):
    c = F.col("close")
    means = r.bars.groupBy("symbol").agg(F.round(F.avg(c), 6).alias("mean_close"), F.round(F.percentile(c, F.lit(0.5)), 9).alias("median_close"), F.round(F.avg((c > F.col("open")).cast("int")), 6).alias("share_up"))
    return means.join(quantiles(r.bars, ["symbol"], "close", {"q25_nearest": 0.25, "q75_nearest": 0.75}, "nearest"), "symbol")
