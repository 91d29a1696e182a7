"""Queries of the models (M), signals, factor risk, books (B) and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pricing
from ..functions.windows import by
from ..operators import book_studies, calendar, har, pnl, reports, risk, signals, surface, vol
from ..operators.regress import ols_table, residuals_by
from ..sources.roles import Roles, with_roles
from ..sources.store import checkpointed
from .joins_queries import _EVENTS
from .panel_queries import _OPT, _PILLARS, option_panel
from .registry import query, r6, rounded

# ---- cross-section ---------------------------------------------------------------------------------------------

_XS = """xs as (select date, symbol, ln(close) as vrp, ln(open) as x1, ln(volume + 1) as x2 from xs_bars),
    mo as (select date, count(*) as n, avg(vrp) as my, avg(x1) as m1, avg(x2) as m2, covar_pop(x1, vrp) as d1, covar_pop(x2, vrp) as d2, var_pop(x1) as c11, var_pop(x2) as c22, covar_pop(x1, x2) as c12 from xs group by 1 having count(*) >= 50),
    co as (select *, (d1 * c22 - d2 * c12) / (c11 * c22 - c12 * c12) as b1, (d2 * c11 - d1 * c12) / (c11 * c22 - c12 * c12) as b2 from mo),
    res as (select date, symbol, vrp - (my + b1 * (x1 - m1) + b2 * (x2 - m2)) as residual from xs join co using (date))"""


def cross_section(r: Roles):
    return r.xs_bars.select("date", "symbol", F.ln("close").alias("vrp"), F.ln("open").alias("x1"), F.ln(F.col("volume") + 1).alias("x2"))


@query(with_roles("xs_bars", f"{_XS} select date, symbol, round(residual, 5) + 0.0 as residual from res"))
def m7_daily_residuals(r: Roles):
    return residuals_by(cross_section(r), "vrp", ["x1", "x2"], ["date"], 50).select("date", "symbol", r6("residual", 5))


@query(with_roles("xs_bars", f"""{_XS}, sm as (select *, avg(residual) over (partition by symbol order by date rows between 4 preceding and current row) as s from res), z as (select *, avg(s) over (partition by date) as m, stddev_samp(s) over (partition by date) as sd from sm)
    select date, symbol, round(greatest(-3, least(3, (s - m) / sd)), 4) + 0.0 as signal from z"""))
def m9_cross_sectional_signal(r: Roles):
    return signals.cross_sectional_signal(cross_section(r), ["x1", "x2"]).select("date", "symbol", r6("signal", 4))


@query(with_roles("xs_bars", f"{_XS} select date, round(corr(residual, x1), 5) + 0.0 as corr_x1, round(corr(residual, x2), 5) + 0.0 as corr_x2 from res join xs using (date, symbol) group by 1"))
def m9_factor_correlations(r: Roles):
    rows = residuals_by(cross_section(r), "vrp", ["x1", "x2"], ["date"], 50)
    return rounded(signals.correlations_by(rows, "residual", ["x1", "x2"], ["date"]), 5)


@query(with_roles("chain", """s as (select date, symbol, avg(iv) as iv60, 0.1 + 0.01 * avg(strike) / 100 as rv from chain group by 1, 2) select date, symbol, round(ln(iv60) - ln(rv), 6) + 0.0 as vrp from s where iv60 > 0 and rv > 0"""))
def m8_variance_premium(r: Roles):
    rows = r.chain.groupBy("date", "symbol").agg(F.avg("iv").alias("iv60"), (0.1 + 0.01 * F.avg("strike") / 100).alias("rv_fcst"))
    return rounded(signals.variance_premium(rows, rows))


@query(with_roles("chain", f"""{_PILLARS}, s as (select date, symbol, ln(avg(iv)) - ln(0.15) as vrp from chain group by 1, 2), m as (select date, avg(vrp) as m from s where symbol <> 'S0' group by 1), i as (select date, ln(avg(atm_iv)) - ln(0.15) as vrp from pillars where symbol = 'S0' group by 1)
    select date, round(coalesce(i.vrp, m), 6) + 0.0 as vrp from m full join i using (date)"""))
def m24_index_premium(r: Roles):
    """The index's own premium on days on which it has a pillar, else the mean of the names."""
    rows = r.chain.groupBy("date", "symbol").agg((F.ln(F.avg("iv")) - F.ln(F.lit(0.15))).alias("vrp"))
    index = surface.atm_pillars(r.chain.filter("symbol = 'S0'")).groupBy("date").agg((F.ln(F.avg("atm_iv")) - F.ln(F.lit(0.15))).alias("vrp"))
    return rounded(signals.premium_with_fallback(index, rows.filter("symbol <> 'S0'")))


@query(with_roles("xs_bars", f"""{_XS}, z as (select date, symbol, residual as signal from res), i as (select symbol, stddev_samp(residual) as v from res group by 1) select date, symbol, round(-0.05 * v * signal, 6) + 0.0 as alpha from z join i using (symbol)"""))
def m10_scaled_alpha(r: Roles):
    rows = residuals_by(cross_section(r), "vrp", ["x1", "x2"], ["date"], 50)
    idio = rows.join(rows.groupBy("symbol").agg(F.stddev_samp("residual").alias("idio_vol")), "symbol").select("date", "symbol", "idio_vol")
    return rounded(signals.scaled_alpha(rows.select("date", "symbol", F.col("residual").alias("signal")), idio))


# ---- realized-volatility forecast ------------------------------------------------------------------------------


def har_panel(r: Roles):
    return vol.close_to_close_panel(r.bars, (1, 5, 22), 20)


def _har_sql() -> str:
    """The refits: running sums of products by session, and Cramer's rule on their central moments."""
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    x = ["1.0", "x1", "x2", "x3"]
    sums = ", ".join([*(f"sum({x[i]} * {x[j]}) as s{i}{j}" for i, j in pairs), *(f"sum({x[i]} * y) as t{i}" for i in range(4)), "sum(y * y) as yy"])
    names = ["n", *(f"s{i}{j}" for i, j in pairs), *(f"t{i}" for i in range(4)), "yy"]
    upto = ", ".join(f"sum(coalesce({c}, 0)) over (order by i) as {c}" for c in names)
    a = lambda i, j: f"a{min(i, j)}{max(i, j)}"
    det = lambda c: f"({c[0][0]} * ({c[1][1]} * {c[2][2]} - {c[1][2]} * {c[2][1]}) - {c[0][1]} * ({c[1][0]} * {c[2][2]} - {c[1][2]} * {c[2][0]}) + {c[0][2]} * ({c[1][0]} * {c[2][1]} - {c[1][1]} * {c[2][0]}))"
    m = [[a(i, j) for j in (1, 2, 3)] for i in (1, 2, 3)]
    slope = lambda k: f"{det([[f'r{i}' if j == k else m[i - 1][j - 1] for j in (1, 2, 3)] for i in (1, 2, 3)])} / {det(m)} as c{k}"
    return f"""sq as (select date, symbol, ln(close / lag(close) over w) ** 2 as s from bars where close >= 1.0 window w as (partition by symbol order by date)),
    pn as (select date, symbol, sqrt(252 * s) as rv_1, sqrt(252 * case when count(*) over w5 = 5 then coalesce(sum(s) over w5, 0) / nullif(count(s) over w5, 0) end) as rv_5, sqrt(252 * case when count(*) over w22 = 22 then coalesce(sum(s) over w22, 0) / nullif(count(s) over w22, 0) end) as rv_22,
        sqrt(252 * case when count(*) over f20 = 20 then coalesce(sum(s) over f20, 0) / nullif(count(s) over f20, 0) end) as rv_fwd
        from sq window w5 as (partition by symbol order by date rows between 4 preceding and current row), w22 as (partition by symbol order by date rows between 21 preceding and current row), f20 as (partition by symbol order by date rows between 1 following and 20 following)),
    hr as (select date, symbol, ln(rv_1) as x1, ln(rv_5) as x2, ln(rv_22) as x3, case when rv_fwd > 0 then ln(rv_fwd * rv_fwd) end as y from pn where rv_1 > 0 and rv_5 > 0 and rv_22 > 0),
    ix as (select date, row_number() over (order by date) - 1 as i, lag(date) over (order by date) as before from (select distinct date from hr)),
    dy as (select date, count(*) as n, {sums} from hr where y is not null group by 1), rn as (select i, {upto} from ix left join dy using (date)),
    mo as (select ix.date, rn.* exclude (i) from ix join rn on rn.i = ix.i - 20 where (before is null or date_trunc('month', before) <> date_trunc('month', ix.date)) and n >= 1000),
    ce as (select *, {", ".join(f"s{i}{j} / n - s0{i} / n * s0{j} / n as a{i}{j}" for i, j in pairs if i)}, {", ".join(f"t{i} / n - s0{i} / n * t0 / n as r{i}" for i in (1, 2, 3))} from mo),
    sl as (select *, {", ".join(map(slope, (1, 2, 3)))} from ce),
    co as (select date, cast(n as bigint) as rows, (t0 - c1 * s01 - c2 * s02 - c3 * s03) / n as c0, c1, c2, c3, greatest(0, yy / n - t0 / n * t0 / n - c1 * r1 - c2 * r2 - c3 * r3) as residual_var from sl)"""


@query(with_roles("bars", f"{_har_sql()} select hr.date, symbol, round(sqrt(exp(c0 + c1 * x1 + c2 * x2 + c3 * x3 + residual_var / 2)), 5) as rv_fcst from hr asof join co on hr.date >= co.date"))
def m6_har_forecast(r: Roles):
    """Pooled forecasts with monthly refits."""
    return rounded(har.har_forecast(har_panel(r), forward=20, min_rows=1000), 5)


@query(with_roles("bars", f"{_har_sql()} select date, rows, {', '.join(f'round(c{i}, 5) + 0.0 as c{i}' for i in range(4))}, round(residual_var, 5) as residual_var from co"))
def m6_har_coefficients(r: Roles):
    return rounded(har.har_coefficients(har_panel(r), forward=20, min_rows=1000), 5)


# ---- factor risk -----------------------------------------------------------------------------------------------

_RET = """ret as (select date, symbol, 100 * ln(close / lag(close) over (partition by symbol order by date)) as pnl_per_vega, cast(volume as double) as dollar_vega from xs_bars),
    cl as (select * from ret where pnl_per_vega is not null and dollar_vega > 0), mk as (select date, sum(pnl_per_vega * dollar_vega) / sum(dollar_vega) as m from cl group by 1),
    rw as (select date, sector, sum(pnl_per_vega * dollar_vega) / sum(dollar_vega) as raw, any_value(m) as m from cl join sectors using (symbol) join mk using (date) group by 1, 2),
    fr as (select date, 'MKT' as factor, m as ret from mk union all select date, sector, raw - avg(raw) over s - covar_samp(raw, m) over s / var_samp(m) over s * (m - avg(m) over s) from rw window s as (partition by sector))"""


def returns(r: Roles):
    return r.kept("returns", lambda: _returns(r))


def _returns(r: Roles):
    return r.xs_bars.select("date", "symbol", (100 * vol.log_return()).alias("pnl_per_vega"), F.col("volume").cast("double").alias("dollar_vega"))


def factors(r: Roles):
    """A few rows a day, checkpointed: each of the many readers would hold, plan and log all that led to them."""
    return r.kept("factors", lambda: checkpointed(risk.factor_returns(returns(r), r.sectors)))


def model(r: Roles):
    return r.kept("model", lambda: risk.rolling_model(returns(r), factors(r), r.sectors, 36, 24))


@query(with_roles("xs_bars sectors", f"{_RET} select date, factor, round(ret, 5) + 0.0 as ret from fr"))
def m11_factor_returns(r: Roles):
    return rounded(factors(r), 5)


@query(with_roles("xs_bars sectors", f"""{_RET}, x as (select cl.date, cl.symbol, pnl_per_vega as y, m.ret as x1, s.ret as x2 from cl join sectors using (symbol) join fr m on m.date = cl.date and m.factor = 'MKT' join fr s on s.date = cl.date and s.factor = sector),
    w as (select *, count(*) over w as n, var_samp(x1) over w as a, var_samp(x2) over w as b, covar_samp(x1, x2) over w as c, covar_samp(x1, y) over w as d, covar_samp(x2, y) over w as e, var_samp(y) over w as v from x window w as (partition by symbol order by date rows between 35 preceding and current row)),
    l as (select *, (d * b - e * c) / (a * b - c * c) as l1, (e * a - d * c) / (a * b - c * c) as l2 from w where n >= 24)
    select date, symbol, round(l1, 4) + 0.0 as market_loading, round(l2, 4) + 0.0 as sector_loading, round(sqrt(greatest(0, (n - 1) * (v - l1 * d - l2 * e) / (n - 3))), 3) as idio_vol from l"""))
def m12_rolling_loadings(r: Roles):
    return model(r).select("date", "symbol", r6("market_loading", 4), r6("sector_loading", 4), r6("idio_vol", 3))


@query(with_roles("xs_bars sectors", f"""{_RET}, x as (select cl.symbol, pnl_per_vega as y, m.ret as x1, s.ret as x2 from cl join sectors using (symbol) join fr m on m.date = cl.date and m.factor = 'MKT' join fr s on s.date = cl.date and s.factor = sector),
    w as (select symbol, count(*) as n, var_samp(x1) as a, var_samp(x2) as b, covar_samp(x1, x2) as c, covar_samp(x1, y) as d, covar_samp(x2, y) as e, var_samp(y) as v from x group by 1 having count(*) >= 24)
    select symbol, round((d * b - e * c) / (a * b - c * c), 4) + 0.0 as loading, round(sqrt(greatest(0, (n - 1) * (v - (d * b - e * c) / (a * b - c * c) * d - (e * a - d * c) / (a * b - c * c) * e) / (n - 3))), 3) as idio_vol from w"""))
def m13_one_window_model(r: Roles):
    loadings, idio = risk.fixed_loadings(returns(r), factors(r), r.sectors, 24)
    return loadings.filter(F.col("factor") == risk.MARKET).join(idio, "symbol").select("symbol", r6("loading", 4), r6("idio_vol", 3))


_COV = """gr as (select d.date, f.factor, coalesce(fr.ret, 0) as r from (select distinct date from fr) d cross join (select distinct factor from fr) f left join fr using (date, factor)),
    cv as (select * from (select a.date, a.factor as factor_1, b.factor as factor_2, covar_samp(a.r, b.r) over w as covariance, count(*) over w as n from gr a join gr b using (date) window w as (partition by a.factor, b.factor order by a.date rows between 35 preceding and current row)) where n >= 24)"""


@query(with_roles("xs_bars sectors", f"{_RET}, {_COV} select date, factor_1, factor_2, round(covariance, 3) + 0.0 as covariance, n from cv"))
def m14_factor_covariance(r: Roles):
    return rounded(risk.factor_covariances(factors(r), 36, 24), 3)


_SHRINK = """dy as (select date, sum(case when factor_1 = factor_2 then covariance end) as tr, sum(covariance * covariance) as sq, count(distinct factor_1) as k, max(n) as m from cv group by 1),
    si as (select date, tr / k as mu, least(1.0, sq / m / nullif(sq - tr * tr / k, 0)) as sh from dy),
    sc as (select cv.date, factor_1, factor_2, (1 - sh) * covariance + sh * case when factor_1 = factor_2 then mu else 0 end as covariance from cv join si using (date))"""


@query(with_roles("xs_bars sectors", f"{_RET}, {_COV}, {_SHRINK} select date, factor_1, factor_2, round(covariance, 3) + 0.0 as covariance from sc"))
def m15_shrunk_covariance(r: Roles):
    return rounded(risk.shrink(risk.factor_covariances(factors(r), 36, 24)).drop("n"), 3)


def risk_tables(r: Roles, day: str):
    """Loadings, factor covariances and idiosyncratic volatilities as of ``day``: a row or two for each name, cut from the plans of the whole model."""
    loadings, idio = risk.long_model(checkpointed(risk.model_as_of(model(r), day)))
    return loadings, checkpointed(risk.model_as_of(risk.shrink(risk.factor_covariances(factors(r), 36, 24)), day)), idio


_LOADED = """x as (select cl.date, cl.symbol, sector, pnl_per_vega as y, m.ret as x1, s.ret as x2 from cl join sectors using (symbol) join fr m on m.date = cl.date and m.factor = 'MKT' join fr s on s.date = cl.date and s.factor = sector),
    w as (select *, count(*) over w as n, var_samp(x1) over w as a, var_samp(x2) over w as b, covar_samp(x1, x2) over w as c, covar_samp(x1, y) over w as d, covar_samp(x2, y) over w as e, var_samp(y) over w as v from x window w as (partition by symbol order by date rows between 35 preceding and current row)),
    l as (select *, (d * b - e * c) / (a * b - c * c) as l1, (e * a - d * c) / (a * b - c * c) as l2 from w where n >= 24), day as (select max(date) as date from l where date <= date '2000-06-15'),
    lo as (select l.symbol, unnest(['MKT', sector]) as factor, unnest([l1, l2]) as loading, sqrt(greatest(0, (n - 1) * (v - l1 * d - l2 * e) / (n - 3))) as idio from l join day using (date)),
    sv as (select * from sc where date = (select max(date) from sc where date <= date '2000-06-15')),
    ex as (select symbol, factor_2 as factor, sum(loading * covariance) as v from lo join sv on factor_1 = factor group by 1, 2),
    mc as (select a.symbol as symbol_1, b.symbol as symbol_2, sum(a.v * b.loading) as c, max(b.idio) as idio from ex a join lo b using (factor) group by 1, 2)"""


@query(with_roles("xs_bars sectors", f"{_RET}, {_COV}, {_SHRINK}, {_LOADED} select (select date from day) as date, symbol_1, symbol_2, round(c + case when symbol_1 = symbol_2 then idio * idio else 0 end, 1) + 0.0 as covariance from mc"))
def m16_model_covariance(r: Roles):
    """On the last date on or before mid-2000, for all names; the parts are those of M12 and M15."""
    return rounded(risk.model_covariance(*risk_tables(r, "2000-06-15")), 1)


@query(with_roles("xs_bars sectors", f"""{_RET}, x as (select cl.date, cl.symbol, sector, pnl_per_vega as y, m.ret as x1, s.ret as x2 from cl join sectors using (symbol) join fr m on m.date = cl.date and m.factor = 'MKT' join fr s on s.date = cl.date and s.factor = sector),
    w as (select *, count(*) over w as n, var_samp(x1) over w as a, var_samp(x2) over w as b, covar_samp(x1, x2) over w as c, covar_samp(x1, y) over w as d, covar_samp(x2, y) over w as e from x window w as (partition by symbol order by date rows between 35 preceding and current row)),
    l as (select date, symbol, (d * b - e * c) / (a * b - c * c) as l1, (e * a - d * c) / (a * b - c * c) as l2 from w where n >= 24), nx as (select date, lead(date) over (order by date) as nd from (select distinct date from xs_bars))
    select x.date, x.symbol, round(y, 4) + 0.0 as pnl_per_vega, round(y - l1 * x1 - l2 * x2, 2) + 0.0 as residual from x join nx on nx.nd = x.date join l on l.date = nx.date and l.symbol = x.symbol"""))
def m17_residual_returns(r: Roles):
    loadings, _ = risk.long_model(model(r))
    out = risk.residual_returns(returns(r).filter("pnl_per_vega is not null and dollar_vega > 0"), factors(r), loadings, calendar.session_index(r.xs_bars))
    return out.select("date", "symbol", r6("pnl_per_vega", 4), r6("residual", 2))


@query(with_roles("xs_bars sectors", "f as (select distinct sector as factor from sectors union select 'MKT'), y as (select distinct symbol from xs_bars) select y.symbol, f.factor, case when f.factor = s.sector then 1.5 else 0.0 end as loading from y cross join f left join sectors s on s.symbol = y.symbol"))
def m25_aligned_loadings(r: Roles):
    names = r.sectors.select(F.col("sector").alias("factor")).unionByName(r.spark.range(1).select(F.lit("MKT").alias("factor")))
    own = r.sectors.select("symbol", F.col("sector").alias("factor"), F.lit(1.5).alias("loading"))
    return risk.aligned_loadings(own, r.xs_bars.select("symbol"), names).select("symbol", "factor", "loading")


@query(with_roles("xs_bars", "select * from xs_bars where date = (select max(date) from xs_bars where date <= date '1997-05-20')"))
def m26_model_as_of(r: Roles):
    return risk.model_as_of(r.xs_bars, "1997-05-20")


# ---- books -----------------------------------------------------------------------------------------------------

_RANKS = """sg as (select date, symbol, round(ln(close), 9) as signal from xs_bars), rk as (select *, rank() over (partition by date order by signal) + (count(*) over (partition by date, signal) - 1) / 2 as rk, count(*) over (partition by date) as n from sg),
    rw2 as (select date, symbol, -(rk - (n + 1) / 2) as raw from rk where n >= 10), tg as (select date, symbol, raw * 1000 / sum(abs(raw)) over (partition by date) as target_vega from rw2)"""


def level_signal(r: Roles):
    return r.xs_bars.select("date", "symbol", F.round(F.ln("close"), 9).alias("signal"))


@query(with_roles("xs_bars", f"{_RANKS} select date, symbol, round(target_vega, 6) + 0.0 as target_vega from tg"))
def b14_rank_targets(r: Roles):
    return rounded(pnl.rank_targets(level_signal(r)))


@query(with_roles("xs_bars", """sg as (select date, symbol, round(ln(close), 9) as signal from xs_bars), rk as (select *, rank() over (partition by date order by signal) + (count(*) over (partition by date, signal) - 1) / 2 as rk, count(*) over (partition by date) as n from sg),
    kk as (select *, greatest(1, round_even(n * 0.1, 0)) as k from rk where n >= 10), t as (select date, symbol, case when rk <= k then 1.0 when rk > n - k then -1.0 else 0.0 end as raw from kk) select date, symbol, round(raw * 1000 / sum(abs(raw)) over (partition by date), 6) + 0.0 as target_vega from t"""))
def b14_tail_targets(r: Roles):
    return rounded(pnl.rank_targets(level_signal(r), scheme="quantile"))


_REFERENCE = """rf as (select date, symbol, 100 * ln(close / lag(close) over (partition by symbol order by date)) as pnl_per_vega, 0.01 as cost_per_vega, 0.02 as exit_cost_per_vega, 1.0 + volume % 7 as dollar_vega, lag(1.0 + volume % 7) over (partition by symbol order by date) as entry_vega, case when month(date) % 3 = 0 then 'roll' else '' end as event from xs_bars),
    rb as (select date from (select distinct date from xs_bars) where month(date) % 2 = 1), al as (select d.date, s.symbol from (select distinct date from xs_bars) d cross join (select distinct symbol from xs_bars) s),
    st as (select al.date, al.symbol, rf.pnl_per_vega, rf.cost_per_vega, rf.exit_cost_per_vega, rf.dollar_vega, rf.entry_vega, coalesce(rf.event, '') as event, rf.symbol is not null as here,
        case when rf.symbol is null then 0.0 when rb.date is not null and rf.dollar_vega > 0 then coalesce(tg.target_vega, 0) / rf.dollar_vega end as sets from al left join rf using (date, symbol) left join rb on rb.date = al.date left join tg on tg.date = al.date and tg.symbol = al.symbol),
    un as (select *, coalesce(last_value(sets ignore nulls) over (partition by symbol order by date rows between unbounded preceding and current row), 0) as units from st), hl as (select *, coalesce(lag(units) over (partition by symbol order by date), 0) as held from un),
    rc as (select date, symbol, units, case when here then held * coalesce(entry_vega, 0) * coalesce(pnl_per_vega, 0) else 0 end as option_pnl,
        case when here then abs(held * coalesce(entry_vega, 0) * cost_per_vega) + abs(units - held) * exit_cost_per_vega * case when event in ('open', 'roll') then dollar_vega else coalesce(entry_vega, 0) end else 0 end as option_cost, units * coalesce(dollar_vega, 0) as dollar_vega, not here as stale from hl where units <> 0 or held <> 0)"""


def reference_panel(r: Roles):
    w = by("symbol")
    vega = 1.0 + F.col("volume") % 7
    return r.xs_bars.select("date", "symbol", (100 * vol.log_return()).alias("pnl_per_vega"), F.lit(0.01).alias("cost_per_vega"), F.lit(0.02).alias("exit_cost_per_vega"), vega.alias("dollar_vega"), F.lag(vega).over(w).alias("entry_vega"), F.when(F.month("date") % 3 == 0, "roll").otherwise("").alias("event"))


def rank_book(r: Roles):
    rebalances = r.xs_bars.select("date").distinct().filter(F.month("date") % 2 == 1)
    return pnl.book(reference_panel(r), pnl.rank_targets(level_signal(r)), rebalances, 1.0)


@query(with_roles("xs_bars", f"{_RANKS}, {_REFERENCE} select date, symbol, round(units, 5) + 0.0 as units, round(option_pnl, 4) + 0.0 as option_pnl, round(option_cost, 5) + 0.0 as option_cost, round(dollar_vega, 5) + 0.0 as dollar_vega, stale from rc"))
def b16_rank_book(r: Roles):
    return rank_book(r).select("date", "symbol", r6("units", 5), r6("option_pnl", 4), r6("option_cost", 5), r6("dollar_vega", 5), "stale")


@query(with_roles("xs_bars", f"""{_RANKS}, {_REFERENCE}, nx as (select date, lead(date) over (order by date) as nd from (select distinct date from rc)), hb as (select nd as date, symbol from rc join nx using (date) where units <> 0 and nd is not null),
    inn as (select date, symbol from xs_bars where cast(symbol as integer) % 4 = month(date) % 4)
    select sg.date, sg.symbol, round(signal, 6) as signal from sg where (sg.date, sg.symbol) in (select (date, symbol) from inn) or (sg.date, sg.symbol) in (select (date, symbol) from hb)"""))
def b15_eligible_names(r: Roles):
    """Names of the universe, and those that the rank book holds."""
    return rounded(pnl.eligible_scores(level_signal(r), r.xs_bars, rotating_universe(r), pnl.held_before(rank_book(r))))


def rotating_universe(r: Roles):
    return r.xs_bars.filter(F.col("symbol").cast("int") % 4 == F.month("date") % 4).select("date", "symbol")


@query(with_roles("xs_bars", """ss as (select distinct date from xs_bars), rb as (select date, row_number() over (order by date) as k from ss where month(date) % 2 = 1),
    sp as (select s.date, min(rb.date) as next from ss s join rb on rb.date >= s.date group by 1), ns as (select next, count(*) as sessions from sp group by 1),
    st as (select rb.k, b.symbol, count(*) as have, max(sessions) as sessions, max(case when b.date = sp.next then 1.0 + b.volume % 7 end) as vega, max(case when b.date = sp.next then round(ln(close), 9) end) as score,
        bool_or(b.date = sp.next and cast(b.symbol as integer) % 4 = month(b.date) % 4) as member from xs_bars b join sp using (date) join ns using (next) join rb on rb.date = sp.next group by 1, 2),
    lp as (
        select cast(0 as bigint) as k, symbol, cast(null as double) as target, false as held from (select distinct symbol from xs_bars)
        union all
        select k, symbol, target, case when vega is null then false when vega > 0 then coalesce(target, 0) <> 0 else whole and was end
        from (select *, raw * 1000 / nullif(sum(abs(raw)) over (partition by now), 0) as target
            from (select *, case when now and n >= 10 then case when rk <= greatest(1, round_even(n * 0.3, 0)) then 1.0 when rk > n - greatest(1, round_even(n * 0.3, 0)) then -1.0 else 0.0 end end as raw
                from (select *, rank() over (partition by now order by score) + (count(*) over (partition by now, score) - 1) / 2 as rk, count(*) over (partition by now) as n
                    from (select lp.k + 1 as k, lp.symbol, lp.held as was, st.vega, st.score, st.have = st.sessions as whole, coalesce(st.vega is not null and st.score is not null and (st.member or (st.have = st.sessions and lp.held)), false) as now
                        from lp join rb on rb.k = lp.k + 1 left join st on st.k = lp.k + 1 and st.symbol = lp.symbol)))))
    select rb.date, lp.symbol, round(target, 6) + 0.0 as target_vega from lp join rb using (k) where target is not null""").replace("with ", "with recursive ", 1))
def b15_closed_loop(r: Roles):
    """Targets of a book that keeps names which have left the universe as long as their rank gives them one."""
    present = reference_panel(r).select("date", "symbol", "dollar_vega")
    rebalances = r.xs_bars.select("date").distinct().filter(F.month("date") % 2 == 1)
    return rounded(pnl.closed_loop(level_signal(r), present, rotating_universe(r), rebalances, scheme="quantile", quantile=0.3))


_DAILY = """tv as (select *, abs(dollar_vega - coalesce(lag(dollar_vega) over (partition by symbol order by date), 0)) as traded from rc),
    bd as (select date, sum(option_pnl) as gross_pnl, sum(option_cost) as cost, sum(abs(dollar_vega)) as gross_vega, sum(dollar_vega) as net_vega, sum(traded) as turnover, count(*) filter (units <> 0) as positions, sum(option_pnl) - sum(option_cost) as net_pnl from tv group by 1),
    dl as (select *, sum(net_pnl) over (order by date) as cumulative_net from bd)"""


@query(with_roles("xs_bars", f"{_RANKS}, {_REFERENCE}, {_DAILY} select date, round(gross_pnl, 3) + 0.0 as gross_pnl, round(cost, 4) as cost, round(gross_vega, 4) as gross_vega, round(net_vega, 4) + 0.0 as net_vega, round(turnover, 4) as turnover, positions, round(cumulative_net, 2) + 0.0 as cumulative_net from dl"))
def a3_book_daily(r: Roles):
    out = reports.book_daily(rank_book(r))
    return out.select("date", r6("gross_pnl", 3), r6("cost", 4), r6("gross_vega", 4), r6("net_vega", 4), r6("turnover", 4), "positions", r6("cumulative_net", 2))


@query(with_roles("xs_bars", f"""{_RANKS}, {_REFERENCE}, {_DAILY}, dd as (select *, cumulative_net - max(cumulative_net) over (order by date) as down from dl)
    select count(*) as sessions, round(avg(positions), 4) as mean_positions, round(sum(net_pnl), 2) + 0.0 as total_net_pnl, round(avg(net_pnl) / stddev_samp(net_pnl) * sqrt(252), 4) + 0.0 as sharpe, round(min(down), 2) + 0.0 as max_drawdown,
    round(avg(turnover) * 252 / avg(case when gross_vega > 0 then gross_vega end), 4) as annual_turnover_over_gross_vega, round(sum(cost) / abs(sum(gross_pnl)), 4) as cost_drag from dd"""))
def b19_book_summary(r: Roles):
    out = reports.book_summary(reports.book_daily(rank_book(r)))
    return out.select("sessions", r6("mean_positions", 4), r6("total_net_pnl", 2), r6("sharpe", 4), r6("max_drawdown", 2), r6("annual_turnover_over_gross_vega", 4), r6("cost_drag", 4))


@query(with_roles("xs_bars sectors", f"""{_RANKS}, {_REFERENCE}, {_DAILY}, {_RET}, j as (select net_pnl / gross_vega as y, m.ret as x from dl join fr m on m.date = dl.date and m.factor = 'MKT' where gross_vega > 0),
    f as (select count(*) as n, regr_slope(y, x) as b, regr_intercept(y, x) as a, avg(x) as mx, var_pop(x) as vx, var_pop(y) as vy, var_pop(y) - regr_slope(y, x) * covar_pop(x, y) as rest from j),
    t as (select *, rest / (n - 2) as s from f), u as (select unnest(['const', 'market']) as regressor, unnest([a, b]) as c, unnest([sqrt(s * (1 + mx * mx / vx)), sqrt(s / vx)]) as e, 1 - rest / vy as r2, n from t)
    select regressor, round(c, 5) + 0.0 as coefficient, round(c / e, 3) + 0.0 as t_stat, round(r2, 5) as r_squared, n as observations from u"""))
def m18_book_regression(r: Roles):
    """The rank book's P&L of a dollar of gross vega on the market factor."""
    daily = reports.book_daily(rank_book(r)).filter("gross_vega > 0").withColumn("y", F.col("net_pnl") / F.col("gross_vega"))
    rows = daily.join(factors(r).filter(F.col("factor") == risk.MARKET).select("date", F.col("ret").alias("market")), "date")
    return ols_table(rows, "y", ["market"]).select("regressor", r6("coefficient", 5), r6("t_stat", 3), r6("r_squared", 5), "observations")


@query(None)
def m18_book_factors(r: Roles):
    """The same on the market, all sectors and an index return; compared with least squares in the tests."""
    market = r.xs_bars.groupBy("date").agg(F.avg(F.ln(F.col("close") / F.col("open"))).alias("market_return"))
    return rounded(reports.book_factors(reports.book_daily(rank_book(r)), factors(r), market), 5)


_FWD = """fw as (select date, symbol, case when count(*) over f = 3 then sum(coalesce(pnl_per_vega, 0)) over f end as gross_fwd, case when count(*) over f = 3 then sum(coalesce(cost_per_vega, 0)) over f end as cost_fwd, exit_cost_per_vega as e0, lead(exit_cost_per_vega, 3) over (partition by symbol order by date) as e1
        from rf window f as (partition by symbol order by date rows between 1 following and 3 following)), fn as (select *, gross_fwd - cost_fwd - e0 - e1 as net_fwd from fw where gross_fwd is not null and e1 is not null)"""


@query(with_roles("xs_bars", f"""{_RANKS}, {_REFERENCE}, {_FWD}, dc as (select date, symbol, gross_fwd, net_fwd, least(10, greatest(1, ceil(row_number() over (partition by date order by signal, symbol) * 10 / count(*) over (partition by date)))) as decile from sg join fn using (date, symbol)),
    dd as (select date, decile, avg(gross_fwd) as gross, avg(net_fwd) as net, count(*) as names from dc group by 1, 2)
    select cast(decile as integer) as decile, round(avg(gross), 4) + 0.0 as gross_fwd_pnl_per_vega, round(avg(net), 4) + 0.0 as net_fwd_pnl_per_vega, round(avg(gross) / stddev_samp(gross) * sqrt(count(*)), 4) + 0.0 as gross_t_stat, round(avg(names), 4) as mean_names, count(*) as dates from dd group by 1"""))
def b11_forward_decile_table(r: Roles):
    out = reports.forward_decile_table(level_signal(r), reference_panel(r), 3)
    return rounded(out, 4)


@query(with_roles("xs_bars", f"""{_RANKS}, {_REFERENCE}, {_FWD}, dc as (select date, gross_fwd, least(10, greatest(1, ceil(row_number() over (partition by date order by signal, symbol) * 10 / count(*) over (partition by date)))) as d from sg join fn using (date, symbol)),
    sp as (select date, avg(case when d = 10 then gross_fwd end) - avg(case when d = 1 then gross_fwd end) as s from dc group by 1)
    select count(s) as days, round(avg(s), 4) + 0.0 as mean, round(avg(s) / stddev_samp(s) * sqrt(count(s)), 4) + 0.0 as t_naive, round(avg(s) / stddev_samp(s) * sqrt(count(s)) / sqrt(3), 4) + 0.0 as t_overlap from sp where s is not null"""))
def b12_spread_stats(r: Roles):
    return rounded(reports.spread_stats(level_signal(r), reference_panel(r), 3), 4)


WINDOWS = {"3": (3, 0), "6_skip1": (6, 1), "12": (12, 0)}


@query(None)
def b22_window_sweep(r: Roles):
    """Past-return signals of several windows: spreads, rank books, their market loading and their costed books, a row a window."""
    rebalances = r.xs_bars.select("date").distinct().filter(F.month("date") % 2 == 1)
    return rounded(book_studies.window_sweep(reference_panel(r), WINDOWS, 3, rebalances, factors(r), risk.MARKET)[0], 4)


def _past(label: str, n: int, skip: int) -> str:
    return f"select '{label}' as label, date, symbol, case when count(pnl_per_vega) over w >= {max(1, n // 2)} then sum(pnl_per_vega) over w end as past from rf window w as (partition by symbol order by date rows between {n + skip - 1} preceding and {f'{skip} preceding' if skip else 'current row'})"


@query(with_roles("xs_bars", f"""{_RANKS}, {_REFERENCE}, {_FWD}, ps as ({" union all ".join(_past(k, *v) for k, v in WINDOWS.items())}), pn as (select *, count(*) over (partition by label, date) as names from ps where past is not null),
    zs as (select label, date, symbol, -(past - avg(past) over g) / stddev_samp(past) over g as signal from pn where names >= 50 window g as (partition by label, date)),
    dc as (select label, date, gross_fwd, net_fwd, least(10, greatest(1, ceil(row_number() over (partition by label, date order by signal, symbol) * 10 / count(*) over (partition by label, date)))) as decile from zs join fn using (date, symbol)),
    dd as (select label, date, decile, avg(gross_fwd) as gross, avg(net_fwd) as net, count(*) as names from dc group by 1, 2, 3)
    select label, cast(decile as integer) as decile, round(avg(gross), 3) + 0.0 as gross_fwd_pnl_per_vega, round(avg(net), 3) + 0.0 as net_fwd_pnl_per_vega, round(avg(names), 4) as mean_names, count(*) as dates from dd group by 1, 2"""))
def b22_window_deciles(r: Roles):
    """The decile table of each window."""
    return book_studies.window_deciles(reference_panel(r), WINDOWS, 3).select("label", "decile", r6("gross_fwd_pnl_per_vega", 3), r6("net_fwd_pnl_per_vega", 3), r6("mean_names", 4), "dates")


@query(with_roles("sessions announcements chain", f"""{_EVENTS}, iv as (select date, symbol, round(avg(iv), 9) as signal, avg(oi) as raw from chain group by 1, 2), nx as (select iv.*, (select min(event_session) from e where e.symbol = iv.symbol and event_session >= iv.date) - date as d, lead(signal) over (partition by symbol order by date) - signal as fwd,
        floor((rank() over (partition by date order by signal) + (count(*) over (partition by date, signal) - 1) / 2 - 1) * 5 / count(*) over (partition by date)) + 1 as place from iv)
    select case when d between 0 and 7 then '0-7' when d between 8 and 30 then '8-30' when d between 31 and 90 then '31-90' else 'none' end as bucket, count(*) as name_days, round(avg(raw), 5) as mean_raw, round(avg(signal), 6) as mean_signal, round(avg(cast(place = 5 as integer)), 6) as share_top, round(avg(cast(place = 1 as integer)), 6) as share_bottom,
    round(avg(fwd), 6) + 0.0 as fwd_pnl, round(avg(fwd) / (stddev_samp(fwd) / sqrt(count(fwd))), 3) + 0.0 as fwd_t from nx group by 1"""))
def b13_signal_by_days_to_event(r: Roles):
    rows = r.chain.groupBy("date", "symbol").agg(F.round(F.avg("iv"), 9).alias("signal"), F.avg("oi").alias("raw")).withColumn("fwd", F.lead("signal").over(by("symbol")) - F.col("signal"))
    out = book_studies.by_days_to_event(rows, calendar.event_sessions(r.announcements, r.sessions), [("0-7", 0, 7), ("8-30", 8, 30), ("31-90", 31, 90)], 5)
    return out.select("bucket", "name_days", r6("mean_raw", 5), r6("mean_signal"), r6("share_top"), r6("share_bottom"), r6("fwd_pnl"), r6("fwd_t", 3))


@query(with_roles("chain", f"""{_OPT}, s as (select month, symbol, -((call_payoff + put_payoff) / (call_mid + put_mid) - 1) as naked, -(call_payoff + put_payoff - call_mid - put_mid - (call_delta + put_delta) * (spot_at_expiry - spot_entry)) / (call_mid + put_mid) as hedged from opt)
    select month, round(avg(naked), 5) + 0.0 as naked, round(avg(hedged), 5) + 0.0 as hedged, count(*) as names from s group by 1"""))
def b5_short_carry(r: Roles):
    return rounded(book_studies.short_carry(option_panel(r)), 5)


@query(with_roles("chain", f"""{_OPT}, s as (select year(month) as y, symbol, -((call_payoff + put_payoff) / (call_mid + put_mid) - 1) as naked, -(call_payoff + put_payoff - call_mid - put_mid - (call_delta + put_delta) * (spot_at_expiry - spot_entry)) / (call_mid + put_mid) as hedged, month from opt),
    mo as (select month, avg(naked) as naked, avg(hedged) as hedged from s group by 1), l as (select unnest(['naked', 'hedged']) as series, unnest([naked, hedged]) as v from mo) select series, count(v) as months, round(avg(v), 5) + 0.0 as mean, round(stddev_samp(v), 5) as std from l group by 1"""))
def a24_carry_summary(r: Roles):
    out = book_studies.series_summary(book_studies.short_carry(option_panel(r)), "month", ["naked", "hedged"])
    return out.select("series", "months", r6("mean", 5), r6("std", 5))


_CARRY = """rr as (select symbol, date, ln(close / lag(close) over (partition by symbol order by date)) as r from bars),
    rz as (select o.month, o.symbol, coalesce(sum(r * r), 0) * 252 / greatest(count(r), 1) as realized_var from opt o left join rr on rr.symbol = o.symbol and rr.date > o.entry_day and rr.date <= o.expiration group by 1, 2)"""


def carry_panel(r: Roles):
    returns_ = r.bars.select("symbol", "date", vol.log_return().alias("r"))
    return pnl.realized_over_hold(option_panel(r), returns_).withColumn("iv", F.col("signal"))


@query(with_roles("chain bars", f"""{_OPT}, {_CARRY}, s as (select f as effective_spread, o.month, call_mid + put_mid - f * (call_ask - call_bid + put_ask - put_bid) / 2 as premium, call_payoff + put_payoff as payoff, (call_delta + put_delta) * (spot_at_expiry - spot_entry) as move from opt o cross join (values (0.0::double), (0.25::double), (0.5::double), (1.0::double)) x(f)),
    mo as (select effective_spread, month, avg((premium - payoff) / premium) as naked, avg((premium - payoff + move) / premium) as hedged from s group by 1, 2), l as (select effective_spread, unnest(['naked', 'hedged']) as carry, unnest([naked, hedged]) as v from mo)
    select effective_spread, carry, count(v) as months, round(avg(v), 5) + 0.0 as mean, round(stddev_samp(v), 5) as std, round(avg(v) / stddev_samp(v) * sqrt(count(v)), 3) + 0.0 as t_stat from l group by 1, 2"""))
def a24_carry_costs(r: Roles):
    """The carries net of each share of the entry's half spread."""
    return book_studies.carry_cost_table(option_panel(r)).select("effective_spread", "carry", "months", r6("mean", 5), r6("std", 5), r6("t_stat", 3))


@query(with_roles("chain bars", f"""{_OPT}, {_CARRY}, s as (select case when cast(substr(o.symbol, 2) as integer) % 2 = 0 then 'even' else 'odd' end as sample, o.month, signal * signal - realized_var as variance_premium, signal - sqrt(realized_var) as vol_premium from opt o join rz using (month, symbol)),
    mo as (select sample, month, avg(variance_premium) as a, avg(vol_premium) as b from s group by 1, 2), l as (select sample, unnest(['variance_premium', 'vol_premium']) as series, unnest([a, b]) as v from mo)
    select sample, series, count(v) as months, round(avg(v), 4) + 0.0 as mean, round(stddev_samp(v), 4) as std from l group by 1, 2"""))
def a24_premium_series(r: Roles):
    """Variance and volatility premiums of two samples of names."""
    sample = F.when(F.substring("symbol", 2, 9).cast("int") % 2 == 0, "even").otherwise("odd")
    rows = book_studies.carry_returns(carry_panel(r)).groupBy(sample.alias("sample"), "month").agg(F.avg("variance_premium").alias("variance_premium"), F.avg("vol_premium").alias("vol_premium"))
    return book_studies.series_summary(rows, "month", ["variance_premium", "vol_premium"], ("sample",)).select("sample", "series", "months", r6("mean", 4), r6("std", 4))


@query(with_roles("bars announcements sessions", f"""{_EVENTS}, w as (select e.symbol, e.event_session, a.date as entry_day, c.date as exit_day from e join sessions s on s.date = e.event_session join sessions a on a.session_index = s.session_index - 1 join sessions c on c.session_index = s.session_index + 1)
    select w.symbol, w.event_session, round(c.close / a.close - 1, 6) + 0.0 as realized_move, round(abs(c.close / a.close - 1) / ((a.high - a.low) / a.close), 5) as move_ratio from w join bars a on a.symbol = w.symbol and a.date = w.entry_day join bars c on c.symbol = w.symbol and c.date = w.exit_day where a.high > a.low"""))
def b6_event_returns(r: Roles):
    events = calendar.event_windows(calendar.event_sessions(r.announcements, r.sessions), r.sessions, 1, 1, 1)
    implied = r.bars.filter("high > low").select("symbol", F.col("date").alias("entry_day"), F.col("close").alias("spot_entry"), ((F.col("high") - F.col("low")) / F.col("close")).alias("implied_move"))
    exits = r.bars.select("symbol", F.col("date").alias("exit_day"), F.col("close").alias("spot_exit"))
    out = book_studies.event_returns(events, implied, exits)
    return out.select("symbol", "event_session", r6("realized_move"), r6("move_ratio", 5))


@query(with_roles("chain", f"""{_OPT}, c as (select month, symbol, (call_payoff + put_payoff) / (call_mid + put_mid) - 1 as ret, least(3, greatest(1, ceil((rank() over (partition by year(month), month(month) order by round(signal, 9)) + (count(*) over (partition by year(month), month(month), round(signal, 9)) - 1) / 2) * 3 / count(*) over (partition by year(month), month(month))))) as tercile from opt),
    m as (select date_trunc('month', month) as p, tercile, avg(ret) as v from c group by 1, 2), s as (select t.p, t.v - b.v as v from m t join m b on b.p = t.p and b.tercile = 1 where t.tercile = 3) select count(v) as months, round(avg(v), 5) + 0.0 as mean, round(stddev_samp(v), 5) as std from s"""))
def b7_event_terciles(r: Roles):
    rows = pnl.hold_to_expiry(option_panel(r)).withColumns({"period": F.trunc("month", "month"), "score": F.round("signal", 9)})
    return book_studies.tercile_spread(rows, "score", "straddle", "period").select("months", r6("mean", 5), r6("std", 5))


_EVENT_PANEL = f"""{_EVENTS}, w as (select e.symbol, e.session, e.event_session, z.date as runup_day, a.date as entry_day, c.date as exit_day from e join sessions s on s.date = e.event_session join sessions a on a.session_index = s.session_index - 1 join sessions c on c.session_index = s.session_index + 1 join sessions z on z.session_index = s.session_index - 5),
    ep as (select w.*, cast(date_trunc('month', event_session) as date) as month, (a.high + a.low) / 2 as mid, a.low as bid, a.high as ask, (a.close - a.open) / a.close as delta, a.close as spot, (c.high + c.low) / 2 as exit_mid, c.close as exit_spot, (z.high + z.low) / 2 as runup_mid
        from w join bars a on a.symbol = w.symbol and a.date = w.entry_day join bars c on c.symbol = w.symbol and c.date = w.exit_day join bars z on z.symbol = w.symbol and z.date = w.runup_day),
    er as (select *, exit_mid / mid - 1 as straddle, (exit_mid - mid - delta * (exit_spot - spot)) / mid as hedged, mid / spot as implied_move, abs(exit_spot / spot - 1) / (mid / spot) as move_ratio, mid / runup_mid - 1 as iv_rise from ep),
    eh as (select *, case when count(move_ratio) over h = 4 then avg(move_ratio) over h end as history_ratio from er window h as (partition by symbol order by event_session rows between 4 preceding and 1 preceding)),
    so as (select * from (select eh.*, unnest(['implied', 'history', 'rise', 'level']) as sort, unnest([round(implied_move, 9), round(history_ratio, 9), round(iv_rise, 9), round(spot, 9)]) as score from eh) where score is not null),
    te as (select *, cast(least(3, greatest(1, ceil((rank() over (partition by sort, month order by score) + (count(*) over (partition by sort, month, score) - 1) / 2) * 3 / count(*) over (partition by sort, month)))) as integer) as tercile from so)"""
SORTS = {"implied": "implied_move", "history": "history_ratio", "rise": "iv_rise", "level": "spot"}


def event_panel(r: Roles):
    """Events with a price that stands for a straddle's: the middle of a bar's range, its low and high for the quotes."""
    events = calendar.event_windows(calendar.event_sessions(r.announcements, r.sessions), r.sessions, 1, 1, 5)
    middle = (F.col("high") + F.col("low")) / 2
    entry = r.bars.select("symbol", F.col("date").alias("entry_day"), middle.alias("mid"), F.col("low").alias("bid"), F.col("high").alias("ask"), ((F.col("close") - F.col("open")) / F.col("close")).alias("delta"), F.col("close").alias("spot"))
    leave = r.bars.select("symbol", F.col("date").alias("exit_day"), middle.alias("exit_mid"), F.col("close").alias("exit_spot"))
    runup = r.bars.select("symbol", F.col("date").alias("runup_day"), middle.alias("runup_mid"))
    rows = events.join(entry, ["symbol", "entry_day"]).join(leave, ["symbol", "exit_day"]).join(runup, ["symbol", "runup_day"]).withColumn("month", F.trunc("event_session", "month"))
    rows = book_studies.straddle_event_returns(rows).withColumns({"implied_move": F.col("mid") / F.col("spot"), "iv_rise": F.col("mid") / F.col("runup_mid") - 1})
    return book_studies.with_history(rows.withColumn("move_ratio", F.abs(F.col("exit_spot") / F.col("spot") - 1) / F.col("implied_move")))


def scores():
    return {name: F.round(c, 9) for name, c in SORTS.items()}


@query(with_roles("bars announcements sessions", f"""{_EVENT_PANEL}, l as (select sort, tercile, score, month, unnest(['straddle', 'hedged', 'move_ratio']) as series, unnest([straddle, hedged, move_ratio]) as v from te),
    ev as (select sort, tercile, series, count(*) as events, avg(v) as event_mean, avg(cast(v > 0 as integer)) as share_positive, avg(score) as sort_mean from l group by 1, 2, 3), mo as (select sort, tercile, series, month, avg(v) as v from l group by 1, 2, 3, 4),
    ms as (select sort, tercile, series, count(*) as months, avg(v) as mean from mo group by 1, 2, 3)
    select sort, tercile, series, events, round(event_mean, 5) + 0.0 as event_mean, round(share_positive, 6) as share_positive, months, round(mean, 5) + 0.0 as mean, round(sort_mean, 5) + 0.0 as sort_mean from ev join ms using (sort, tercile, series)"""))
def b7_event_sorts(r: Roles):
    """Event returns by tercile of four sorts."""
    table, _ = book_studies.event_sorts(event_panel(r), scores(), ["straddle", "hedged", "move_ratio"])
    return table.select("sort", "tercile", "series", "events", r6("event_mean", 5), r6("share_positive"), "months", r6("mean", 5), r6("sort_mean", 5))


@query(with_roles("bars announcements sessions", f"""{_EVENT_PANEL}, m as (select sort, month, tercile, avg(straddle) as a, avg(hedged) as b from te group by 1, 2, 3), d as (select t.sort, t.month, t.a - b.a as a, t.b - b.b as b from m t join m b on b.sort = t.sort and b.month = t.month and b.tercile = 1 where t.tercile = 3),
    l as (select sort, unnest(['straddle', 'hedged']) as series, unnest([a, b]) as v from d) select sort, series, count(*) as months, round(avg(v), 5) + 0.0 as mean, round(stddev_samp(v), 5) as std, round(avg(v) / stddev_samp(v) * sqrt(count(*)), 3) + 0.0 as t_stat from l group by 1, 2"""))
def b7_event_spreads(r: Roles):
    """Top less bottom tercile of the four sorts."""
    _, spread = book_studies.event_sorts(event_panel(r), scores(), ["straddle", "hedged"])
    return spread.select("sort", "series", "months", r6("mean", 5), r6("std", 5), r6("t_stat", 3))


@query(with_roles("bars announcements sessions", f"""{_EVENT_PANEL}, f as (select te.*, f, (ask - bid) / (2 * mid) as rel from te cross join (values (0.0::double), (0.25::double), (0.5::double), (1.0::double)) x(f) where tercile = 3),
    p as (select *, mid * (1 - f * rel) as en, exit_mid * (1 + f * rel) as ex from f), l as (select sort, f as effective_spread, month, unnest(['straddle', 'hedged']) as series, unnest([-(ex / en - 1), -(ex - en - delta * (exit_spot - spot)) / en]) as v from p),
    mo as (select sort, effective_spread, series, month, avg(v) as v from l group by 1, 2, 3, 4), ev as (select sort, effective_spread, series, count(v) as events, avg(v) as event_mean from l group by 1, 2, 3), ms as (select sort, effective_spread, series, count(v) as months, avg(v) as mean from mo group by 1, 2, 3)
    select sort, effective_spread, series, events, round(event_mean, 4) + 0.0 as event_mean, months, round(mean, 4) + 0.0 as mean from ev join ms using (sort, effective_spread, series)"""))
def b7_event_sort_costs(r: Roles):
    """The short side of each sort's top tercile, net of shares of the spread."""
    panel = event_panel(r).filter("bid > 0").drop("straddle", "hedged")
    return book_studies.event_sort_costs(panel, scores()).select("sort", "effective_spread", "series", "events", r6("event_mean", 4), "months", r6("mean", 4))


@query(with_roles("bars announcements sessions", f"""{_EVENT_PANEL}, s as (select month, straddle, hedged, unnest([case when session in ('bmo', 'amc') then 'session ' || session end, cast(year(event_session) as varchar)]) as split from er),
    l as (select split, month, unnest(['straddle', 'hedged']) as series, unnest([straddle, hedged]) as v from s where split is not null), mo as (select split, series, month, avg(v) as v from l group by 1, 2, 3),
    ev as (select split, series, count(*) as events, avg(v) as event_mean, avg(cast(v > 0 as integer)) as share_positive from l group by 1, 2), ms as (select split, series, count(*) as months, avg(v) as mean from mo group by 1, 2)
    select split, series, events, round(event_mean, 5) + 0.0 as event_mean, round(share_positive, 6) as share_positive, months, round(mean, 5) + 0.0 as mean from ev join ms using (split, series)"""))
def b7_event_splits(r: Roles):
    """Event returns by session and by year."""
    session = F.when(F.col("session").isin("bmo", "amc"), F.concat(F.lit("session "), "session"))
    out = book_studies.event_splits(event_panel(r), [session, F.year("event_session").cast("string")], ["straddle", "hedged"])
    return out.select("split", "series", "events", r6("event_mean", 5), r6("share_positive"), "months", r6("mean", 5))


def unit_chain(r: Roles):
    """The chain with an underlying that moves and a vega for each contract."""
    level = r.kept_chain.groupBy("date", "symbol").agg((100 * (0.85 + F.avg("iv"))).alias("underlying"))
    rows = r.kept_chain.drop("underlying").join(level, ["date", "symbol"]).withColumns({"years": F.datediff("expiration", "date") / 365.0, "is_call": F.col("right") == "C"})
    rows = pricing.with_greeks(rows.drop("delta"), "underlying", "strike", "years", "iv", "is_call")
    return rows.drop("price", "gamma", "theta", "years", "is_call")


def unit_returns(r: Roles):
    return r.kept("unit", lambda: pnl.per_vega(pnl.unit_records(pnl.reference_unit(r.kept("unit_chain", lambda: unit_chain(r)), 14, 5, 14, 90, 45))))


@query(None)
def b17_unit_returns(r: Roles):
    """P&L and costs of one unit a name for a dollar of its inception vega; checked against a session loop in the tests."""
    return rounded(unit_returns(r), 5)


@query(None)
def b16_unit_book(r: Roles):
    """A book that holds one unit of each name, set anew every fourth week."""
    unit = unit_returns(r)
    rebalances = calendar.session_index(unit).filter("session_index % 4 = 0").select("date")
    return rounded(pnl.book(unit, pnl.unit_targets(unit), rebalances, 1.0), 4)


@query(None)
def m11_unit_factors(r: Roles):
    """Factor returns of the reference units; a name's sector is its number's."""
    sectors = r.sectors.select(F.concat(F.lit("S"), "symbol").alias("symbol"), "sector")
    return rounded(risk.factor_returns(unit_returns(r), sectors), 4)


@query(None)
def b17_reference_unit(r: Roles):
    """The rolled straddle of each name; checked against a session loop in the tests."""
    return rounded(pnl.reference_unit(r.kept_chain, 14, 5, 14, 90, 45), 5)


def _months(clean: str) -> str:
    """Stock-months as SQL; ``clean``: the screen of both days' quotes."""
    return f"""wd as (select date, symbol, expiration, strike, max(case when "right" = 'C' then bid end) as cb, max(case when "right" = 'C' then ask end) as ca, max(case when "right" = 'C' then iv end) as ci, max(case when "right" = 'C' then volume end) as cv, max(case when "right" = 'C' then delta end) as cd,
        max(case when "right" = 'P' then bid end) as pb, max(case when "right" = 'P' then ask end) as pa, max(case when "right" = 'P' then iv end) as pi, max(case when "right" = 'P' then volume end) as pv from chain group by 1, 2, 3, 4),
    lv as (select date, symbol, avg(iv) as hv from chain group by 1, 2), pl as (select date as month, date + 28 as entry_day, min(expiration) as expiration from chain where expiration > date + 28 group by 1, 2),
    st as (select w.*, coalesce(w.cb = p.cb and w.ca = p.ca, false) as cs, coalesce(w.pb = p.pb and w.pa = p.pa, false) as ps from wd w left join wd p on p.date = w.date - 28 and p.symbol = w.symbol and p.expiration = w.expiration and p.strike = w.strike),
    ok as (select * from st where {clean}),
    fm as (select ok.*, month, entry_day, hv, row_number() over (partition by ok.symbol, month order by abs(strike / 100 - 1), strike) as n from ok join pl on pl.month = ok.date and pl.expiration = ok.expiration join lv on lv.date = ok.date and lv.symbol = ok.symbol where ci > 0 and pi > 0),
    sp as (select date as expiration, symbol, 100 * hv / 0.15 as spot from lv),
    sm as (select f.symbol, f.month, f.entry_day, f.expiration, f.strike, ln(f.hv) - ln((f.ci + f.pi) / 2) as signal, (e.cb + e.ca) / 2 as call_mid, (e.pb + e.pa) / 2 as put_mid, greatest(spot - f.strike, 0) as call_payoff, greatest(f.strike - spot, 0) as put_payoff
        from fm f join ok e on e.symbol = f.symbol and e.date = f.entry_day and e.expiration = f.expiration and e.strike = f.strike join sp on sp.expiration = f.expiration and sp.symbol = f.symbol where f.n = 1 and spot > 0)
    select symbol, month, entry_day, expiration, strike, round(signal, 6) + 0.0 as signal, round(call_mid, 6) as call_mid, round(put_mid, 6) as put_mid, round(call_payoff, 8) + 0.0 as call_payoff, round(put_payoff, 8) + 0.0 as put_payoff from sm"""


def months_out(df):
    return df.select("symbol", "month", "entry_day", "expiration", "strike", r6("signal"), r6("call_mid"), r6("put_mid"), r6("call_payoff", 8), r6("put_payoff", 8))


@query(with_roles("chain", _months("cb > 0 and ca > cb and cv > 0 and not cs and pb > 0 and pa > pb and pv > 0 and not ps")))
def t1_stock_months(r: Roles):
    """One contract a name and month, formed on one quote day and entered on the next."""
    return months_out(book_studies.chain_stock_months(r.kept_chain))


@query(with_roles("chain", _months("cb > 0 and ca > cb and pb > 0 and pa > pb")))
def b9_index_months(r: Roles):
    """The same for index options: quoted, without screens of volume and staleness."""
    return months_out(book_studies.chain_stock_months(r.kept_chain, traded=False))


@query(with_roles("chain", "select date, symbol, expiration, strike, \"right\", round(abs(volume) * ((ask - bid) / 2 * 100 * 0.5 + 0.65), 5) as option_cost, cast(round(abs(oi) * 0.005::double, 5) as double) as share_cost, round(volume * bid * 100, 5) as dollar_vega, round(-oi * delta * 100, 5) + 0.0 as hedge_shares from chain"))
def b18_b21_unit_costs(r: Roles):
    return rounded(r.chain.select("date", "symbol", "expiration", "strike", "right", pnl.option_cost(F.col("volume"), F.col("bid"), F.col("ask"), 0.5, 0.65).alias("option_cost"), pnl.share_cost(F.col("oi")).alias("share_cost"), pnl.dollar_vega(F.col("bid"), F.col("volume")).alias("dollar_vega"), pnl.hedge_shares(F.col("delta"), F.col("oi")).alias("hedge_shares")), 5)


@query(with_roles("sessions", "select date, s as symbol, v as target_vega from (select date from sessions where session_index % 5 = 0) cross join (values ('S0', 100.0::double), ('S1', -50.0::double)) t(s, v)"))
def b20_fixed_targets(r: Roles):
    return pnl.fixed_targets(r.sessions.filter("session_index % 5 = 0"), {"S0": 100.0, "S1": -50.0})


@query(with_roles("bars chain", f"""{_OPT}, e as (select month, symbol, 0 as horizon, (call_mid + put_mid) * 1.1 as exit_mid, (call_bid + put_bid) * 1.1 as exit_bid, (call_ask + put_ask) * 1.1 as exit_ask, call_mid, put_mid, call_ask, call_bid, put_ask, put_bid from opt)
    select symbol, month, h as horizon, round((exit_mid * (1 + h / 100.0) - 0.5 * (exit_ask - exit_bid) / 2) / (call_mid + 0.5 * (call_ask - call_bid) / 2 + put_mid + 0.5 * (put_ask - put_bid) / 2) - 1, 5) + 0.0 as straddle from e cross join (values (3), (5), (10), (15)) x(h)"""))
def b2_early_exit(r: Roles):
    panel = option_panel(r)
    marks = panel.withColumn("horizon", F.explode(F.array(*(F.lit(h) for h in (3, 5, 10, 15))))).select(
        "symbol", "month", "horizon", ((F.col("call_mid") + F.col("put_mid")) * 1.1 * (1 + F.col("horizon") / 100.0)).alias("exit_mid"), ((F.col("call_bid") + F.col("put_bid")) * 1.1).alias("exit_bid"), ((F.col("call_ask") + F.col("put_ask")) * 1.1).alias("exit_ask")
    )
    return rounded(pnl.early_exit(panel, marks, 0.5), 5)
