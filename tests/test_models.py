from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tenorlake.functions import pricing
from tenorlake.operators import har, pnl, regress, reports, risk, surface
from tenorlake.operators.panels import pick_straddles

D = date(2024, 1, 1)


def day(n):
    return D + timedelta(n)


def pillars(spark, points):
    return spark.createDataFrame([(D, "a", day(n), n, v) for n, v in points], "date date, symbol string, expiration date, dte int, atm_iv double")


def test_flat_surface_returns_its_level(spark):
    row = surface.constant_maturity(pillars(spark, [(10, 0.32), (45, 0.32), (80, 0.32), (120, 0.32)])).first()
    assert all(abs(row[c] - 0.32) < 1e-12 for c in ("iv30", "iv60", "iv90"))
    assert surface.constant_maturity(pillars(spark, [(10, 0.32), (45, 0.32)])).first().iv90 is None
    assert surface.constant_maturity(pillars(spark, [(10, 0.32)]), extrapolate=True).first().iv90 == 0.32


def test_surface_is_linear_in_total_variance(spark):
    got = surface.constant_maturity(pillars(spark, [(30, 0.2), (90, 0.4)]), (60,)).first().iv60
    assert abs(got**2 * 60 - (0.2**2 * 30 + 0.4**2 * 90) / 2) < 1e-12


def test_jump_is_recovered_and_taken_out(spark):
    jump, vol = 0.0036, 0.30
    points = [(n, float(np.sqrt(vol**2 + (jump * 365 / n if n >= 21 else 0)))) for n in (10, 17, 24, 45, 80, 108)]
    events = spark.createDataFrame([("a", day(21))], "symbol string, event_session date")
    own = pillars(spark, points)
    found = surface.jump_variance(own, events)
    assert abs(found.first().jump_var - jump) < 1e-12 and found.first().method == "term"
    adjusted = [r.atm_iv for r in surface.adjust_pillars(own, events, found).collect()]
    assert np.allclose(adjusted, vol, atol=1e-12)


def test_fit_matches_least_squares(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(1000, 1, (60, 2))
    y = 3 + x @ [0.5, -2.0] + rng.normal(0, 0.1, 60)
    df = spark.createDataFrame([("k", float(a), float(b), float(c)) for (a, b), c in zip(x, y)] + [("k", None, 1.0, 1.0)], "key string, x1 double, x2 double, y double")
    row = regress.fit_by(df, "y", ["x1", "x2"], ["key"]).first()
    want = np.linalg.lstsq(np.column_stack([np.ones(60), x]), y, rcond=None)[0]
    assert row.n == 60 and np.allclose([row.b_x1, row.b_x2], want[1:], atol=1e-8)
    res = regress.residuals_by(df, "y", ["x1", "x2"], ["key"]).toPandas()
    assert abs(np.corrcoef(res.residual, res.x1)[0, 1]) < 1e-6
    assert regress.fit_by(df, "y", ["x1", "x2"], ["key"], least=100).isEmpty()


def test_rolling_fit_matches_least_squares(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 2))
    y = x @ [1.0, 2.0] + rng.normal(0, 0.3, 40)
    df = spark.createDataFrame([("s", day(i), float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(40)], "symbol string, date date, a double, b double, y double")
    got = regress.rolling_fit(df, "y", ["a", "b"], "symbol", 25, 10).orderBy("date").toPandas()
    for i in (9, 20, 39):
        lo = max(0, i - 24)
        design = np.column_stack([np.ones(i - lo + 1), x[lo : i + 1]])
        beta = np.linalg.lstsq(design, y[lo : i + 1], rcond=None)[0]
        std = np.std(y[lo : i + 1] - design @ beta, ddof=3)
        row = got.iloc[i - 9]
        assert np.allclose([row.b_a, row.b_b, row.resid_std], [*beta[1:], std], atol=1e-9)


def test_what_left_the_window_has_no_effect(spark):
    """A value of 1e9 in a name's past leaves later fits equal to least squares; levels far from zero cost no digits."""
    rng = np.random.default_rng(4)
    n, window = 640, 250
    x = rng.normal(size=(n, 2)) + [1000.0, -50.0]
    y = 5 + x @ [1.0, 2.0] + rng.normal(0, 0.5, n)
    y[40], x[300, 0] = 1e9, 1e8
    df = spark.createDataFrame([("s", day(i), *map(float, x[i]), float(y[i])) for i in range(n)] + [("t", day(i), *map(float, x[i]), float(y[i])) for i in range(60)], "symbol string, date date, a double, b double, y double").repartition(5)
    fit = regress.rolling_fit(df, "y", ["a", "b"], "symbol", window, 120)
    got = fit.filter("symbol = 's'").orderBy("date").toPandas()
    for i in (290, 295, 299, 551, 600, 639):
        lo = i - window + 1
        design = np.column_stack([np.ones(window), x[lo : i + 1] - x[lo : i + 1].mean(axis=0)])
        beta = np.linalg.lstsq(design, y[lo : i + 1], rcond=None)[0]
        std = np.std(y[lo : i + 1] - design @ beta, ddof=3)
        row = got.iloc[i - 119]
        assert row.n == window and np.allclose([row.b_a, row.b_b, row.resid_std], [*beta[1:], std], rtol=1e-9, atol=1e-9), i
    plan = fit._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 1 and plan.count("Sort [symbol") == 1


@pytest.mark.parametrize("window", [1, 3, 16, 23, 64])
def test_trailing_moments_of_any_window(spark, window):
    rng = np.random.default_rng(window)
    values = rng.normal(3, 2, (70, 2))
    df = spark.createDataFrame([("s", day(i), *map(float, v)) for i, v in enumerate(values)], "symbol string, date date, u double, v double")
    for i, r in enumerate(regress.trailing_moments(df, ["u", "v"], "symbol", window, "date").orderBy("date").collect()):
        own = values[max(0, i - window + 1) : i + 1]
        far = own - own.mean(axis=0)
        assert r._n == len(own) and np.allclose([r._m0, r._m1, r._c00, r._c01, r._c11], [*own.mean(axis=0), *(far.T @ far).ravel()[[0, 1, 3]]], atol=1e-10)


def collinear_cases():
    rng = np.random.default_rng(8)
    a = rng.normal(2, 1, 60)
    flat = np.full(60, 3.0)
    return {"twice": (a, 2 * a + 1), "same": (a, a), "second flat": (a, flat), "first flat": (flat, a), "both flat": (flat, 2 * flat), "free": (a, rng.normal(size=60)), "zero": (a, 0 * a)}


def test_collinear_regressors_get_the_shortest_solution(spark):
    """As least squares by singular values does: in a grouped fit, a rolling one, and one over all rows."""
    rng = np.random.default_rng(9)
    cases = collinear_cases()
    y = {k: 1 + x1 - 0.5 * x2 + rng.normal(0, 0.2, 60) for k, (x1, x2) in cases.items()}
    rows = [(k, day(i), float(x1[i]), float(x2[i]), float(y[k][i])) for k, (x1, x2) in cases.items() for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, date date, a double, b double, y double")
    grouped = {r.symbol: r for r in regress.fit_by(df, "y", ["a", "b"], ["symbol"]).collect()}
    three = {r.symbol: r for r in regress.fit_by(df.withColumn("c", F.col("a") - F.col("b")), "y", ["a", "b", "c"], ["symbol"]).collect()}
    whole = {r.symbol: r for r in regress.whole_fit(df, "y", ["a", "b"], "symbol", 10).collect()}
    rolled = {r.symbol: r for r in regress.rolling_fit(df, "y", ["a", "b"], "symbol", 40, 40).filter(F.col("date") == day(59)).collect()}
    for k, (x1, x2) in cases.items():
        design = np.column_stack([np.ones(60), x1, x2])
        want = np.linalg.lstsq(design, y[k], rcond=None)[0]
        residual = y[k] - design @ want
        assert np.allclose([grouped[k].const, grouped[k].b_a, grouped[k].b_b], want, atol=1e-8), k
        assert abs(grouped[k].resid_var - residual.var()) < 1e-8
        assert np.allclose([whole[k].b_a, whole[k].b_b, whole[k].resid_std], [*want[1:], np.std(residual, ddof=3)], atol=1e-8), k
        wide = np.linalg.lstsq(np.column_stack([design, x1 - x2]), y[k], rcond=None)[0]
        assert np.allclose([three[k].const, three[k].b_a, three[k].b_b, three[k].b_c], wide, atol=1e-8), k
        late = np.linalg.lstsq(design[20:], y[k][20:], rcond=None)[0]
        assert np.allclose([rolled[k].b_a, rolled[k].b_b, rolled[k].resid_std], [*late[1:], np.std(y[k][20:] - design[20:] @ late, ddof=3)], atol=1e-8), k


def test_a_sector_that_is_the_market(spark):
    rng = np.random.default_rng(10)
    f = rng.normal(size=80)
    names = {"A": 1.5, "B": -0.5}
    noise = {s: rng.normal(0, 0.1, 80) for s in names}
    returns = spark.createDataFrame([(day(i), s, float(b * f[i] + noise[s][i])) for s, b in names.items() for i in range(80)], "date date, symbol string, pnl_per_vega double")
    factors = spark.createDataFrame([(day(i), k, float(f[i])) for k in ("MKT", "tech") for i in range(80)], "date date, factor string, ret double")
    sectors = spark.createDataFrame([("A", "tech"), ("B", "other")], "symbol string, sector string")
    loadings, idio = risk.fixed_loadings(returns, factors, sectors, 30)
    got = {(r.symbol, r.factor): r.loading for r in loadings.collect()}
    last, _ = risk.rolling_loadings(returns, factors, sectors, 80, 30)
    rolled = {(r.symbol, r.factor): r.loading for r in last.filter(F.col("date") == day(79)).collect()}
    y = {s: b * f + noise[s] for s, b in names.items()}
    both = np.linalg.lstsq(np.column_stack([np.ones(80), f, f]), y["A"], rcond=None)[0]
    alone = np.linalg.lstsq(np.column_stack([np.ones(80), f]), y["B"], rcond=None)[0]
    for own in (got, rolled):
        assert set(own) == {("A", "MKT"), ("A", "tech"), ("B", "MKT")}
        assert np.allclose([own["A", "MKT"], own["A", "tech"], own["B", "MKT"]], [*both[1:], alone[1]], atol=1e-9)
    assert {r.symbol: r.idio_vol for r in idio.collect()}.keys() == {"A", "B"}


def test_names_without_idio_vol_raise(spark):
    idio = spark.createDataFrame([("A", 0.2), ("B", None)], "symbol string, idio_vol double")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "symbol string")
    assert [tuple(r) for r in risk.aligned_idio(names("A", "A"), idio).collect()] == [("A", 0.2)]
    with pytest.raises(KeyError, match="'B', 'C'"):
        risk.aligned_idio(names("A", "C", "B"), idio)


def har_panel(spark, seed=0, scramble=False):
    rng = np.random.default_rng(3)
    rows = []
    for s in range(6):
        for i in range(120):
            v = np.exp(rng.normal(-1.5, 0.3, 4))
            if scramble and i > 80:
                v = v * 7
            rows.append((day(i), f"s{s}", *map(float, v[:3]), float(v[3]) if i < 110 else None))
    return spark.createDataFrame(rows, "date date, symbol string, rv_1 double, rv_5 double, rv_22 double, rv_fwd double")


def test_har_matches_a_refit_loop(spark):
    panel = har_panel(spark)
    got = {(r.date, r.symbol): r.rv_fcst for r in har.har_forecast(panel, forward=20, min_rows=100).collect()}
    frame = panel.toPandas()
    x, y = np.log(frame[["rv_1", "rv_5", "rv_22"]].to_numpy()), np.log(frame.rv_fwd.to_numpy() ** 2)
    days = sorted(frame.date.unique())
    refits = [d for i, d in enumerate(days) if i == 0 or d.month != days[i - 1].month]
    want, beta = {}, None
    for i, d in enumerate(days):
        if d in refits and i >= 20:
            own = (frame.date <= days[i - 20]).to_numpy() & ~np.isnan(y)
            if own.sum() >= 100:
                design = np.column_stack([np.ones(own.sum()), x[own]])
                beta = np.linalg.lstsq(design, y[own], rcond=None)[0]
                spread = np.var(y[own] - design @ beta)
        if beta is not None:
            for k in np.flatnonzero((frame.date == d).to_numpy()):
                want[d, frame.symbol[k]] = np.sqrt(np.exp(beta[0] + x[k] @ beta[1:] + spread / 2))
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), atol=1e-9)


def test_har_does_not_look_ahead(spark):
    run = lambda s: {(r.date, r.symbol): r.rv_fcst for r in har.har_forecast(har_panel(spark, scramble=s), forward=20, min_rows=100).filter(F.col("date") <= day(80)).collect()}
    a, b = run(False), run(True)
    assert a and a.keys() == b.keys() and np.allclose([a[k] for k in a], [b[k] for k in a], atol=1e-12)


def factor_panel(spark):
    rng = np.random.default_rng(4)
    n, rows = 200, []
    market, sector = rng.normal(0, 1, n), rng.normal(0, 0.5, (n, 2))
    for s in range(12):
        b, c = 0.5 + s / 12, 1.0
        own = b * market + c * sector[:, s % 2] + rng.normal(0, 0.3, n)
        rows += [(day(i), f"n{s:02}", float(own[i]), 1.0) for i in range(n)]
    returns = spark.createDataFrame(rows, "date date, symbol string, pnl_per_vega double, dollar_vega double")
    sectors = spark.createDataFrame([(f"n{s:02}", f"sec{s % 2}") for s in range(12)], "symbol string, sector string")
    return returns, sectors


def test_sector_factors_are_orthogonal_and_covariance_is_psd(spark):
    returns, sectors = factor_panel(spark)
    factors = risk.factor_returns(returns, sectors)
    wide = factors.toPandas().pivot(index="date", columns="factor", values="ret")
    assert all(abs(np.corrcoef(wide.MKT, wide[c])[0, 1]) < 1e-8 for c in ("sec0", "sec1"))
    cov = risk.factor_covariances(factors, 100, 50)
    shrunk = risk.shrink(cov)
    last = wide.index.max()
    a, b = (t.filter(F.col("date") == last).toPandas().pivot(index="factor_1", columns="factor_2", values="covariance").to_numpy() for t in (cov, shrunk))
    assert abs(np.trace(a) - np.trace(b)) < 1e-9 and abs(b[0, 1]) <= abs(a[0, 1]) and np.linalg.eigvalsh(b).min() > 0
    loadings, idio = risk.rolling_loadings(returns, factors, sectors, 100, 50)
    model = risk.model_covariance(*(risk.model_as_of(t, str(last)) for t in (loadings, shrunk, idio))).toPandas()
    full = model.pivot(index="symbol_1", columns="symbol_2", values="covariance").to_numpy()
    assert full.shape == (12, 12) and np.allclose(full, full.T) and np.linalg.eigvalsh(full).min() > 0
    assert risk.missing_names(returns, idio).isEmpty()


def test_rank_book_is_neutral_and_gross_exact(spark):
    scores = spark.createDataFrame([(D, f"s{i}", float(i)) for i in range(10)] + [(D, "none", None)], "date date, symbol string, signal double")
    got = {r.symbol: r.target_vega for r in pnl.rank_targets(scores).collect()}
    assert len(got) == 10 and abs(sum(got.values())) < 1e-9 and abs(sum(map(abs, got.values())) - 1000) < 1e-9 and got["s9"] < 0
    many = spark.createDataFrame([(D, f"s{i}", float(i)) for i in range(20)], "date date, symbol string, signal double")
    tails = {r.symbol: r.target_vega for r in pnl.rank_targets(many, scheme="quantile").collect() if r.target_vega}
    assert tails == {"s0": 250.0, "s1": 250.0, "s18": -250.0, "s19": -250.0}


def test_a_missing_row_closes_a_name_until_the_next_rebalance(spark):
    rows = [(day(i), "a", 1.0, 0.0, 0.0, 2.0, 2.0, "") for i in range(6) if i != 3]
    reference = spark.createDataFrame([*rows, *((day(i), "b", 0.0, 0.0, 0.0, 1.0, 1.0, "") for i in range(6))], "date date, symbol string, pnl_per_vega double, cost_per_vega double, exit_cost_per_vega double, entry_vega double, dollar_vega double, event string")
    rebalances = spark.createDataFrame([(day(i),) for i in (0, 4)], "date date")
    targets = spark.createDataFrame([(day(0), "a", 10.0), (day(4), "a", 10.0)], "date date, symbol string, target_vega double")
    got = {(r.date - D).days: r for r in pnl.book(reference, targets, rebalances).filter("symbol = 'a'").collect()}
    assert got[2].units == 5 and got[2].option_pnl == 10 and got[3].units == 0 and got[3].event == "forced_close" and got[3].stale
    assert got[4].units == 5 and got[4].event == "open" and got[4].option_pnl == 0


def unit_loop(quotes: pd.DataFrame, picks: dict, roll, stale_most):
    """The rolled unit of one name, session by session."""
    out, unit, stale = [], None, 0
    marks = {}
    usable = quotes[(quotes.ask > 0) & (quotes.bid >= 0) & (quotes.ask >= quotes.bid)]
    for key, g in usable.groupby(["date", "expiration", "strike"]):
        if len(g) >= 2:
            marks[key] = True
    for d in sorted(quotes.date.unique()):
        if unit is not None:
            if (d, *unit[1:]) in marks:
                stale = 0
                event = "roll" if (unit[1] - d).days <= roll else ""
            else:
                stale += 1
                event = "forced_close" if stale > stale_most or d >= unit[1] else ""
            out.append((d, unit[0], event))
            if event:
                unit = None
        if unit is None and d in picks:
            unit, stale = (d, *picks[d]), 0
            out.append((d, d, "open"))
    return sorted(out)


def test_reference_unit_matches_a_session_loop(spark):
    rng = np.random.default_rng(7)
    rows = []
    for n in range(0, 40):
        for k in (20, 34, 48, 62):
            expiration = day((n * 3 + k) // 14 * 14)
            for strike in (95.0, 100.0, 105.0):
                for right in "CP":
                    if rng.random() < 0.7:
                        rows.append((day(n * 3), "a", expiration, strike, right, float(rng.random() + 0.5), 2.0, 0.3, 100.0, 0.5 if right == "C" else -0.5))
    chain = spark.createDataFrame(rows, "date date, symbol string, expiration date, strike double, right string, bid double, ask double, iv double, underlying double, delta double").dropDuplicates(["date", "expiration", "strike", "right"])
    chain = chain.orderBy("date").persist()
    got = sorted((r.date, r.opened, r.event) for r in pnl.reference_unit(chain, 14, 2, 15, 90, 40).collect())
    picks = {r.date: (r.expiration, r.strike) for r in pick_straddles(chain, 15, 90, 40, 1.0).collect()}
    assert got == unit_loop(chain.toPandas(), picks, 14, 2)
    assert {"roll", "open"} <= {x[2] for x in got}


def record_loop(quotes: pd.DataFrame, picks: dict, roll, most):
    """One contract a name, session by session: marks, roll, reopening, hedge; then P&L and costs over inception vega."""
    out = []
    for symbol, own in quotes.groupby("symbol"):
        marks, spots = {}, {}
        for d, day_rows in own.groupby("date"):
            spots[d] = day_rows.sort_values(["expiration", "strike", "right"]).underlying.iloc[0]
            usable = day_rows[(day_rows.ask > 0) & (day_rows.bid >= 0) & (day_rows.ask >= day_rows.bid)]
            for key, g in usable.groupby(["expiration", "strike"]):
                if len(g) >= 2:
                    marks[(d, *key)] = {"mid": (g.bid.sum() + g.ask.sum()) / 2, "half": (g.ask.sum() - g.bid.sum()) / 2, "delta": g.delta.sum(), "vega": g.vega.sum()}
        unit, last, shares, stale, inception = None, None, 0.0, 0, None
        for d in sorted(spots):
            entry, event, closed = inception, None, False
            row = {"option_pnl": 0.0, "hedge_pnl": 0.0, "option_cost": 0.0, "hedge_cost": 0.0}
            mark = None
            if unit is not None:
                event = ""
                row["hedge_pnl"] = shares * (spots[d] - spot)
                mark = marks.get((d, *unit))
                if mark is None:
                    stale += 1
                    if stale > most or d >= unit[0]:
                        event, closed = "forced_close", True
                        row["hedge_cost"] += abs(shares) * 0.005
                        unit, shares = None, 0.0
                else:
                    stale = 0
                    row["option_pnl"] = (mark["mid"] - last["mid"]) * 100
                    last = mark
                    if (unit[0] - d).days <= roll:
                        row["option_cost"] += mark["half"] * 100
                        new = picks.get((symbol, d))
                        if new is None:
                            event, closed = "roll_failed_closed", True
                            row["hedge_cost"] += abs(shares) * 0.005
                            unit, shares, mark = None, 0.0, None
                        else:
                            event, unit, mark = "roll", new, marks[(d, *new)]
                            last = mark
                            row["option_cost"] += mark["half"] * 100
            if unit is None and (symbol, d) in picks:
                event, unit, stale, closed = "open", picks[symbol, d], 0, False
                mark = last = marks[(d, *unit)]
                row["option_cost"] += mark["half"] * 100
            if event is None:
                continue
            if unit is not None and mark is not None:
                row["hedge_cost"] += abs(-mark["delta"] * 100 - shares) * 0.005
                shares = -mark["delta"] * 100
            spot = spots[d]
            vega = 0.0 if unit is None else last["vega"] * 100
            if event in ("open", "roll"):
                inception = vega
            over = lambda v, w: v / w if w is not None and w > 0 else None
            leave = mark["half"] * 100 if unit is not None and mark is not None else 0.0
            out.append((symbol, d, event, over(row["option_pnl"] + row["hedge_pnl"], entry), over(row["option_cost"] + row["hedge_cost"], entry), over(leave, inception), vega, entry))
    return sorted(out)


def test_unit_returns_match_a_session_loop_over_several_names(spark):
    rng = np.random.default_rng(17)
    rows = []
    # d has one expiration at a time, so there is nothing to roll into
    rows += [(day(n * 3), "d", day(n * 3 // 60 * 60 + 60), 100.0, right, 1.0 + n % 3, 4.0, 0.3, 100.0 + n, 0.4, 0.2) for n in range(60) for right in "CP"]
    for symbol in "abc":
        for n in range(60):
            if rng.random() < 0.1:
                continue
            spot = float(100 + rng.normal())
            for k in (20, 34, 48, 62):
                expiration = day((n * 3 + k) // 14 * 14)
                for strike in (95.0, 100.0, 105.0):
                    for right in "CP":
                        if rng.random() < (0.3 if symbol == "c" else 0.75):
                            rows.append((day(n * 3), symbol, expiration, strike, right, float(rng.random() + 0.5), 2.0, 0.3, spot, float(rng.random() - (0 if right == "C" else 1)), float(rng.random())))
    chain = spark.createDataFrame(rows, "date date, symbol string, expiration date, strike double, right string, bid double, ask double, iv double, underlying double, delta double, vega double").dropDuplicates(["date", "symbol", "expiration", "strike", "right"]).persist()
    path = pnl.reference_unit(chain, 14, 2, 15, 90, 40)
    got = sorted((r.symbol, r.date, r.event, r.pnl_per_vega, r.cost_per_vega, r.exit_cost_per_vega, r.dollar_vega, r.entry_vega) for r in pnl.per_vega(pnl.unit_records(path)).collect())
    picks = {(r.symbol, r.date): (r.expiration, r.strike) for r in pick_straddles(chain, 15, 90, 40, 1.0).collect()}
    want = record_loop(chain.toPandas(), picks, 14, 2)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    for a, b in zip(got, want):
        assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(a[3:], b[3:])), (a, b)
    assert {"open", "roll", "", "forced_close", "roll_failed_closed"} <= {x[2] for x in got}, {x[2] for x in got}


def test_book_factors_match_least_squares(spark):
    rng = np.random.default_rng(23)
    n = 80
    x, vega = rng.normal(size=(n, 4)), rng.uniform(1, 3, n)
    x[:, 2] = x[:, 0] - x[:, 1]  # collinear: the least-norm solution
    y = 0.3 + x @ [1.0, -0.5, 0.2, 2.0] + rng.normal(0, 0.1, n)
    daily = spark.createDataFrame([(day(i), float(y[i] * vega[i]), float(vega[i])) for i in range(n)] + [(day(n), 5.0, 0.0)], "date date, net_pnl double, gross_vega double")
    factors = spark.createDataFrame([(day(i), f"f{k}", float(x[i, k])) for i in range(n + 1) for k in range(3) if i < n], "date date, factor string, ret double")
    market = spark.createDataFrame([(day(i), float(x[i, 3])) for i in range(n)], "date date, market_return double")
    got = reports.book_factors(daily, factors, market).toPandas()
    design = np.column_stack([np.ones(n), x - x.mean(axis=0)])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    left = y - design @ beta
    error = np.sqrt(np.diag(left @ left / (n - 5) * np.linalg.pinv(design.T @ design)))
    assert list(got.regressor) == ["const", "f0", "f1", "f2", "index_return"] and set(got.observations) == {n}
    assert np.allclose(got.coefficient[1:], beta[1:], atol=1e-9) and np.allclose(got.t_stat[1:], beta[1:] / error[1:], rtol=1e-6)
    assert np.allclose(got.r_squared, 1 - left @ left / np.sum((y - y.mean()) ** 2))


def test_a_held_name_stays_eligible_and_a_zero_target_does_not(spark):
    pairs = lambda rows: spark.createDataFrame([(day(d), s) for d, s in rows], "date date, symbol string")
    scores = spark.createDataFrame([(day(d), s, 1.0) for d in (0, 1) for s in "abcd"], "date date, symbol string, signal double")
    records = spark.createDataFrame([(day(0), "a", 2.0), (day(0), "b", 0.0), (day(1), "a", 2.0)], "date date, symbol string, units double")
    got = pnl.eligible_scores(scores, pairs([(d, s) for d in (0, 1) for s in "abc"]), pairs([(0, "a"), (0, "b"), (1, "c"), (1, "d")]), pnl.held_before(records))
    assert sorted(((r.date - D).days, r.symbol) for r in got.collect()) == [(0, "a"), (0, "b"), (1, "a"), (1, "c")]


def test_implied_vol_finds_the_volatility_again(spark):
    df = spark.createDataFrame([(100.0, k, 0.5, v, c) for k in (80.0, 100.0, 120.0) for v in (0.15, 0.6) for c in (True, False)] + [(100.0, 100.0, 0.0, 0.3, True)], "s double, k double, t double, v double, c boolean")
    rows = pricing.with_greeks(df, "s", "k", "t", "v", "c").withColumn("found", pricing.implied_vol("price", "s", "k", "t", "c", F.lit(0.0))).collect()
    assert all(abs(r.found - r.v) < 1e-5 for r in rows if r.t > 0) and all(r.price is None and r.found is None for r in rows if r.t == 0)
    call, put = (next(r for r in rows if r.k == 120.0 and r.v == 0.6 and r.c is c) for c in (True, False))
    assert abs(call.price - put.price - (100 - 120)) < 1e-9 and abs(call.delta - put.delta - 1) < 1e-12


def test_summary_has_no_certainty_equivalent_of_ruin(spark):
    rows = spark.createDataFrame([(0.1,), (-1.5,), (None,)], "v double").agg(*reports.summary_columns(F.col("v"))).first()
    assert rows.months == 2 and rows.ce_gamma3 is None and rows["min"] == -1.5
    fine = spark.createDataFrame([(0.1,), (0.1,)], "v double").agg(*reports.summary_columns(F.col("v"))).first()
    assert abs(fine.ce_gamma3 - 0.1) < 1e-12 and fine.t_stat is None


@pytest.mark.parametrize("least,kept", [(1, 1), (5, 0)])
def test_decile_spread_needs_both_ends(spark, least, kept):
    panel = spark.createDataFrame([("m", 1, 0.1), ("m", 10, 0.4), ("n", 1, 0.2)], "month string, decile int, ret double")
    spread = reports.portfolio_returns(panel, ["ret"]).filter("decile = 0").collect()
    assert len(spread) == 1 and abs(spread[0].ret - 0.3) < 1e-12 and spread[0].names == 2
