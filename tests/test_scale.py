"""Odd values, and steps that must not grow faster than their tables."""

import math
import re
from datetime import date, datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tenorlake.operators import book_studies, joins, pnl, reports, risk, vol
from tenorlake.plans import catalog
from tenorlake.sources import roles

DAY = date(2024, 1, 1)


def test_actions_of_any_value_are_kept(spark, tmp_path):
    rows = [("purchase", 0.0), ("purchase", None), ("purchase", 3.5), ("signup", 9.0), ("view", 4.0), (None, 5.0)]
    events = spark.createDataFrame([(i, datetime(2024, 1, 2, i), 7, k, v) for i, (k, v) in enumerate(rows)], "event_id long, ts timestamp, user_id long, event_type string, value double")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.QUERIES["m22_action_table"](spark, str(tmp_path)).collect()
    assert sorted((r.action, str(r.value)) for r in got) == [("dividend", "0.0"), ("dividend", "3.5"), ("dividend", "None"), ("split", "2.0")]


def test_return_after_a_price_of_zero_is_infinite(spark):
    closes = [0.0, 2.0, 0.0, 0.0, -1.0, None, 1.0]
    rows = spark.createDataFrame([("A", DAY + timedelta(i), c) for i, c in enumerate(closes)], "symbol string, date date, close double")
    got = [r.ret for r in rows.select("date", vol.split_adjusted_return().alias("ret")).orderBy("date").collect()]
    assert got[0] is None and got[1] == math.inf and got[2] == -1.0 and math.isnan(got[3]) and got[4] == -math.inf and got[5] is None and got[6] is None


def test_returns_are_rounded_as_in_their_sql(spark, tmp_path):
    # quotients next to halves of the last digit, on either side; a day whose last value is missing; closes beyond the last digit; zeros
    closes = [25.6, 38.52, 160.0, 77.23, 320.0, 155.74, 32.0, 162.95, 6.4, 220.47, 1.28, 0.01, 0.0, 0.0, 3.0, 0.0000005, 1.0000015, 2.0000025, 9e9 + 0.1234565, None, 4.0]
    rows = [(i, datetime(2024, 1, 1, 9) + timedelta(i), i // 17, "view", c) for i, c in enumerate(closes)]
    rows += [(100 + i, datetime(2024, 1, 1, 10) + timedelta(i), i // 17, "signup" if i % 5 == 4 else "view", None) for i in range(len(closes))]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    name = "r2_split_adjusted_return"
    want = sorted((s, d, str(v)) for s, d, v in con.execute(f"select symbol, date, ret from ({catalog.ORACLES[name]})").fetchall())
    assert sorted((r.symbol, r.date, str(r.ret)) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()) == want


def test_model_covariance_shuffles_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(risk, "BLOCK", 7, raising=False)
    rng = np.random.default_rng(5)
    names, factors, days = [f"n{i:02}" for i in range(40)], ["MKT", "a", "b"], [DAY, DAY + timedelta(1)]
    loads = {(d, n): {"MKT": rng.normal(), "ab"[i % 2]: rng.normal()} for d in days for i, n in enumerate(names)}
    del loads[days[1], "n00"]
    # a name that shares no factor with half of the others
    del loads[days[0], "n01"]["MKT"]
    cov = {d: np.cov(rng.normal(size=(3, 30))) for d in days}
    cov[days[0]][2, 1] = cov[days[0]][1, 2] = 0.0
    loadings = spark.createDataFrame([(d, n, f, float(v)) for (d, n), own in loads.items() for f, v in own.items()], "date date, symbol string, factor string, loading double")
    matrix = spark.createDataFrame([(d, f, g, float(cov[d][i, j])) for d in days for i, f in enumerate(factors) for j, g in enumerate(factors)], "date date, factor_1 string, factor_2 string, covariance double")
    idio = spark.createDataFrame([(d, n, 0.5 + i) for d in days for i, n in enumerate(names) if n != "n02"], "date date, symbol string, idio_vol double")
    out = risk.model_covariance(loadings, matrix, idio)
    got = {(r.date, r.symbol_1, r.symbol_2): r.covariance for r in out.collect()}
    row = lambda d, n: np.array([loads[d, n].get(f, 0.0) for f in factors])
    want = {(d, n, m): row(d, n) @ cov[d] @ row(d, m) + ((0.5 + i) ** 2 if n == m and n != "n02" else 0.0) for d in days for i, n in enumerate(names) for m in names if (d, n) in loads and (d, m) in loads}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), atol=1e-9)
    # nothing keyed by both names of a pair is grouped or shuffled
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in plan if ("Aggregate" in x or "Repartition" in x) and "symbol_1" in x and "symbol_2" in x]


def test_model_covariance_sends_names_in_proportion(spark):
    # 90,000 names, as many as make more blocks than 16 if blocks don't grow; only planned
    names = spark.range(90_000).select(F.lit(DAY).alias("date"), F.col("id").cast("string").alias("symbol"))
    matrix = spark.createDataFrame([(DAY, "MKT", "MKT", 2.0)], "date date, factor_1 string, factor_2 string, covariance double")
    out = risk.model_covariance(names.withColumns({"factor": F.lit("MKT"), "loading": F.lit(1.5)}), matrix, names.withColumn("idio_vol", F.lit(0.5)))
    blocks = [int(n) for n in re.findall(r"pmod\(xxhash64\(symbol_[12]#\d+, 42\), (\d+)\) as int\) AS _", out._jdf.queryExecution().optimizedPlan().toString())]
    assert len(blocks) == 2 and set(blocks) == {16}


def test_model_covariance_plans_small_tables_alone(spark, sf_dir):
    # the plans of the whole model were logged again after each stage, hundreds of MB of disk
    plan = catalog.QUERIES["m16_model_covariance"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "InMemoryRelation" not in plan and "Window" not in plan and len(plan) < 200_000


def test_ranks_of_forecasts_are_dealt_to_ranges(spark, monkeypatch):
    monkeypatch.setattr(reports, "TASK_ROWS", 300, raising=False)
    rng = np.random.default_rng(6)
    # ties within and across the ranges, rows that count for one predictor only
    frame = pd.DataFrame({"actual": rng.integers(0, 40, 900) / 8, "p": rng.integers(-5, 300, 900) / 8, "q": np.where(rng.random(900) < 0.4, 1.5, rng.random(900))})
    out = reports.forecast_quality(spark.createDataFrame(frame).repartition(5), "actual", ["p", "q"])
    for r in out.collect():
        own = frame[(frame.actual > 0) & (frame[r.predictor] > 0)]
        error = np.log(own[r.predictor]) - np.log(own.actual)
        assert r.n == len(own) and np.isclose(r.spearman, own.actual.rank().corr(own[r.predictor].rank()), atol=1e-12)
        assert np.allclose([r.mean_log_error, r.rms_log_error], [error.mean(), np.sqrt((error**2).mean())])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(predictor#" not in plan.replace("\n", "") or "_part#" in plan


def test_chain_is_laid_out_by_symbol_once(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(roles, "LINES", 1000, raising=False)
    out = catalog.QUERIES["t2_straddle_pick"](spark, sf_dir)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    exchanges = [x for x in plan.splitlines() if "Exchange " in x]
    # one shuffle, into partitions that follow the rows, for the chain, the pairs and the picks
    assert len(exchanges) == 1 and "hashpartitioning(symbol" in exchanges[0] and ", 6)" in exchanges[0]


def test_monthly_bars_are_made_once_and_lie_by_symbol(spark, sf_dir):
    r = roles.Roles(spark, sf_dir)
    r.parts = 3
    assert r.xs_bars.count()
    plan = r.xs_bars.withColumn("before", F.lag("close").over(Window.partitionBy("symbol").orderBy("date")))._jdf.queryExecution()
    # kept once, however often it is read, and a window by symbol shuffles nothing
    assert "InMemoryRelation" in plan.optimizedPlan().toString()
    outside = plan.executedPlan().toString().split("InMemoryRelation")[0]
    assert "Exchange" not in outside
    assert r.xs_bars.rdd.getNumPartitions() == 3


def test_sweep_runs_its_books_once(spark, monkeypatch):
    runs = []
    rng = np.random.default_rng(8)
    days = [DAY + timedelta(i) for i in range(12)]
    rows = [(d, f"n{i:02}", float(rng.normal()), 0.01, 0.02, 1.0, 1.0, "") for d in days for i in range(60)]
    reference = spark.createDataFrame(rows, "date date, symbol string, pnl_per_vega double, cost_per_vega double, exit_cost_per_vega double, dollar_vega double, entry_vega double, event string")
    factors = spark.createDataFrame([(d, "MKT", float(rng.normal())) for d in days], "date date, factor string, ret double")
    monkeypatch.setattr(book_studies, "checkpointed", lambda df: runs.append(df) or df.localCheckpoint(), raising=False)
    summary, deciles = book_studies.window_sweep(reference, {"2": (2, 0), "3": (3, 0)}, 2, reference.select("date").distinct(), factors, "MKT")
    # the books' days are settled once, and what is made of them holds no book any more
    assert len(runs) == 1 and runs[0].columns[:2] == ["label", "date"]
    assert "units" not in summary.select("label", "sharpe", "net_pnl_full_cost", "market_loading")._jdf.queryExecution().optimizedPlan().toString()
    assert {r.label for r in summary.collect()} == {"2", "3"} == {r.label for r in deciles.collect()}


def test_both_sides_are_stale_by_one_lookup(spark):
    rows = [(DAY, "A", 1.0, 5.0), (DAY + timedelta(28), "A", 1.0, 6.0), (DAY + timedelta(28), "B", 1.0, 6.0), (DAY + timedelta(56), "A", None, 6.0)]
    wide = spark.createDataFrame(rows, "date date, symbol string, call_bid double, put_bid double")
    days = wide.select("date", F.date_sub("date", 28).alias("previous")).distinct()
    out = joins.mark_stale(wide, days, ["symbol"], {"call_stale": ["call_bid"], "put_stale": ["put_bid"]})
    assert {(r.symbol, (r.date - DAY).days): (r.call_stale, r.put_stale) for r in out.collect()} == {("A", 0): (False, False), ("A", 28): (True, False), ("B", 28): (False, False), ("A", 56): (False, True)}


def test_lookups_of_the_unit_are_tasks_of_their_own(spark, sf_dir, monkeypatch):
    seen = []
    follow = pnl.follow
    monkeypatch.setattr(pnl, "follow", lambda rows, *a: seen.append(rows) or follow(rows, *a))
    pnl.reference_unit(roles.Roles(spark, sf_dir).chain, 14, 5, 14, 90, 45)
    # a union for each lookup: only the last one is left to do
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert sum(x.strip(" :+-").startswith("Union") for x in plan.splitlines()) == 1
