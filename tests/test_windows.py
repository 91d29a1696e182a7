import time
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tenorlake.functions.windows import ahead, average_rank, bucket, by, quantiles, rolling, zscore
from tenorlake.operators.rolling import SortedWindow, rolling_quantile
from tenorlake.operators import vol

DAY = date(2024, 1, 1)


def series(spark, values, symbol="A"):
    return spark.createDataFrame([(symbol, DAY + timedelta(i), v) for i, v in enumerate(values)], "symbol string, date date, x double")


def test_rolling_needs_its_number_of_values(spark):
    rows = series(spark, [1.0, None, 3.0, 4.0, 5.0]).withColumn("m", rolling(F.avg, F.col("x"), by("symbol"), 3)).withColumn("k", rolling(F.avg, F.col("x"), by("symbol"), 3, 2))
    got = [(r.m, r.k) for r in rows.orderBy("date").collect()]
    assert got == [(None, None), (None, None), (None, 2.0), (None, 3.5), (4.0, 4.0)]


def test_past_window_skips_the_last_rows(spark):
    rows = series(spark, [1.0, 2.0, 4.0, 100.0]).withColumn("s", rolling(F.sum, F.col("x"), by("symbol"), 2, skip=1))
    assert [r.s for r in rows.orderBy("date").collect()] == [None, None, 3.0, 6.0]


def test_ahead_is_null_until_the_window_has_closed(spark):
    rows = series(spark, [1.0, 2.0, 4.0]).withColumn("s", ahead(F.sum, F.col("x"), by("symbol"), 2))
    assert [r.s for r in rows.orderBy("date").collect()] == [6.0, None, None]


def test_average_rank_shares_ties(spark):
    rows = series(spark, [3.0, 1.0, 3.0, None]).withColumn("r", average_rank("x", "symbol"))
    assert [r.r for r in rows.orderBy("date").collect()] == [2.5, 1.0, 2.5, None]


@pytest.mark.parametrize("method,want", [("floor", [1, 1, 1, 1, 2, 2, 2, 3, 3, 3]), ("ceil", [1, 1, 1, 2, 2, 2, 3, 3, 3, 3])])
def test_buckets_place_the_remainder_by_method(spark, method, want):
    df = spark.createDataFrame([("d", f"s{i}", float(i)) for i in range(10)], "date string, symbol string, x double")
    assert [r.b for r in df.withColumn("b", bucket("x", ["date"], 3, method)).orderBy("x").collect()] == want


def test_nearest_quantile_takes_an_element(spark):
    got = quantiles(series(spark, [4.0, 1.0, 3.0, 2.0, None]), ["symbol"], "x", {"q": 0.25, "top": 1.0}, "nearest").first()
    assert (got.q, got.top) == (2.0, 4.0)


def test_quantiles_are_exact_by_key(spark):
    rng = np.random.default_rng(3)
    groups = {f"n{n}": rng.normal(100, 30, n) for n in [*range(1, 51), 300, 5000]}
    groups |= {"ties": rng.integers(0, 4, 3000).astype(float), "one value": np.full(700, 2.5), "hot": np.concatenate((np.full(9000, 1.0), rng.normal(size=31_000))), "far": np.array([-1e300, -1.0, 0.0, 1e-300, 1e300]), "from ten": np.arange(10.0, 15.0)}
    df = spark.createDataFrame(pd.DataFrame({"k": np.repeat(list(groups), [len(v) for v in groups.values()]), "x": np.concatenate(list(groups.values()))})).unionByName(spark.createDataFrame([("n1", None), ("none", None)], "k string, x double")).repartition(7)
    wanted = {f"q{i}": i / 12 for i in range(13)} | {"q999": 0.999}
    got = {r.k: r for r in quantiles(df, ["k"], "x", wanted).collect()}
    nearest = {r.k: r for r in quantiles(df, ["k"], "x", wanted, "nearest").collect()}
    assert set(got) == set(groups) == set(nearest)
    for k, values in groups.items():
        ordered = np.sort(values)
        for name, q in wanted.items():
            want = np.quantile(values, q)
            assert abs(got[k][name] - want) <= 1e-12 * max(1, abs(want)), (k, name)
            place = q * (len(values) - 1)
            assert nearest[k][name] == ordered[int(np.floor(place + 0.5))], (k, name)


@pytest.mark.parametrize("q", [0.0, 1 / 3, 0.5, 2 / 3, 1.0])
def test_quantiles_of_a_whole_table(spark, q):
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=5000), rng.integers(0, 4, 300).astype(float), np.array([7.0]), np.arange(10.0, 30.0)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
        assert abs(quantiles(df, [], "x", {"v": q}).first().v - np.quantile(values, q)) < 1e-12


def test_zscore_has_mean_zero_and_deviation_one(spark):
    z = np.array([r.z for r in series(spark, [1.0, 2.0, 3.0, 7.0]).withColumn("z", zscore("x", "symbol")).collect()])
    assert abs(z.mean()) < 1e-12 and abs(z.std(ddof=1) - 1) < 1e-12
    assert series(spark, [2.0, 2.0]).withColumn("z", zscore("x", "symbol")).first().z is None


def test_excluded_sessions_leave_the_window(spark):
    close = [100 * 1.01**i * (1.1 if i >= 10 else 1.0) for i in range(30)]
    bars = series(spark, close).withColumnRenamed("x", "close")
    jump = spark.createDataFrame([("A", DAY + timedelta(10))], "symbol string, date date")
    got = vol.close_to_close_panel(bars, (1, 5), 5, jump).orderBy("date").collect()
    steady = np.log(1.01) * np.sqrt(252)
    assert got[10].rv_1 is None and abs(got[12].rv_5 - steady) < 1e-9 and abs(got[8].rv_fwd - steady) < 1e-9


def test_yang_zhang_is_near_the_simulated_volatility(spark):
    rng = np.random.default_rng(5)
    steps = rng.normal(0, 0.2 / np.sqrt(252 * 50), (400, 50)).cumsum(axis=1)
    start, rows = 0.0, []
    for i, path in enumerate(steps):
        p = np.exp(start + path) * 100
        rows.append(("A", DAY + timedelta(i), float(100 * np.exp(start)), float(max(p.max(), 100 * np.exp(start))), float(min(p.min(), 100 * np.exp(start))), float(p[-1])))
        start += path[-1]
    bars = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double")
    mean = vol.yang_zhang_panel(bars, (22,), 22).agg(F.avg("rv_22")).first()[0]
    assert 0.15 < mean < 0.22


@pytest.mark.parametrize("window,least,skip,q", [(1, 1, 0, 0.5), (5, 3, 1, 0.5), (30, 1, 0, 0.25), (60, 20, 2, 0.9)])
def test_rolling_quantiles_match_numpy(spark, window, least, skip, q):
    rng = np.random.default_rng(window)
    names = {s: [None if rng.random() < 0.1 else float(rng.integers(0, 9)) + (0.5 if rng.random() < 0.3 else 0.0) for _ in range(n)] for s, n in (("A", 150), ("B", 1), ("C", 90))}
    names["A"][70] = float("nan")
    rows = [(s, DAY + timedelta(i), v, "k") for s, values in names.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "symbol string, date date, x double, tag string").repartition(6)
    got = {(r.symbol, r.date): r.m for r in rolling_quantile(df, "x", "m", window, least, q, skip).collect()}
    assert len(got) == len(rows)
    for s, values in names.items():
        for i in range(len(values)):
            own = [v for v in values[max(0, i - skip - window + 1) : max(0, i - skip + 1)] if v is not None and v == v]
            want = np.quantile(own, q) if len(own) >= least and own else None
            have = got[s, DAY + timedelta(i)]
            assert (want is None and have is None) or abs(have - want) < 1e-12, (s, i)


def test_a_long_window_costs_about_what_a_short_one_does(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=120_000).tolist()

    def seconds(size):
        window, start = SortedWindow(size), time.process_time()
        for v in values:
            window.push(v)
            window.quantile(0.5)
        return time.process_time() - start

    assert seconds(2500) < 6 * seconds(250)
    df = spark.range(40_000).select(F.lit("A").alias("symbol"), F.col("id").alias("date"), F.rand(3).alias("x"))
    assert rolling_quantile(df, "x", "m", 2500, 20).filter("m is not null").count() == 40_000 - 19
