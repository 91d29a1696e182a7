"""Versioned tables: readers while a table is replaced, writers that die or meet, and bucketed tables."""

import threading
from datetime import date, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tenorlake.functions.windows import rolling
from tenorlake.operators import regress
from tenorlake.operators.asof import next_on_buckets
from tenorlake.sources import store

D = date(2024, 1, 1)


def rows_of(spark, year, value, n=40):
    return spark.range(n).select(F.lit(year).alias("year"), F.col("id").alias("k"), F.lit(value).alias("v"))


def test_readers_see_one_whole_state_while_a_writer_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    store.write_table(rows_of(spark, 2024, 0), path)
    seen, failed, done = set(), [], threading.Event()

    def read():
        while not done.is_set():
            try:
                got = store.require(spark, path, "job").groupBy("v").count().collect()
                assert len(got) == 1 and got[0]["count"] == 40
                seen.add(got[0].v)
            except Exception as e:  # noqa: BLE001
                failed.append(e)
                return

    readers = [threading.Thread(target=read) for _ in range(2)]
    for t in readers:
        t.start()
    for value in range(1, 12):
        store.write_table(rows_of(spark, 2024, value), path)
    done.set()
    for t in readers:
        t.join()
    assert not failed and len(seen) > 1
    assert {r.v for r in store.require(spark, path, "job").collect()} == {11}


def test_a_writer_that_dies_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    store.write_table(rows_of(spark, 2024, 1), path)
    with monkeypatch.context() as m:
        m.setattr(store, "commit", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.write_table(rows_of(spark, 2024, 2), path)
        with pytest.raises(KeyboardInterrupt):
            store.replace_years(rows_of(spark, 2024, 3), path)
    assert {r.v for r in store.require(spark, path, "job").collect()} == {1}
    folders = lambda: {p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")}
    assert len(folders()) == 3
    # what no commit names goes once it is old
    store.vacuum(spark, path, retain=-10)
    assert len(folders()) == 1 and {r.v for r in store.require(spark, path, "job").collect()} == {1}


def test_writers_of_different_years_keep_each_others(spark, tmp_path):
    path = str(tmp_path / "t")
    store.write_table(rows_of(spark, 2020, 0).unionByName(rows_of(spark, 2021, 0)).unionByName(rows_of(spark, 2022, 0)), path, ["year"])
    assert store.available_years(spark, str(tmp_path), "t") == [2020, 2021, 2022]
    failed = []

    def replace(year):
        try:
            store.replace_years(rows_of(spark, year, year, 5), path)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    writers = [threading.Thread(target=replace, args=(y,)) for y in (2020, 2022, 2023)]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    assert not failed
    got = {(r.year, r.v): r["count"] for r in store.require(spark, path, "job").groupBy("year", "v").count().collect()}
    assert got == {(2020, 2020): 5, (2021, 0): 40, (2022, 2022): 5, (2023, 2023): 5}
    assert store.available_years(spark, str(tmp_path), "t") == [2020, 2021, 2022, 2023]


def test_years_of_a_table_without_commits_are_replaced(spark, tmp_path):
    path = str(tmp_path / "plain")
    rows_of(spark, 2020, 0).unionByName(rows_of(spark, 2021, 0)).write.partitionBy("year").parquet(path)
    store.replace_years(rows_of(spark, 2021, 9, 3), path)
    assert {(r.year, r.v) for r in store.require(spark, path, "job").collect()} == {(2020, 0), (2021, 9)}
    store.replace_years(rows_of(spark, 2021, 9, 3).filter("false"), path)
    assert store.require(spark, path, "job").count() == 43


def test_inventory_counts_only_what_is_current(spark, tmp_path):
    df = spark.createDataFrame([(2020, "A", 1), (2020, "B", 2), (2021, "A", 3)], "year int, symbol string, v int")
    store.write_table(df, str(tmp_path / "chain"), ["year", "symbol"])
    store.replace_years(df.filter("year = 2021"), str(tmp_path / "chain"))
    store.write_table(df.coalesce(1), str(tmp_path / "plain"))
    got = {(r.dataset, r.year): (r.symbols, r.files) for r in store.describe_store(spark, str(tmp_path)).collect()}
    assert got == {("chain", 2020): (2, 2), ("chain", 2021): (0, 1), ("plain", None): (None, 1)}
    assert store.describe_store(spark, str(tmp_path / "none")).collect() == []


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_work_by_symbol_on_buckets_needs_no_exchange(spark, tmp_path):
    rows = [(D + timedelta(i), s, float(i % 7), float(i), float((i * i) % 11)) for s in "ABCDE" for i in range(60)]
    bars = spark.createDataFrame(rows, "date date, symbol string, close double, x double, z double")
    events = spark.createDataFrame([(D + timedelta(i), s) for s in "ABC" for i in (20, 40)], "date date, symbol string")
    for df, name in ((bars, "bucket_bars"), (events, "bucket_events")):
        store.write_buckets(df, name, str(tmp_path / name), buckets=4)
    a, b = spark.table("bucket_bars"), spark.table("bucket_events")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mean = a.withColumn("m", rolling(F.avg, F.col("close"), Window.partitionBy("symbol").orderBy("date"), 22))
        fit = regress.rolling_fit(a, "close", ["x", "z"], "symbol", 25, 10)
        after = next_on_buckets(a, b)
        for df in (mean, fit, after):
            assert "Exchange" not in plan_of(df)
        got = {(r.symbol, r.date): r.next_event for r in after.collect()}
        assert got["A", D] == D + timedelta(20) and got["B", D + timedelta(21)] == D + timedelta(40) and got["C", D + timedelta(41)] is None and got["D", D] is None
        same = regress.rolling_fit(bars, "close", ["x", "z"], "symbol", 25, 10)
        key = lambda r: (r.symbol, r.date)
        assert [round(r.b_x, 9) for r in sorted(fit.collect(), key=key)] == [round(r.b_x, 9) for r in sorted(same.collect(), key=key)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
        spark.sql("drop table bucket_bars")
        spark.sql("drop table bucket_events")


def test_windowed_reads_prune_years_and_symbols(spark, tmp_path):
    df = spark.createDataFrame([(date(y, 1, d), s, y, 1.0) for y in (2020, 2021, 2022) for s in "AB" for d in (1, 2)], "date date, symbol string, year int, v double")
    store.write_table(df, str(tmp_path / "chain"), ["year", "symbol"])
    got = store.load_chain(spark, str(tmp_path), "chain", "2021-01-01", "2021-12-31", ["a"])
    assert got.count() == 2
    scan = next(line for line in plan_of(got).splitlines() if "PartitionFilters" in line)
    assert "year" in scan.split("PartitionFilters")[1].split("]")[0] and "symbol" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    with pytest.raises(store.MissingDataset):
        store.load_chain(spark, str(tmp_path), "chain", "2025-01-01", None, None)
