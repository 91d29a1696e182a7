from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenorlake.operators import calendar, corporate, joins
from tenorlake.operators.asof import asof_join, count_events, event_distance, flag_events
from tenorlake.sources import store
from tenorlake.sources.schemas import CHAIN, conform

D = date(2024, 1, 1)


def day(n):
    return D + timedelta(n)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_asof_directions_and_exactness(spark):
    left = frame(spark, [("a", day(0), 1), ("a", day(5), 2), ("a", day(9), 3), ("b", day(5), 4)], "symbol string, date date, id int")
    right = frame(spark, [("a", day(5), 10.0), ("a", day(5), 11.0), ("a", day(7), 12.0)], "symbol string, date date, v double")
    get = lambda **k: {r.id: r.v for r in asof_join(left, right, ["symbol"], ["v"], **k).collect()}
    assert get() == {1: None, 2: 11.0, 3: 12.0, 4: None}
    assert get(exact=False) == {1: None, 2: None, 3: 12.0, 4: None}
    assert get(direction="forward") == {1: 11.0, 2: 11.0, 3: None, 4: None}
    assert get(direction="forward", exact=False) == {1: 11.0, 2: 12.0, 3: None, 4: None}
    with pytest.raises(ValueError):
        get(direction="sideways")


def test_events_spanned_counts_half_open_intervals(spark):
    pillars = frame(spark, [("a", day(0), day(x)) for x in (10, 21, 30, 112, 130)], "symbol string, date date, expiration date")
    events = frame(spark, [("a", day(0)), ("a", day(21)), ("a", day(112))], "symbol string, event_session date")
    got = {(r.expiration - D).days: r.n_events for r in count_events(pillars, events).collect()}
    assert got == {10: 0, 21: 1, 30: 1, 112: 2, 130: 2}


def test_flags_and_distances(spark):
    panel = frame(spark, [("a", day(1), day(4)), ("a", day(6), day(9)), ("b", day(1), day(4))], "symbol string, entry_day date, expiration date")
    events = frame(spark, [("a", day(4))], "symbol string, date date")
    assert [r.earnings_in_hold for r in flag_events(panel, events).orderBy("symbol", "entry_day").collect()] == [True, False, False]
    rows = event_distance(panel.select("symbol", F.col("entry_day").alias("date")), events).orderBy("symbol", "date").collect()
    assert [(r.days_to_event, r.days_since_event) for r in rows] == [(3, None), (None, 2), (None, None)]


def test_split_factors_multiply_later_splits(spark):
    dates = frame(spark, [("a", day(i)) for i in range(4)], "symbol string, date date")
    splits = frame(spark, [("a", day(1), 2.0), ("a", day(3), 5.0)], "symbol string, date date, value double")
    assert [round(r.factor, 9) for r in corporate.split_factors(dates, splits).orderBy("date").collect()] == [10.0, 5.0, 5.0, 1.0]


def test_sessions_schedule_and_event_sessions(spark):
    weekdays = [day(i) for i in range(0, 400) if day(i).weekday() < 5 and day(i) != date(2024, 3, 15)]
    sessions = calendar.session_index(frame(spark, [(d,) for d in weekdays + weekdays[:3]], "date date"))
    assert sessions.count() == len(weekdays)
    plan = {r.month: r for r in calendar.monthly_schedule(sessions).collect()}
    assert plan[date(2024, 2, 1)].expiration == date(2024, 3, 14)  # the third Friday is no session
    assert plan[date(2024, 2, 1)].formation_day == date(2024, 2, 19) and plan[date(2024, 2, 1)].entry_day == date(2024, 2, 20)
    events = frame(spark, [("a", date(2024, 1, 6), "bmo"), ("a", date(2024, 1, 8), "amc")], "symbol string, date date, session string")
    got = {r.session: r.event_session for r in calendar.event_sessions(events, sessions).collect()}
    assert got == {"bmo": date(2024, 1, 8), "amc": date(2024, 1, 9)}
    shifted = calendar.shift_sessions(frame(spark, [(weekdays[-1],)], "date date"), sessions, 3, clamp=True).first()
    assert shifted.shifted == weekdays[-1]


def test_membership_undoes_changes(spark):
    sessions = calendar.session_index(frame(spark, [(day(i),) for i in range(6)], "date date"))
    current = frame(spark, [("NEW",), ("OLD",)], "ticker string")
    changes = frame(spark, [(day(3), "NEW", "Added"), (day(3), "GONE", "Removed"), (day(40), "OLD", "Added")], "effective_date date, ticker string, action string")
    got = {}
    for r in calendar.members_as_of(current, changes, sessions).collect():
        got.setdefault(r.ticker, []).append((r.date - D).days)
    assert sorted(got["NEW"]) == [3, 4, 5] and sorted(got["GONE"]) == [0, 1, 2] and sorted(got["OLD"]) == list(range(6))


def test_stale_marks_and_patches(spark):
    wide = frame(spark, [(day(0), "c", 1.0), (day(1), "c", 1.0), (day(2), "c", 2.0), (day(1), "new", 1.0)], "date date, k string, bid double")
    days = frame(spark, [(day(i), day(i - 1)) for i in (1, 2)], "date date, previous date")
    got = {(r.k, r.date): r.stale for r in joins.mark_stale(wide, days, ["k"], ["bid"]).collect()}
    assert got == {("c", day(1)): True, ("c", day(2)): False, ("new", day(1)): False}
    out = joins.patch_rows(wide.withColumn("iv", F.lit(0.3)), frame(spark, [(day(2), "c", 9.0)], "date date, k string, bid double"), ["date", "k"], ["bid"], ["iv"])
    row = out.filter(F.col("date") == day(2)).first()
    assert row.bid == 9.0 and row.iv is None


def test_store_round_trips(spark, tmp_path):
    df = frame(spark, [(day(0), "a", 2023), (day(1), "b", 2024)], "date date, symbol string, year int")
    path = str(tmp_path / "t")
    store.write_table(df, path, ["year"], ["symbol"])
    store.write_table(df, path, ["year"])
    assert store.require(spark, path, "job").count() == 2
    store.replace_years(frame(spark, [(day(2), "z", 2024)], "date date, symbol string, year int"), path)
    assert sorted(r.symbol for r in store.require(spark, path, "job").collect()) == ["a", "z"]
    with pytest.raises(store.MissingDataset, match="builder"):
        store.require(spark, str(tmp_path / "no"), "builder")
    assert store.in_window(df, None, str(day(0))).count() == 1
    assert conform(df, CHAIN).schema == CHAIN
    store.write_report(df, str(tmp_path / "r"), ["date"])
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("exact", [True, False])
def test_buckets_change_no_lookup(spark, direction, exact):
    rng = np.random.default_rng(6)
    left = frame(spark, [(i, str(rng.choice(["a", "b", "c"])), day(int(rng.integers(0, 900)))) for i in range(400)] + [(900, "a", None), (901, None, day(3))], "id int, symbol string, date date")
    right = frame(spark, [(str(rng.choice(["a", "b", "d"])), day(int(rng.integers(-50, 1000))), i) for i in range(60)] + [(None, day(1), 99)], "symbol string, date date, v int")
    get = lambda **k: {r.id: r.v for r in asof_join(left, right, ["symbol"], ["v"], direction=direction, exact=exact, **k).collect() if r.id < 900}
    plain = get()
    assert any(v is not None for v in plain.values()) and len(plain) == 400
    for span in (1, 7, 32, 5000):
        assert get(span=span) == plain


def test_a_name_with_very_many_rows_is_spread(spark):
    """A thousand times the others' rows: the largest task has no more than three times the median's."""
    days = 2000
    hot = spark.range(200_000).select(F.lit("HOT").alias("symbol"), F.expr(f"date_add(date'2015-01-01', int(id % {days}))").alias("date"))
    rest = spark.range(20 * 200).select(F.concat(F.lit("s"), F.col("id") % 20).alias("symbol"), F.expr(f"date_add(date'2015-01-01', int(id * 7 % {days}))").alias("date"))
    events = spark.range(25).select(F.explode(F.array(F.lit("HOT"), F.lit("s3"))).alias("symbol"), F.expr("date_add(date'2015-02-01', int(id * 80))").alias("date"))
    panel = hot.unionByName(rest)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = event_distance(panel, events)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 1 and max(sizes) <= 3 * np.median(sizes)
    want = {e: 0 for e in range(25)}
    near = got.filter("symbol = 'HOT' and date = date'2015-04-25'").first()
    assert len(want) == 25 and near.days_to_event == 77 and near.days_since_event == 3
