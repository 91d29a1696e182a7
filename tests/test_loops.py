"""What depends on what came before, against session loops: the book's closed loop, chains of rolls, samples."""

import bisect
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenorlake.operators import pnl, reports
from tenorlake.operators.chains import follow
from tenorlake.operators.compose import sample_of_size

D = date(2024, 1, 1)


def ranks(values):
    ordered = sorted(values)
    return [(bisect.bisect_left(ordered, v) + bisect.bisect_right(ordered, v) + 1) / 2 for v in values]


def session_loop(sessions, present, scores, universe, rebalances, scheme, quantile, min_names, gross=1000.0):
    """Targets of each rebalance and the units that they leave, a session at a time."""
    units, out = {}, {}
    for d in sessions:
        units = {s: u for s, u in units.items() if (d, s) in present}  # a missing row closes
        if d not in rebalances:
            continue
        held = {s for s, u in units.items() if u != 0}
        names = sorted(s for (day, s) in present if day == d and ((d, s) in universe or s in held) and scores.get((d, s)) is not None)
        raw = {}
        if len(names) >= min_names:
            n, place = len(names), ranks([scores[d, s] for s in names])
            if scheme == "linear":
                raw = {s: -(p - (n + 1) / 2) for s, p in zip(names, place)}
            else:
                k = max(1, round(n * quantile))
                raw = {s: 1.0 if p <= k else -1.0 if p > n - k else 0.0 for s, p in zip(names, place)}
        total = sum(map(abs, raw.values()))
        targets = {s: v * gross / total for s, v in raw.items()} if total else {}
        out |= {(d, s): v for s, v in targets.items()}
        for s in set(targets) | held:
            if present[d, s] > 0:
                units[s] = targets.get(s, 0.0) / present[d, s]
    return out


@pytest.mark.parametrize("scheme,quantile,seed", [("linear", 0.1, 1), ("quantile", 0.2, 2), ("quantile", 0.4, 3), ("linear", 0.1, 4)])
def test_the_closed_loop_is_the_session_loop(spark, scheme, quantile, seed):
    rng = random.Random(seed)
    sessions = [D + timedelta(i) for i in range(60)]
    names = [f"s{i:02d}" for i in range(45)]
    present = {(d, s): rng.choice([1.0, 2.0, 5.0, 0.0]) if rng.random() < 0.1 else 3.0 for d in sessions for s in names if rng.random() < 0.985}
    scores = {k: None if rng.random() < 0.03 else float(rng.randrange(30)) for k in present}
    member = {s: rng.random() < 0.6 for s in names}
    universe = set()
    for i, d in enumerate(sessions):
        if i % 9 == 0:
            member = {s: rng.random() < 0.4 for s in names}
        universe |= {(d, s) for s in names if member[s]}
    rebalances = {d for i, d in enumerate(sessions) if i % 3 == 1}
    want = session_loop(sessions, present, scores, universe, rebalances, scheme, quantile, 8)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    got = pnl.closed_loop(
        frame([(*k, v) for k, v in scores.items()], "date date, symbol string, signal double"),
        frame([(*k, v) for k, v in present.items()] + [(sessions[5], "gone", None)], "date date, symbol string, dollar_vega double"),
        frame(list(universe), "date date, symbol string"), frame([(d,) for d in rebalances], "date date"),
        scheme=scheme, quantile=quantile, min_names=8,
    )
    rows = {(r.date, r.symbol): r.target_vega for r in got.collect()}
    assert rows.keys() == want.keys() and all(abs(rows[k] - v) < 1e-9 for k, v in want.items())
    # the open loop is another one: the rule has an effect
    outside = [k for k, v in want.items() if k not in universe and v]
    assert outside


def walk_of(rows):
    """Starts that are taken, from (start, end) in order."""
    out, free = [], None
    for start, end in sorted(rows):
        if free is None or start >= free:
            out.append(start)
            free = end
    return out


def test_walks_match_a_loop(spark):
    rng = random.Random(5)
    names = {f"n{k}": [(s, s + rng.choice([1, 2, 7, 30, 1 << 30 if rng.random() < 0.01 else 3])) for s in sorted(rng.sample(range(400), rng.randrange(1, 200)))] for k in range(12)}
    df = spark.createDataFrame([(k, s, e, f"{k}{s}") for k, rows in names.items() for s, e in rows], "symbol string, start int, end int, tag string").repartition(4)
    got = {}
    for r in follow(df, "symbol", "start", "end").collect():
        assert r.tag == f"{r.symbol}{r.start}"
        got.setdefault(r.symbol, []).append(r.start)
    assert {k: sorted(v) for k, v in got.items()} == {k: walk_of(rows) for k, rows in names.items()}
    assert follow(df.filter("false"), "symbol", "start", "end").collect() == []


def test_a_hundred_thousand_candidates_of_one_name(spark):
    df = spark.range(100_000).select(F.lit("x").alias("symbol"), F.col("id").cast("int").alias("start"), (F.col("id") + 20 + F.col("id") * 7919 % 13).cast("int").alias("end"))
    got = sorted(r.start for r in follow(df, "symbol", "start", "end").select("start").collect())
    assert got == walk_of([(i, i + 20 + i * 7919 % 13) for i in range(100_000)])


def test_a_sample_has_its_size_whatever_the_partitions(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    first = sorted(r.k for r in sample_of_size(df.repartition(3), 800, 7, ["k"]).collect())
    assert len(first) == 800 and first == sorted(r.k for r in sample_of_size(df.coalesce(1), 800, 7, ["k"]).collect())
    assert first != sorted(r.k for r in sample_of_size(df, 800, 8, ["k"]).collect()) and sample_of_size(df, 9000, 7, ["k"]).count() == 5000
    with pytest.raises(ValueError):
        sample_of_size(df, 10**9, 7, ["k"])


def test_stored_sketches_unite(spark):
    df = spark.range(60_000).select((F.col("id") % 4).alias("year"), (F.col("id") % 20_000).alias("x"))
    sketches = reports.distinct_sketches(df, ["year"], "x")
    by_year = {r.year: r.estimate for r in reports.sketched_distinct(sketches, ["year"]).collect()}
    assert all(abs(v / 5000 - 1) < 0.03 for v in by_year.values()) and len(by_year) == 4
    assert abs(reports.sketched_distinct(sketches, []).first().estimate / 20_000 - 1) < 0.03
    assert np.isclose(reports.sketched_distinct(sketches.filter("year < 2"), []).first().estimate, 10_000, rtol=0.03)
