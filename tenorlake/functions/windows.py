"""Column factories over windows: rolling statistics with a least number of samples, ranks, buckets, sums ahead."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by(*keys: str, order: str | Column | list = "date") -> WindowSpec:
    """Rows of equal ``keys`` in order."""
    return Window.partitionBy(*keys).orderBy(*(order if isinstance(order, list) else [order]))


def rolling(agg: Callable[[Column], Column], value: Column, window: WindowSpec, n: int, least: int | None = None, skip: int = 0, rows_only: bool = False) -> Column:
    """``agg`` of ``value`` over the ``n`` rows that end ``skip`` rows back; null with fewer than ``least`` (default ``n``) values.

    With ``rows_only`` rows count, not values that are not null.
    """
    frame = window.rowsBetween(1 - n - skip, -skip)
    have = F.count(F.lit(1) if rows_only else value).over(frame)
    return F.when(have >= (n if least is None else least), agg(value).over(frame))


def ahead(agg: Callable[[Column], Column], value: Column, window: WindowSpec, n: int) -> Column:
    """``agg`` over the next ``n`` rows; null until there are ``n``."""
    frame = window.rowsBetween(1, n)
    return F.when(F.count(F.lit(1)).over(frame) == n, agg(value).over(frame))


def fill_forward(value: Column, window: WindowSpec) -> Column:
    return F.last(value, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))


def average_rank(value: str, *keys: str) -> Column:
    """Rank within ``keys``, tied values sharing the mean of their ranks; null for a null value."""
    ordered = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.when(F.col(value).isNotNull(), F.rank().over(ordered) + (ties - 1) / 2)


def bucket(value: str, keys: list[str], n: int = 10, method: str = "floor", ties: tuple[str, ...] = ("symbol",)) -> Column:
    """Quantile 1..n within ``keys``.

    ``floor``: (rank - 1) * n // count + 1; ``ceil``: ceil(rank * n / count), within 1..n; ``average``: the latter
    with average ranks. Ordinal ranks break ties by ``ties``. Null values count but get no bucket.
    """
    count = F.count(F.col(value)).over(Window.partitionBy(*keys))
    if method == "average":
        rank = average_rank(value, *keys)
    else:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last(), *ties))
    if method == "floor":
        place = F.floor((rank - 1) * n / count) + 1
    elif method in ("ceil", "average"):
        place = F.least(F.greatest(F.ceil(rank * n / count), F.lit(1)), F.lit(n))
    else:
        raise ValueError(f"unknown method {method!r}")
    return F.when(F.col(value).isNotNull(), place).cast("int")


#: Rank error of the sketch that brackets a quantile, as a share of the values, and how many times that the bracket is wide on each side.
SKETCH, ROOM = 10_000, 3


def quantiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float], interpolation: str = "linear") -> DataFrame:
    """``keys`` and a column for each of ``wanted``: exact quantiles of the values of each key that are not null; keys without any are missing.

    ``linear``: between the values at the places around q * (n - 1); ``nearest``: the one at that place rounded, halves away from zero.
    Two passes, neither of which orders the table or gathers a key. The first sketches each key in mergeable summaries of known rank error,
    which bracket each quantile. The second counts, in the tasks first, the values on either side of the brackets, takes the
    nearest ones outside them, and makes a histogram of the distinct values inside; only that histogram is ordered, by key and quantile, so a
    value that many rows share is one of its rows.
    """
    if interpolation not in ("linear", "nearest"):
        raise ValueError(f"unknown interpolation {interpolation!r}")
    names, qs = list(wanted), list(wanted.values())
    x = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    grouped = lambda df, *more: df.groupBy(*keys, *more)
    room = ROOM / SKETCH
    ends = F.array(*(F.lit(min(1.0, max(0.0, q + side))) for q in qs for side in (-room, room)))
    sketch = grouped(x).agg(F.count("_x").alias("_n"), F.percentile_approx("_x", ends, F.lit(SKETCH)).alias("_ends"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
    edge = lambda i, q, side: F.when(F.lit(q + side <= 0), F.col("_least")).when(F.lit(q + side >= 1), F.col("_most")).otherwise(F.col("_ends")[2 * i + (side > 0)])
    brackets = sketch.select(*keys, "_n", *(edge(i, q, -room).alias(f"_low{i}") for i, q in enumerate(qs)), *(edge(i, q, room).alias(f"_high{i}") for i, q in enumerate(qs)))
    both = x.join(brackets, keys) if keys else x.crossJoin(F.broadcast(brackets))
    c = F.col("_x")
    at = range(len(qs))
    sides = grouped(both).agg(F.first("_n").alias("_n"), *(f for i in at for f in (F.count_if(c < F.col(f"_low{i}")).alias(f"_below{i}"), F.max(F.when(c < F.col(f"_low{i}"), c)).alias(f"_before{i}"), F.min(F.when(c > F.col(f"_high{i}"), c)).alias(f"_after{i}"))))
    near = F.filter(F.array(*(F.when((c >= F.col(f"_low{i}")) & (c <= F.col(f"_high{i}")), F.lit(i)) for i in at)), lambda i: i.isNotNull())
    inside = grouped(both.select(*keys, "_x", F.explode(near).alias("_i")), "_i", "_x").agg(F.count("*").alias("_rows"))
    # a row for each quantile: what is below, and the places wanted
    place = [q * (F.col("_n") - 1) for q in qs]
    if interpolation == "nearest":
        place = [F.round(p) for p in place]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("_i"), F.col(f"_below{i}").alias("_below"), F.col(f"_before{i}").alias("_before"), F.col(f"_after{i}").alias("_after"), place[i].cast("double").alias("_place")) for i in at)))
    asked = sides.select(*keys, each.alias("_q")).select(*keys, "_q.*")
    group = Window.partitionBy(*keys, "_i").orderBy("_x")
    placed = inside.withColumn("_to", F.sum("_rows").over(group)).withColumn("_from", F.col("_to") - F.col("_rows"))
    # first and last place that a value takes; the neighbours take one each
    held = placed.join(asked, [*keys, "_i"]).select(*keys, "_i", "_x", (F.col("_below") + F.col("_from")).alias("_first"), (F.col("_below") + F.col("_to") - 1).alias("_last"), "_place")
    total = grouped(inside, "_i").agg(F.sum("_rows").alias("_inside"))
    outer = asked.join(total, [*keys, "_i"], "left").withColumn("_inside", F.coalesce("_inside", F.lit(0)))
    around = F.explode(F.array(F.struct(F.col("_before").alias("_x"), (F.col("_below") - 1).alias("_first")), F.struct(F.col("_after").alias("_x"), (F.col("_below") + F.col("_inside")).alias("_first"))))
    outer = outer.select(*keys, "_i", "_place", around.alias("_o")).select(*keys, "_i", "_o._x", "_o._first", F.col("_o._first").alias("_last"), "_place").filter("_x is not null")
    low, high = F.floor("_place"), F.ceil("_place")
    pick = lambda p: F.max(F.when((F.col("_first") <= p) & (F.col("_last") >= p), F.col("_x")))
    found = grouped(held.unionByName(outer), "_i").agg(pick(low).alias("_a"), pick(high).alias("_b"), F.first("_place").alias("_place"))
    result = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_place") - F.floor("_place"))
    return grouped(found.withColumn("_v", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(result))).agg(*(F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(name) for i, name in enumerate(names)))


def zscore(value: str, *keys: str) -> Column:
    """Distance from the mean of ``keys`` in sample standard deviations; null if there is no spread."""
    group = Window.partitionBy(*keys)
    spread = F.stddev_samp(value).over(group)
    return F.when(spread > 0, (F.col(value) - F.avg(value).over(group)) / spread)


def half_away(value: Column, digits: int) -> Column:
    """``value`` rounded as IEEE engines do it: times the power of ten, to the nearest whole number, halves away from zero, and back.

    Spark's ``round`` rounds the shortest decimal form instead: 0.50468749999999995 prints as 0.5046875 and goes up, but its
    product with 1e6 is below 504687.5 and goes down. A value whose product overflows stays as it is.
    """
    scaled = value * 10.0**digits
    whole = F.rint(scaled)
    whole = F.when(F.abs(scaled - whole) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(whole)
    return F.when(F.abs(scaled) < math.inf, whole / 10.0**digits).otherwise(value)


def clip(value: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))
