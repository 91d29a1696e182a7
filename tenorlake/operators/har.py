"""Pooled log-HAR volatility forecasts with an expanding window and monthly refits, no look-ahead."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_join
from .calendar import period_starts, session_index
from .regress import solve


def _moments(y: Column, xs: list[Column]) -> list[tuple[str, Column]]:
    """Names and columns of n, sums and products; the regressors include the constant."""
    full = [F.lit(1.0), *xs]
    out = [(f"s{i}_{j}", full[i] * full[j]) for i in range(len(full)) for j in range(i, len(full))]
    return [*out, *((f"t{i}", full[i] * y) for i in range(len(full))), ("yy", y * y)]


def har_coefficients(panel: DataFrame, windows: tuple[int, ...] = (1, 5, 22), forward: int = 60, min_rows: int = 1000) -> DataFrame:
    """``date, rows, c0, c1..., residual_var`` for each refit date, the first session of a month.

    ``panel (date, symbol, rv_n..., rv_fwd)``. A refit sees rows up to ``forward`` sessions earlier, whose
    forward volatility is closed. Sums of products by session, added up over sessions; one small system a
    refit. The shift by the first row's means would not change the result and is not needed for logs.
    """
    names = [f"rv_{w}" for w in windows]
    clean = har_rows(panel, names)
    sessions = session_index(clean)
    xs = [F.col(f"x_{n}") for n in names]
    y = F.when(F.col("rv_fwd") > 0, F.ln(F.col("rv_fwd") ** 2))
    moments = _moments(y, xs)
    daily = clean.filter(y.isNotNull()).groupBy("date").agg(F.count("*").alias("n"), *(F.sum(c).alias(k) for k, c in moments))
    # one row for each session: a few thousand
    whole = Window.orderBy("session_index").rowsBetween(Window.unboundedPreceding, 0)
    keys = ["n", *(k for k, _ in moments)]
    running = sessions.join(daily, "date", "left").select("session_index", *(F.sum(F.coalesce(F.col(k), F.lit(0.0))).over(whole).alias(k) for k in keys))
    refits = period_starts(sessions).select("date", (F.col("session_index") - forward).alias("session_index"))
    rows = refits.join(running, "session_index").filter(F.col("n") >= min_rows)
    k = len(names) + 1
    # centred on the means, so that the system is small and well scaled
    mean = [F.col(f"s0_{i}") / F.col("n") for i in range(k)]
    my = F.col("t0") / F.col("n")
    matrix = [[F.col(f"s{min(i, j)}_{max(i, j)}") / F.col("n") - mean[i] * mean[j] for j in range(1, k)] for i in range(1, k)]
    right = [F.col(f"t{i}") / F.col("n") - mean[i] * my for i in range(1, k)]
    rows = rows.withColumns({**{f"_r{i}": right[i - 1] for i in range(1, k)}, **{f"_m{i}": mean[i] for i in range(1, k)}, "_my": my, "_vy": F.col("yy") / F.col("n") - my * my, **{f"_a{i}_{j}": matrix[i - 1][j - 1] for i in range(1, k) for j in range(i, k)}})
    slopes = solve([[F.col(f"_a{min(i, j)}_{max(i, j)}") for j in range(1, k)] for i in range(1, k)], [F.col(f"_r{i}") for i in range(1, k)])
    rows = rows.withColumns({f"c{i}": slopes[i - 1] for i in range(1, k)})
    const = reduce(lambda a, i: a - F.col(f"c{i}") * F.col(f"_m{i}"), range(1, k), F.col("_my"))
    left = reduce(lambda a, i: a - F.col(f"c{i}") * F.col(f"_r{i}"), range(1, k), F.col("_vy"))
    return rows.select("date", F.col("n").cast("long").alias("rows"), const.alias("c0"), *(f"c{i}" for i in range(1, k)), F.greatest(left, F.lit(0.0)).alias("residual_var"))


def har_rows(panel: DataFrame, names: list[str]) -> DataFrame:
    """Rows whose regressors are positive and finite, with their logarithms."""
    good = reduce(Column.__and__, [(F.col(n) > 0) & (F.col(n) < float("inf")) for n in names])
    return panel.filter(good).withColumns({f"x_{n}": F.ln(n) for n in names})


def har_forecast(panel: DataFrame, apply: DataFrame | None = None, windows: tuple[int, ...] = (1, 5, 22), forward: int = 60, min_rows: int = 1000) -> DataFrame:
    """``date, symbol, rv_fcst`` by the last refit on or before each date, with the lognormal correction.

    ``apply``: rows that are scored but never fitted.
    """
    names = [f"rv_{w}" for w in windows]
    fitted = har_coefficients(panel, windows, forward, min_rows).withColumn("_one", F.lit(1))
    rows = har_rows(panel.select("date", "symbol", *names), names)
    if apply is not None:
        rows = rows.unionByName(har_rows(apply.select("date", "symbol", *names), names))
    values = ["c0", *(f"c{i}" for i in range(1, len(names) + 1)), "residual_var"]
    days = asof_join(rows.select("date").distinct().withColumn("_one", F.lit(1)), fitted, ["_one"], values)
    scored = rows.join(days.filter("c0 is not null"), "date")
    line = reduce(lambda a, i: a + F.col(f"c{i}") * F.col(f"x_{names[i - 1]}"), range(1, len(names) + 1), F.col("c0"))
    return scored.select("date", "symbol", F.sqrt(F.exp(line + F.col("residual_var") / 2)).alias("rv_fcst"))
