"""Black-Scholes values as columns, and implied volatility by bisection over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def normal_cdf(x: Column) -> Column:
    """To about 7.5e-8, by the rational approximation 26.2.17 of Abramowitz and Stegun."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = normal_pdf(x) * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def with_greeks(df: DataFrame, spot: str, strike: str, years: str, iv: str, is_call: str, rate: str | None = None) -> DataFrame:
    """Adds ``price, delta, gamma, vega`` (a volatility point) and ``theta`` (a day); null unless spot, strike, years and iv are positive.

    Values that several results share are columns of their own, so each is computed once and code stays small.
    """
    good = (F.col(spot) > 0) & (F.col(strike) > 0) & (F.col(years) > 0) & (F.col(iv) > 0)
    s, k, t, v = (F.when(good, F.col(c)) for c in (spot, strike, years, iv))
    out = df.withColumns({"_s": s, "_k": k, "_v": v, "_root": F.sqrt(t), "_t": t, "_r": F.col(rate) if rate else F.lit(0.0)})
    out = out.withColumn("_a", (F.ln(F.col("_s") / F.col("_k")) + (F.col("_r") + F.col("_v") * F.col("_v") / 2) * F.col("_t")) / (F.col("_v") * F.col("_root")))
    out = out.withColumns({"_b": F.col("_a") - F.col("_v") * F.col("_root"), "_d": F.exp(-F.col("_r") * F.col("_t")), "_pa": normal_pdf(F.col("_a"))})
    out = out.withColumns({"_na": normal_cdf(F.col("_a")), "_nb": normal_cdf(F.col("_b"))})
    call = F.col("_s") * F.col("_na") - F.col("_k") * F.col("_d") * F.col("_nb")
    decay = -F.col("_s") * F.col("_pa") * F.col("_v") / (2 * F.col("_root"))
    carry = F.col("_r") * F.col("_k") * F.col("_d")
    out = out.withColumns({
        "price": F.when(F.col(is_call), call).otherwise(call - F.col("_s") + F.col("_k") * F.col("_d")),
        "delta": F.when(F.col(is_call), F.col("_na")).otherwise(F.col("_na") - 1),
        "gamma": F.col("_pa") / (F.col("_s") * F.col("_v") * F.col("_root")),
        "vega": F.col("_s") * F.col("_pa") * F.col("_root") / 100,
        "theta": F.when(F.col(is_call), decay - carry * F.col("_nb")).otherwise(decay + carry * (1 - F.col("_nb"))) / 365,
    })
    return out.drop("_s", "_k", "_v", "_root", "_t", "_r", "_a", "_b", "_d", "_pa", "_na", "_nb")


def vega_convention(rows: DataFrame, vega: str, move: str, majority: float = 2 / 3, least: float = 1e-6) -> DataFrame:
    """``n, per_point_share, per_point``: does ``vega`` explain the price ``move`` of one volatility point better as it is than as of a unit?

    Contracts with a vega of less than ``least`` tell nothing and don't count.
    """
    rows = rows.filter(F.col(vega) >= least)
    better = F.abs(F.col(vega) - F.col(move)) < F.abs(F.col(vega) / 100 - F.col(move))
    share = F.avg(better.cast("double"))
    return rows.agg(F.count("*").alias("n"), share.alias("per_point_share"), (share >= majority).alias("per_point"))


def _cdf(x: np.ndarray) -> np.ndarray:
    t = 1 / (1 + 0.2316419 * np.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return np.where(x >= 0, 1 - upper, upper)


@F.pandas_udf(DoubleType())
def implied_vol(price: pd.Series, spot: pd.Series, strike: pd.Series, years: pd.Series, is_call: pd.Series, rate: pd.Series) -> pd.Series:
    """Volatility in [1e-4, 5] at which the value is ``price``, by 60 halvings of all rows at once; null where there is none."""
    p, s, k, t, r = (x.to_numpy(float) for x in (price, spot, strike, years, rate))
    call = is_call.to_numpy(bool)

    def value(v: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            a = (np.log(s / k) + (r + v * v / 2) * t) / (v * np.sqrt(t))
            c = s * _cdf(a) - k * np.exp(-r * t) * _cdf(a - v * np.sqrt(t))
            return np.where(call, c, c - s + k * np.exp(-r * t))

    low, high = np.full(len(p), 1e-4), np.full(len(p), 5.0)
    with np.errstate(invalid="ignore"):
        good = (t > 0) & (s > 0) & (k > 0) & (value(low) <= p) & (value(high) >= p)
        for _ in range(60):
            middle = (low + high) / 2
            above = value(middle) > p
            low, high = np.where(above, low, middle), np.where(above, middle, high)
    return pd.Series(pd.array(np.where(good, (low + high) / 2, np.nan), "Float64"))
