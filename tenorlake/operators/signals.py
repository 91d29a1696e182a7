"""Cross-sectional and time-series signals, and the alphas made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import by, clip, rolling, zscore
from .regress import residuals_by


def variance_premium(surface: DataFrame, forecast: DataFrame, tenor: int = 60) -> DataFrame:
    """``date, symbol, vrp``: ln of implied over forecast volatility, where both are positive."""
    iv = f"iv{tenor}"
    rows = surface.select("date", "symbol", iv).join(forecast.select("date", "symbol", "rv_fcst"), ["date", "symbol"])
    return rows.filter((F.col(iv) > 0) & (F.col("rv_fcst") > 0)).select("date", "symbol", (F.ln(iv) - F.ln("rv_fcst")).alias("vrp"))


def time_series_zscore(surface: DataFrame, iv: str = "iv60", window: int = 250, least: int = 120, winsor: float = 3.0, use_log: bool = True) -> DataFrame:
    """``date, symbol, signal``: how far today's IV is from its own trailing mean, in trailing deviations."""
    w = by("symbol")
    level = F.ln(iv) if use_log else F.col(iv)
    rows = surface.filter(F.col(iv) > 0).select("date", "symbol", level.alias("level"))
    rows = rows.withColumns({"mean": rolling(F.avg, F.col("level"), w, window, least), "sd": rolling(F.stddev_samp, F.col("level"), w, window, least)})
    return rows.filter("sd > 0").select("date", "symbol", clip((F.col("level") - F.col("mean")) / F.col("sd"), -winsor, winsor).alias("signal"))


def past_return_signal(reference: DataFrame, window: int = 252, skip: int = 21, sign: float = -1.0, least: int | None = None, winsor: float = 3.0, min_names: int = 50) -> DataFrame:
    """``date, symbol, past_return, signal``: trailing P&L per vega, ``skip`` sessions back, z-scored across names."""
    least = max(1, window // 2) if least is None else least
    rows = reference.select("date", "symbol", rolling(F.sum, F.col("pnl_per_vega"), by("symbol"), window, least, skip).alias("past_return")).filter("past_return is not null")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("date"))).filter(F.col("n") >= min_names)
    return rows.select("date", "symbol", "past_return", clip(sign * zscore("past_return", "date"), -winsor, winsor).alias("signal"))


def vrp_frame(vrp: DataFrame, features: DataFrame, sectors: DataFrame, market: DataFrame | None = None, controls: tuple[str, ...] = ()) -> DataFrame:
    """``vrp`` with ``market`` (beta times the index premium or the universe mean), ``sector_median`` and the controls."""
    rows = vrp.join(features.select("date", "symbol", "beta", *controls), ["date", "symbol"], "left").join(sectors.select("symbol", "sector"), "symbol", "left")
    if market is not None:
        rows = rows.join(market.select("date", F.col("vrp").alias("market_vrp")), "date", "left")
    else:
        rows = rows.withColumn("market_vrp", F.avg("vrp").over(Window.partitionBy("date")))
    median = F.percentile("vrp", F.lit(0.5)).over(Window.partitionBy("date", "sector"))
    return rows.withColumns({"market": F.col("beta") * F.col("market_vrp"), "sector_median": median})


def cross_sectional_signal(frame: DataFrame, regressors: list[str], min_names: int = 50, smoothing: int = 5, winsor: float = 3.0) -> DataFrame:
    """``date, symbol, residual, signal``: daily residuals of ``vrp``, smoothed by name, z-scored by date."""
    rows = residuals_by(frame, "vrp", regressors, ["date"], min_names)
    rows = rows.withColumn("smooth", rolling(F.avg, F.col("residual"), by("symbol"), smoothing, 1))
    return rows.select("date", "symbol", "residual", clip(zscore("smooth", "date"), -winsor, winsor).alias("signal"))


def scaled_alpha(signal: DataFrame, idio: DataFrame, ic: float = 0.05, sign: float = -1.0) -> DataFrame:
    """``date, symbol, alpha`` = sign * IC * idiosyncratic volatility * z, for all dates at once."""
    rows = signal.join(idio.select("date", "symbol", "idio_vol"), ["date", "symbol"])
    return rows.select("date", "symbol", (sign * ic * F.col("idio_vol") * F.col("signal")).alias("alpha"))


def correlations_by(rows: DataFrame, value: str, others: list[str], keys: list[str]) -> DataFrame:
    """Correlation of ``value`` with each of ``others`` within ``keys``."""
    return rows.groupBy(*keys).agg(*(F.corr(value, c).alias(f"corr_{c}") for c in others))


def premium_with_fallback(index: DataFrame | None, universe: DataFrame) -> DataFrame:
    """``date, vrp``: the index premium, or the universe mean where the index has none."""
    mean = universe.groupBy("date").agg(F.avg("vrp").alias("_mean"))
    if index is None:
        return mean.withColumnRenamed("_mean", "vrp")
    return mean.join(index.select("date", "vrp"), "date", "full").select("date", F.coalesce("vrp", "_mean").alias("vrp"))


