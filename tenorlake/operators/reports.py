"""Decile portfolios, summaries, cost and state tables, and book reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import ahead, bucket, by
from ..sources.store import checkpointed
from .pnl import hold_to_expiry
from .regress import ols_table

DECILES = 10

#: Rows of a task where the number of tasks has to follow that of the rows.
TASK_ROWS = 500_000


def portfolio_returns(panel: DataFrame, columns: list[str], keys: tuple[str, ...] = ("month",), bucket_col: str = "decile", top: int = DECILES) -> DataFrame:
    """``keys, decile, names, columns``: equal-weighted means, and decile 0 for top less bottom where both are there."""
    means = panel.groupBy(*keys, bucket_col).agg(F.count("*").alias("names"), *(F.avg(c).alias(c) for c in columns))
    pick = lambda c, k: F.max(F.when(F.col(bucket_col) == k, F.col(c)))
    spread = means.groupBy(*keys).agg(
        (pick("names", top) + pick("names", 1)).alias("names"), *((pick(c, top) - pick(c, 1)).alias(c) for c in columns)
    ).filter("names is not null").withColumn(bucket_col, F.lit(0).cast(dict(means.dtypes)[bucket_col]))
    return means.unionByName(spread)


def certainty_equivalent(x: Column, gamma: float) -> Column:
    """Aggregate: the sure return worth as much under power utility; null if a loss is total."""
    value = F.pow(F.avg(F.when(1 + x > 0, F.pow(1 + x, F.lit(1 - gamma)))), F.lit(1 / (1 - gamma))) - 1
    return F.when(F.min(1 + x) > 0, value)


def summary_columns(x: Column) -> list[Column]:
    """Aggregates ``months, mean, std, t_stat, min, max, sharpe, ce_gamma3, ce_gamma7`` of values that are not null."""
    mean, std, n = F.avg(x), F.stddev_samp(x), F.count(x)
    ratio = F.when(std > 0, mean / std)
    return [n.alias("months"), mean.alias("mean"), std.alias("std"), (ratio * F.sqrt(n)).alias("t_stat"), F.min(x).alias("min"), F.max(x).alias("max"), ratio.alias("sharpe"), certainty_equivalent(x, 3).alias("ce_gamma3"), certainty_equivalent(x, 7).alias("ce_gamma7")]


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def returns_table(portfolios: DataFrame, columns: list[str], keys: tuple[str, ...] = ("month",)) -> DataFrame:
    """One summary row for each strategy and decile; decile 0 is labelled ``10-1``."""
    rows = unpivot(portfolios, [*keys, "decile"], columns, "strategy", "value")
    label = F.when(F.col("decile") == 0, "10-1").otherwise(F.col("decile").cast("string"))
    return rows.groupBy("strategy", label.alias("decile")).agg(*summary_columns(F.col("value")))


def two_stage_mean(panel: DataFrame, outer: str, inner: str, columns: list[str]) -> DataFrame:
    """Means within ``inner`` and ``outer``, then over ``inner``."""
    first = panel.groupBy(inner, outer).agg(F.count("*").alias("names"), *(F.avg(c).alias(c) for c in columns))
    return first.groupBy(outer).agg(F.avg("names").alias("names"), *(F.avg(c).alias(c) for c in columns))


def costed_legs(panel: DataFrame, fractions: tuple[float, ...] = (0.0, 0.25, 0.5, 1.0), keys: tuple[str, ...] = ("month",), top: int = DECILES) -> DataFrame:
    """``effective_spread, keys, long, short, long_short``: the top bucket bought and the bottom sold at each share of the half spread."""
    rows = panel.filter(F.col("decile").isin(1, top)).withColumn("effective_spread", F.explode(F.array(*(F.lit(f) for f in fractions))))
    bought = hold_to_expiry(rows, F.col("effective_spread"), "long").filter(F.col("decile") == top)
    sold = hold_to_expiry(rows, F.col("effective_spread"), "short").filter(F.col("decile") == 1)
    legs = bought.groupBy("effective_spread", *keys).agg(F.avg("straddle").alias("long")).join(sold.groupBy("effective_spread", *keys).agg(F.avg("straddle").alias("short")), ["effective_spread", *keys])
    return legs.withColumn("long_short", F.col("long") - F.col("short"))


def cost_table(panel: DataFrame, fractions: tuple[float, ...] = (0.0, 0.25, 0.5, 1.0), keys: tuple[str, ...] = (), top: int = DECILES) -> DataFrame:
    """A summary row for each share of the spread and leg."""
    rows = unpivot(costed_legs(panel, fractions, ("month", *keys), top), ["effective_spread", "month", *keys], ["long", "short", "long_short"], "leg", "value")
    return rows.groupBy(*keys, "effective_spread", "leg").agg(*summary_columns(F.col("value")))


def quoted_spread() -> Column:
    """Of both legs, over their mids."""
    return F.try_divide(F.col("call_ask") - F.col("call_bid") + F.col("put_ask") - F.col("put_bid"), F.col("call_mid") + F.col("put_mid"))


def liquidity_halves(panel: DataFrame) -> DataFrame:
    """Adds ``liquidity``: at most the month's median quoted spread, or above."""
    rows = panel.withColumn("_s", quoted_spread())
    median = F.percentile("_s", F.lit(0.5)).over(Window.partitionBy("month"))
    return rows.withColumn("liquidity", F.when(F.col("_s") <= median, "liquid").otherwise("illiquid")).drop("_s")


def variants(panel: DataFrame, scores: dict[str, Column], filters: dict[str, Column] | None = None) -> DataFrame:
    """``panel`` once for each named score: ``variant, score``. One pass, no union of scans.

    ``filters`` limit a variant's rows; rows with a null score are dropped.
    """
    filters = filters or {}
    pairs = [F.struct(F.lit(n).alias("variant"), F.when(filters.get(n, F.lit(True)), c).alias("score")) for n, c in scores.items()]
    return panel.withColumn("_v", F.explode(F.array(*pairs))).select(*panel.columns, "_v.variant", "_v.score").filter("score is not null")


def sort_variants(rows: DataFrame, value: str, period: str = "month", n: int = DECILES) -> DataFrame:
    """Summary of top less bottom for each variant, deciles being formed within variant and period."""
    ranked = rows.withColumn("decile", bucket("score", ["variant", period], n))
    spreads = portfolio_returns(ranked, [value], ("variant", period), top=n).filter("decile = 0")
    return spreads.groupBy("variant").agg(*summary_columns(F.col(value)))


def forward_decile_table(signal: DataFrame, reference: DataFrame, horizon: int = 60, n: int = DECILES, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, decile, gross_fwd_pnl_per_vega, net_fwd_pnl_per_vega, gross_t_stat, mean_names, dates``.

    Gross: the sum of the next ``horizon`` P&Ls per vega; net: less the costs of those sessions and half spreads
    to enter today and leave at the horizon. Means by date and decile, then over dates.
    """
    rows = signal.join(forward_pnl(reference, horizon), ["date", "symbol"]).withColumn("decile", bucket("signal", [*keys, "date"], n, "ceil"))
    daily = rows.groupBy(*keys, "date", "decile").agg(F.avg("gross_fwd").alias("gross"), F.avg("net_fwd").alias("net"), F.count("*").alias("names"))
    t = F.try_divide(F.avg("gross"), F.stddev_samp("gross")) * F.sqrt(F.count("*"))
    return daily.groupBy(*keys, "decile").agg(F.avg("gross").alias("gross_fwd_pnl_per_vega"), F.avg("net").alias("net_fwd_pnl_per_vega"), t.alias("gross_t_stat"), F.avg("names").alias("mean_names"), F.count("*").alias("dates"))


def forward_pnl(reference: DataFrame, horizon: int) -> DataFrame:
    """``date, symbol, gross_fwd, net_fwd`` where both are known."""
    w = by("symbol")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    gross, cost = ahead(F.sum, zero("pnl_per_vega"), w, horizon), ahead(F.sum, zero("cost_per_vega"), w, horizon)
    net = gross - cost - F.col("exit_cost_per_vega") - F.lead("exit_cost_per_vega", horizon).over(w)
    return reference.select("date", "symbol", gross.alias("gross_fwd"), net.alias("net_fwd")).dropna()


def spread_stats(signal: DataFrame, reference: DataFrame, horizon: int, n: int = DECILES, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, days, mean, t_naive, t_overlap``: top less bottom of the forward sum, by day; the second t for overlapping sums."""
    rows = signal.join(forward_pnl(reference, horizon), ["date", "symbol"]).withColumn("decile", bucket("signal", [*keys, "date"], n, "ceil"))
    side = lambda k: F.avg(F.when(F.col("decile") == k, F.col("gross_fwd")))
    daily = rows.groupBy(*keys, "date").agg((side(n) - side(1)).alias("spread")).filter("spread is not null")
    t = F.try_divide(F.avg("spread"), F.stddev_samp("spread")) * F.sqrt(F.count("*"))
    return daily.groupBy(*keys).agg(F.count("*").alias("days"), F.avg("spread").alias("mean"), t.alias("t_naive"), (t / math.sqrt(horizon)).alias("t_overlap"))


def state_table(rows: DataFrame, labels: Column, columns: list[str]) -> DataFrame:
    """Count and means of ``columns`` for each of the overlapping states in the array ``labels``; null labels are none."""
    return rows.withColumn("state", F.explode(labels)).filter("state is not null").groupBy("state").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in columns))


def value_ranks(rows: DataFrame, keys: list[str], value: str, parts: int, to: str = "rank") -> DataFrame:
    """``keys, value, to``: the average rank of each distinct value within ``keys``, for keys with too many rows for one sorted window.

    Values with their numbers of rows are dealt to ``parts`` ranges; running counts within a range, and what the ranges before it hold.
    """
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    # where a range begins is sampled, so it is settled before it is used twice
    ranged = checkpointed(counts.repartitionByRange(parts, *keys, value).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*keys, "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.repartition(parts, *keys, "_part").withColumn("_upto", upto).join(F.broadcast(before), [*keys, "_part"])
    return placed.select(*keys, value, (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2).alias(to))


def forecast_quality(rows: DataFrame, actual: str, predictors: list[str]) -> DataFrame:
    """``predictor, n, spearman, mean_log_error, rms_log_error``; average ranks over each predictor's own rows.

    Ranks are those of distinct values, looked up by value, in tasks of ``TASK_ROWS`` rows; no predictor is sorted as a whole.
    """
    rows = checkpointed(rows.select(actual, *predictors))
    parts = max(1, -(-rows.count() * len(predictors) // TASK_ROWS))
    long = unpivot(rows, [actual], predictors, "predictor", "value").filter(f"value > 0 and {actual} > 0")
    for value, to in ((actual, "_a"), ("value", "_b")):
        ranks = value_ranks(long.select("predictor", value), ["predictor"], value, parts, to)
        long = long.repartition(parts, "predictor", value).join(ranks, ["predictor", value])
    error = F.ln("value") - F.ln(actual)
    return long.groupBy("predictor").agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("spearman"), F.avg(error).alias("mean_log_error"), F.sqrt(F.avg(error * error)).alias("rms_log_error"))


def validation(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``n, correlation, mean_gap, sign_agreement`` of two columns."""
    return rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count("*").alias("n"), F.corr(a, b).alias("correlation"), F.avg(F.col(a) - F.col(b)).alias("mean_gap"), F.avg((F.signum(a) == F.signum(b)).cast("double")).alias("sign_agreement"))


def timing_rules(rows: DataFrame, rules: dict[str, Column], fractions: tuple[float, ...], ret: str = "ret", cost: str = "cost") -> DataFrame:
    """``rule, fraction`` and a summary: a position by rule times the return, less a share of cost when there is one."""
    position = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), c.cast("double").alias("position")) for n, c in rules.items())))
    held = rows.select("*", position.alias("_p")).withColumn("fraction", F.explode(F.array(*(F.lit(f) for f in fractions))))
    value = F.col("_p.position") * F.col(ret) - F.when(F.col("_p.position") != 0, F.col("fraction") * F.col(cost)).otherwise(0.0)
    return held.groupBy(F.col("_p.rule").alias("rule"), "fraction").agg(*summary_columns(value))


def tails(rows: DataFrame, value: str, worst: int = 8, best: int = 5, tie: str = "month") -> DataFrame:
    """The ``worst`` and ``best`` rows."""
    low = rows.orderBy(F.col(value).asc(), tie).limit(worst).withColumn("tail", F.lit("worst"))
    return low.unionByName(rows.orderBy(F.col(value).desc(), tie).limit(best).withColumn("tail", F.lit("best")))


def symbology_verdict(ours: DataFrame, theirs: DataFrame, actions: DataFrame, least: int = 20, corr: float = 0.95, gap: float = 0.01) -> DataFrame:
    """``year, symbol, overlap_days, return_correlation, median_gap, action_gap_days, status`` of two daily price series.

    ``ours``/``theirs (symbol, date, close)``. ``action_gap_days``: days with a large gap and a corporate action.
    """
    ret = lambda df, c: df.select("symbol", "date", (F.try_divide(F.col("close"), F.lag("close").over(by("symbol"))) - 1).alias(c), F.col("close").alias(f"{c}_close"))
    acted = actions.select("symbol", "date", F.lit(1).alias("_act")).distinct()
    rows = ret(ours, "a").join(ret(theirs, "b"), ["symbol", "date"]).join(acted, ["symbol", "date"], "left").withColumn("diff", F.abs(F.col("a") - F.col("b")))
    out = rows.groupBy(F.year("date").alias("year"), "symbol").agg(
        F.count("*").alias("overlap_days"), F.corr("a", "b").alias("return_correlation"), F.percentile("diff", F.lit(0.5)).alias("median_gap"), F.count_if((F.col("diff") > gap) & (F.col("_act") == 1)).alias("action_gap_days")
    )
    status = F.when(F.col("overlap_days") < least, "short").when(F.col("action_gap_days") > 0, "action_gap").when(F.coalesce(F.col("return_correlation"), F.lit(0.0)) < corr, "mismatch").when(F.col("median_gap") > gap, "drift").otherwise("ok")
    return out.withColumn("status", status)


def unquoted_sessions(chain: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``date, quoted_share`` of days on which few near contracts (7 to 60 days, within 10 %) have an ask."""
    near = chain.filter(F.datediff("expiration", "date").between(7, 60) & (F.abs(F.col("strike") / F.col("underlying") - 1) <= 0.10))
    return near.groupBy("date").agg(F.avg((F.col("ask") > 0).cast("double")).alias("quoted_share")).filter(F.col("quoted_share") < threshold)


def book_daily(records: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Daily totals of book records, with net P&L, turnover and the running sum; ``keys`` name books."""
    traded = F.abs(F.col("dollar_vega") - F.coalesce(F.lag("dollar_vega").over(by(*keys, "symbol")), F.lit(0.0)))
    rows = records.withColumn("_traded", traded)
    day = rows.groupBy(*keys, "date").agg(
        F.sum("option_pnl").alias("gross_pnl"), F.sum("option_cost").alias("cost"), F.sum(F.abs("dollar_vega")).alias("gross_vega"), F.sum("dollar_vega").alias("net_vega"), F.sum("_traded").alias("turnover"), F.count_if(F.col("units") != 0).alias("positions")
    ).withColumn("net_pnl", F.col("gross_pnl") - F.col("cost"))
    # one row a session
    return day.withColumn("cumulative_net", F.sum("net_pnl").over(Window.partitionBy(*keys).orderBy("date")))


def book_summary(daily: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row a book: Sharpe, P&L per gross vega, drawdown, turnover and cost drag."""
    run = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = daily.withColumn("_down", F.col("cumulative_net") - F.max("cumulative_net").over(run))
    vega = F.avg(F.when(F.col("gross_vega") > 0, F.col("gross_vega")))
    net = F.avg("net_pnl")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("sessions"), F.avg("positions").alias("mean_positions"), vega.alias("mean_gross_vega"), F.avg("net_vega").alias("mean_net_vega"), F.sum("gross_pnl").alias("total_gross_pnl"), F.sum("cost").alias("total_cost"), F.sum("net_pnl").alias("total_net_pnl"),
        (F.when(F.stddev_samp("net_pnl") > 0, net / F.stddev_samp("net_pnl")) * math.sqrt(252)).alias("sharpe"), F.try_divide(net * 252, vega).alias("annual_net_pnl_per_gross_vega"), F.min("_down").alias("max_drawdown"),
        F.try_divide(F.avg("turnover") * 252, vega).alias("annual_turnover_over_gross_vega"), F.try_divide(F.sum("cost"), F.abs(F.sum("gross_pnl"))).alias("cost_drag"),
    )


def book_factors(daily: DataFrame, factors: DataFrame, market: DataFrame | None = None, scale: bool = True, keys: list[str] | None = None) -> DataFrame:
    """OLS of a book's daily net P&L on factor returns and an index return: ``regressor, coefficient, t_stat, r_squared, observations``.

    ``daily (date, net_pnl, gross_vega)`` (and ``keys``), ``factors (date, factor, ret)``, ``market (date, market_return)``.
    With ``scale`` the P&L is that of a dollar of gross vega, so that coefficients compare with a name's loadings.
    Days without gross vega or with a missing regressor are left out.
    """
    names = sorted(r.factor for r in factors.select("factor").distinct().collect())  # a dozen
    rows = daily.join(factors.groupBy("date").pivot("factor", names).agg(F.first("ret")), "date")
    xs = list(names)
    if market is not None:
        rows = rows.join(market.select("date", F.col("market_return").alias("index_return")), "date", "left")
        xs.append("index_return")
    rows = rows.filter("gross_vega > 0").withColumn("_y", F.col("net_pnl") / F.col("gross_vega") if scale else F.col("net_pnl"))
    return ols_table(rows, "_y", xs, keys)


def effective_names(rows: DataFrame, value: str = "dollar_vega") -> DataFrame:
    """``date, effective_names`` = 1 / sum of squared shares of absolute ``value``."""
    total = F.sum(F.abs(value)).over(Window.partitionBy("date"))
    share = F.try_divide(F.abs(F.col(value)), total)
    return rows.withColumn("_s", share).groupBy("date").agg(F.try_divide(F.lit(1.0), F.sum(F.col("_s") * F.col("_s"))).alias("effective_names"))


def distinct_sketches(rows: DataFrame, keys: list[str], value: str, bits: int = 14) -> DataFrame:
    """``keys, sketch``: a HyperLogLog sketch of 2^bits registers of the values of each key, to be stored and united later (see ``sketched_distinct``)."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(value, F.lit(bits)).alias("sketch"))


def sketched_distinct(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, estimate``: distinct values of all stored sketches of each key, or of all without keys. The values themselves are not read again."""
    return (sketches.groupBy(*keys) if keys else sketches).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
