"""Studies that combine signals, panels and books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quotes import distance_bucket
from ..functions.windows import average_rank, bucket, by, rolling, zscore
from ..sources.store import checkpointed
from .asof import next_event
from .joins import mark_stale, pivot_sides
from .panels import stock_months
from .pnl import book, entry_price, rank_targets
from .reports import book_daily, book_factors, book_summary, forward_decile_table, portfolio_returns, spread_stats, summary_columns, unpivot, variants


def past_signals(source: DataFrame, windows: dict[str, tuple[int, int]], sign: float = -1.0, min_names: int = 50) -> DataFrame:
    """``label, date, symbol, signal``: the cross-sectional score of the P&L over each window of ``(sessions, skipped)``.

    All windows are columns of one pass over ``source (date, symbol, pnl_per_vega)``.
    """
    w = by("symbol")
    past = source.select("date", "symbol", *(rolling(F.sum, F.col("pnl_per_vega"), w, n, max(1, n // 2), skip).alias(k) for k, (n, skip) in windows.items()))
    rows = unpivot(past, ["date", "symbol"], list(windows), "label", "past").filter("past is not null")
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("label", "date"))).filter(F.col("_n") >= min_names)
    return rows.select("label", "date", "symbol", (sign * zscore("past", "label", "date")).alias("signal")).filter("signal is not null")


def window_deciles(reference: DataFrame, windows: dict[str, tuple[int, int]], horizon: int, sign: float = -1.0, min_names: int = 50, source: DataFrame | None = None) -> DataFrame:
    """The decile table of each window of ``window_sweep``, without its books."""
    return forward_decile_table(past_signals(reference if source is None else source, windows, sign, min_names), reference, horizon, keys=("label",))


def window_sweep(reference: DataFrame, windows: dict[str, tuple[int, int]], horizon: int, rebalances: DataFrame, factors: DataFrame, market: str, sign: float = -1.0, min_names: int = 50, gross: float = 1000.0, source: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The study of one signal family over several windows: a summary row a window, and the decile table of each.

    Summary: ``label, days, mean, t_naive, t_overlap`` of the forward spread, ``positions, gross_pnl, sharpe,
    max_drawdown, turnover, market_loading, market_t, intercept_t`` of the rank book, and ``net_pnl_full_cost,
    net_sharpe_full_cost, cost_total`` of the same book paying full costs. ``source`` (default: ``reference``) is what
    signals are built from; books trade the reference.
    """
    signals = past_signals(reference if source is None else source, windows, sign, min_names)
    deciles = window_deciles(reference, windows, horizon, sign, min_names, source)
    spreads = spread_stats(signals, reference, horizon, keys=("label",))
    targets = rank_targets(signals, gross, keys=("label",))
    labels = list(windows)
    # costs change no position: one run of the books, a row for each book and session, with and without them; read three times from here on
    paid = checkpointed(book_daily(book(reference, targets, rebalances, 1.0, labels), ("label",)))
    upto = Window.partitionBy("label").orderBy("date")
    daily = paid.withColumns({"cost": F.lit(0.0), "net_pnl": F.col("gross_pnl"), "cumulative_net": F.sum("gross_pnl").over(upto)})
    books = book_summary(daily, ("label",)).select("label", F.col("mean_positions").alias("positions"), F.col("total_gross_pnl").alias("gross_pnl"), "sharpe", "max_drawdown", F.col("annual_turnover_over_gross_vega").alias("turnover"))
    fits = book_factors(daily, factors, keys=["label"])
    at = lambda name, c: F.max(F.when(F.col("regressor") == name, F.col(c)))
    fits = fits.groupBy("label").agg(at(market, "coefficient").alias("market_loading"), at(market, "t_stat").alias("market_t"), at("const", "t_stat").alias("intercept_t"))
    costed = book_summary(paid, ("label",)).select("label", F.col("total_net_pnl").alias("net_pnl_full_cost"), F.col("sharpe").alias("net_sharpe_full_cost"), F.col("total_cost").alias("cost_total"))
    return spreads.join(books, "label", "left").join(fits, "label", "left").join(costed, "label", "left"), deciles


def by_days_to_event(rows: DataFrame, events: DataFrame, edges: list[tuple[str, int, int]], n: int = 10) -> DataFrame:
    """``bucket, name_days, mean_raw, mean_signal, share_top, share_bottom, fwd_pnl, fwd_t`` by days to the next event session.

    ``rows (date, symbol, raw, signal, fwd)``. The shares are those of the date's top and bottom of ``n`` quantiles of
    the signal, by average rank; the t of the forward P&L takes rows as independent.
    """
    count = F.count(F.lit(1)).over(Window.partitionBy("date"))
    ranked = rows.withColumn("_place", F.floor((average_rank("signal", "date") - 1) * n / count) + 1)
    near = next_event(ranked, events)
    share = lambda k: F.avg((F.col("_place") == k).cast("double"))
    t = F.try_divide(F.avg("fwd"), F.stddev_samp("fwd") / F.sqrt(F.count("fwd")))
    return near.groupBy(distance_bucket("days_to_event", edges).alias("bucket")).agg(
        F.count("*").alias("name_days"), F.avg("raw").alias("mean_raw"), F.avg("signal").alias("mean_signal"), share(n).alias("share_top"), share(1).alias("share_bottom"), F.avg("fwd").alias("fwd_pnl"), t.alias("fwd_t")
    )


def carry_returns(panel: DataFrame, fraction: float | Column = 0.0) -> DataFrame:
    """Adds the short straddle's ``naked`` and ``hedged`` returns over the premium, and ``variance_premium, vol_premium``.

    ``fraction`` of the half spread is given up at entry; the static hedge is that of entry. The premiums are of
    ``iv`` over ``realized_var``, where the panel has them.
    """
    premium = entry_price("call", fraction, -1) + entry_price("put", fraction, -1)
    paid = F.col("call_payoff") + F.col("put_payoff")
    move = (F.col("call_delta") + F.col("put_delta")) * (F.col("spot_at_expiry") - F.col("spot_entry"))
    out = panel.withColumns({"naked": F.try_divide(premium - paid, premium), "hedged": F.try_divide(premium - paid + move, premium)})
    if "realized_var" in panel.columns:
        out = out.withColumns({"variance_premium": F.col("iv") * F.col("iv") - F.col("realized_var"), "vol_premium": F.col("iv") - F.sqrt("realized_var")})
    return out


def short_carry(panel: DataFrame) -> DataFrame:
    """``month, naked, hedged, names``: mean return of short straddles, held naked or with a static hedge at entry, over the premium."""
    return carry_returns(panel).groupBy("month").agg(F.avg("naked").alias("naked"), F.avg("hedged").alias("hedged"), F.count("*").alias("names"))


def carry_cost_table(panel: DataFrame, fractions: tuple[float, ...] = (0.0, 0.25, 0.5, 1.0), carries: tuple[str, ...] = ("naked", "hedged")) -> DataFrame:
    """A summary row of the monthly means for each share of the half spread and carry."""
    rows = carry_returns(panel.withColumn("effective_spread", F.explode(F.array(*(F.lit(float(f)) for f in fractions)))), F.col("effective_spread"))
    monthly = rows.groupBy("effective_spread", "month").agg(*(F.avg(c).alias(c) for c in carries))
    return unpivot(monthly, ["effective_spread", "month"], list(carries), "carry", "value").groupBy("effective_spread", "carry").agg(*summary_columns(F.col("value")))


def series_summary(rows: DataFrame, period: str, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """One summary row for each column, of each sample that ``keys`` names."""
    return unpivot(rows, [*keys, period], columns, "series", "value").groupBy(*keys, "series").agg(*summary_columns(F.col("value")))


def event_returns(events: DataFrame, entries: DataFrame, exits: DataFrame) -> DataFrame:
    """``events`` with ``realized_move`` from entry to exit and ``move_ratio``, its size over the implied move.

    ``entries (symbol, entry_day, spot_entry, implied_move)``, ``exits (symbol, exit_day, spot_exit)``.
    """
    rows = events.join(entries, ["symbol", "entry_day"]).join(exits, ["symbol", "exit_day"])
    move = F.try_divide(F.col("spot_exit"), F.col("spot_entry")) - 1
    return rows.withColumns({"realized_move": move, "move_ratio": F.try_divide(F.abs(move), F.col("implied_move"))})


def tercile_spread(rows: DataFrame, score: str, value: str, period: str) -> DataFrame:
    """Summary of the top less the bottom tercile by period; average ranks, so ties share a place."""
    sorted_rows = rows.withColumn("decile", bucket(score, [period], 3, "average"))
    return portfolio_returns(sorted_rows, [value], (period,), top=3).filter("decile = 0").agg(*summary_columns(F.col(value)))


def straddle_event_returns(panel: DataFrame, fraction: float | Column = 0.0, side: str = "long", prefix: str = "") -> DataFrame:
    """Adds ``{prefix}straddle`` and ``{prefix}hedged``: returns from an event's entry to its exit, over the straddle paid.

    ``panel ({prefix}mid, {prefix}bid, {prefix}ask, {prefix}delta, {prefix}spot`` at entry, ``{prefix}exit_mid,
    {prefix}exit_spot)``. A share of the half spread is paid at entry and, at the entry's relative spread, at exit.
    """
    sign = 1 if side == "long" else -1
    c = lambda name: F.col(prefix + name)
    relative = F.try_divide(c("ask") - c("bid"), 2 * c("mid"))
    entry, leave = c("mid") * (1 + sign * fraction * relative), c("exit_mid") * (1 - sign * fraction * relative)
    hedge = c("delta") * (c("exit_spot") - c("spot"))
    return panel.withColumns({f"{prefix}straddle": sign * (F.try_divide(leave, entry) - 1), f"{prefix}hedged": sign * F.try_divide(leave - entry - hedge, entry)})


def with_history(rows: DataFrame, value: str = "move_ratio", events: int = 4, order: str = "event_session") -> DataFrame:
    """Adds ``history_ratio``: the mean of a name's last ``events`` values, known before the current one."""
    return rows.withColumn("history_ratio", rolling(F.avg, F.col(value), by("symbol", order=order), events, events, 1))


def event_summary(rows: DataFrame, series: list[str], keys: list[str], period: str = "month") -> DataFrame:
    """``keys, series, events, event_mean, share_positive`` over events, and ``months`` with the summary of monthly means."""
    long = unpivot(rows, [*keys, period], series, "series", "value")
    over_events = long.groupBy(*keys, "series").agg(F.count("*").alias("events"), F.avg("value").alias("event_mean"), F.avg((F.col("value") > 0).cast("double")).alias("share_positive"))
    monthly = long.groupBy(*keys, "series", period).agg(F.avg("value").alias("value"))
    return over_events.join(monthly.groupBy(*keys, "series").agg(*summary_columns(F.col("value"))), [*keys, "series"])


def tercile_labels(rows: DataFrame, sorts: dict[str, Column], period: str = "month") -> DataFrame:
    """``rows`` once for each sort with ``sort, score, tercile``: terciles within the period by average rank; null scores are left out."""
    return variants(rows, sorts).withColumnRenamed("variant", "sort").withColumn("tercile", bucket("score", ["sort", period], 3, "average"))


def event_sorts(rows: DataFrame, sorts: dict[str, Column], series: list[str], period: str = "month") -> tuple[DataFrame, DataFrame]:
    """(1) ``event_summary`` by sort and tercile with ``sort_mean``; (2) the summary of top less bottom by sort and series."""
    labelled = tercile_labels(rows, sorts, period)
    means = labelled.groupBy("sort", "tercile").agg(F.avg("score").alias("sort_mean"))
    table = event_summary(labelled, series, ["sort", "tercile"], period).join(means, ["sort", "tercile"])
    spread = portfolio_returns(labelled, series, ("sort", period), "tercile", 3).filter("tercile = 0")
    return table, series_summary(spread, period, series, ("sort",))


def event_sort_costs(panel: DataFrame, sorts: dict[str, Column], fractions: tuple[float, ...] = (0.0, 0.25, 0.5, 1.0), period: str = "month") -> DataFrame:
    """``event_summary`` of the short side of each sort's top tercile, at each share of the half spread."""
    top = tercile_labels(panel, sorts, period).filter("tercile = 3").withColumn("effective_spread", F.explode(F.array(*(F.lit(float(f)) for f in fractions))))
    return event_summary(straddle_event_returns(top, F.col("effective_spread"), "short"), ["straddle", "hedged"], ["sort", "effective_spread"], period)


def event_splits(rows: DataFrame, splits: list[Column], series: list[str], period: str = "month") -> DataFrame:
    """``event_summary`` by each of the overlapping labels in ``splits`` (a session, a year); null labels are none."""
    labelled = rows.withColumn("split", F.explode(F.array(*splits))).filter("split is not null")
    return event_summary(labelled, series, ["split"], period)


def chain_stock_months(chain: DataFrame, step: int = 28, traded: bool = True) -> DataFrame:
    """Stock-months on a chain whose contracts are quoted every ``step`` days: formed on one quote day, entered on the next.

    Trailing volatility stands on the mean IV of the day, spot at expiry on that of the expiry's day.
    """
    days = chain.select("date", F.date_sub("date", step).alias("previous")).distinct()
    wide = pivot_sides(chain, ["date", "symbol", "expiration", "strike", "underlying"], ["bid", "ask", "delta", "iv", "volume"])
    # both sides by one lookup: each one reads the contracts twice
    wide = mark_stale(wide, days, ["symbol", "expiration", "strike"], {f"{side}_stale": [f"{side}_bid", f"{side}_ask"] for side in ("call", "put")})
    level = chain.groupBy("date", "symbol").agg(F.avg("iv").alias("hv"))
    spots = level.select(F.col("date").alias("expiration"), "symbol", (100 * F.col("hv") / 0.15).alias("spot_at_expiry"))
    wide = wide.join(level, ["date", "symbol"], "left").join(spots, ["expiration", "symbol"], "left").withColumns({"call_iv_error": F.lit(0.0), "put_iv_error": F.lit(0.0)})
    plan = chain.select(F.col("date").alias("month"), F.col("date").alias("formation_day"), F.date_add("date", step).alias("entry_day"), "expiration").filter(F.col("expiration") > F.col("entry_day"))
    return stock_months(wide, plan.groupBy("month", "formation_day", "entry_day").agg(F.min("expiration").alias("expiration")), traded)
