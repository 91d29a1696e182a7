"""Column factories for quotes, tickers and sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mid(bid: str | Column = "bid", ask: str | Column = "ask") -> Column:
    return (col(bid) + col(ask)) / 2


def days_to(expiration: str | Column = "expiration", date: str | Column = "date") -> Column:
    return F.datediff(col(expiration), col(date))


def moneyness(strike: str | Column = "strike", spot: str | Column = "underlying") -> Column:
    return F.try_divide(col(strike), col(spot))


def in_band(max_dte: int, max_moneyness: float, strike: str = "strike", spot: str = "underlying") -> Column:
    """Contracts that expire within ``max_dte`` days with a strike within ``max_moneyness`` of spot."""
    return days_to().between(0, max_dte) & (F.abs(moneyness(strike, spot) - 1) <= max_moneyness)


def is_quoted(side: str = "") -> Column:
    """A positive bid below the ask. ``side``: prefix of the columns, such as ``call_``."""
    return (F.col(f"{side}bid") > 0) & (F.col(f"{side}ask") > F.col(f"{side}bid"))


def is_clean(side: str = "") -> Column:
    """Quoted, traded and not stale."""
    return is_quoted(side) & (F.col(f"{side}volume") > 0) & ~F.coalesce(F.col(f"{side}stale"), F.lit(False))


def has_valid_iv(iv: str = "iv", error: str = "iv_error", tolerance: float = 1.0) -> Column:
    return (F.col(iv) > 0) & (F.abs(F.col(error)) <= tolerance)


def is_monthly(expiration: str | Column = "expiration") -> Column:
    """Day 15 to 21, Thursday or Friday."""
    return F.dayofmonth(col(expiration)).between(15, 21) & F.weekday(col(expiration)).isin(3, 4)


def is_markable(bid: str = "bid", ask: str = "ask") -> Column:
    """0 <= bid <= ask, ask > 0, both finite."""
    b, a = F.col(bid), F.col(ask)
    return F.coalesce((b >= 0) & (b <= a) & (a > 0) & ~F.isnan(b) & ~F.isnan(a) & (a < float("inf")), F.lit(False))


def is_entry_valid(bid: str = "bid", ask: str = "ask", volume: str = "volume", max_spread: float = 0.10) -> Column:
    """Markable with a positive bid and volume, and a spread of at most ``max_spread`` of the mid."""
    spread = F.try_divide(F.col(ask) - F.col(bid), mid(bid, ask))
    return F.coalesce(is_markable(bid, ask) & (F.col(bid) > 0) & (F.col(volume) > 0) & (spread <= max_spread), F.lit(False))


def session_label(stamp: Column) -> Column:
    """``amc`` from 16:00 on, ``bmo`` before 9:30, else ``unknown``."""
    hour = F.hour(stamp) + F.minute(stamp) / 60
    return F.when(hour >= 16, "amc").when(hour < 9.5, "bmo").otherwise("unknown")


def normal_ticker(ticker: str | Column, overrides: dict[str, str] | None = None, separator: str = "") -> Column:
    """The destination's spelling: an override if there is one, else dots replaced by ``separator``."""
    own = F.upper(F.trim(col(ticker)))
    out = F.regexp_replace(own, r"\.", separator)
    for name, to in (overrides or {}).items():
        out = F.when(own == name, F.lit(to)).otherwise(out)
    return out


def right_letter(right: str | Column = "right") -> Column:
    """``CALL``/``PUT`` as ``C``/``P``."""
    return F.substring(F.upper(col(right)), 1, 1)


def distance_bucket(days: str | Column, edges: list[tuple[str, int, int]], rest: str = "none") -> Column:
    """Label of the first range (label, low, high), ends included, that holds ``days``."""
    out = F.lit(rest)
    for label, low, high in reversed(edges):
        out = F.when(col(days).between(low, high), F.lit(label)).otherwise(out)
    return out
