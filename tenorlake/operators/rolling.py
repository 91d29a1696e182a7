"""Order statistics of trailing rows: a sorted window that a name's rows pass through once."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SortedWindow:
    """The last values of a series in order. Null values take a place in the window but none in the order, and so does NaN."""

    def __init__(self, size: int):
        self.size, self.values, self.ordered = size, deque(), []

    def push(self, value: float | None) -> None:
        if value is not None and value != value:
            value = None
        self.values.append(value)
        if value is not None:
            insort(self.ordered, value)
        if len(self.values) > self.size:
            old = self.values.popleft()
            if old is not None:
                del self.ordered[bisect_left(self.ordered, old)]

    def quantile(self, q: float) -> float | None:
        if not self.ordered:
            return None
        place = q * (len(self.ordered) - 1)
        low = int(place)
        value = self.ordered[low]
        return value if place == low else value + (self.ordered[low + 1] - value) * (place - low)


def rolling_quantile(rows: DataFrame, value: str, to: str, window: int, least: int, q: float = 0.5, skip: int = 0, key: str = "symbol", order: str = "date") -> DataFrame:
    """``rows`` with ``to``: the interpolated quantile of ``value`` over the ``window`` rows that end ``skip`` rows back, null with fewer than ``least`` values.

    One shuffle and one sort by ``key``; then each row enters and leaves a sorted window of its key once, in Arrow batches, so the time is linear in the rows and the
    memory is that of the window, whatever the key's rows are. A frame of a window function would sort its rows anew for every row.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in [*rows.dtypes, (to, "double")])

    def of(batches):
        at, held, waiting = None, SortedWindow(window), deque()
        for batch in batches:
            out = []
            for k, v in zip(batch.column(key).to_pylist(), batch.column("_value").to_pylist()):
                if k != at:
                    at, held, waiting = k, SortedWindow(window), deque()
                waiting.append(v)
                if len(waiting) > skip:
                    held.push(waiting.popleft())
                out.append(held.quantile(q) if len(held.ordered) >= least else None)
            names = [c for c in batch.schema.names if c != "_value"]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(out, pa.float64())], [*names, to])

    ordered = rows.withColumn("_value", F.col(value).cast("double")).repartition(key).sortWithinPartitions(key, order)
    return ordered.mapInArrow(of, schema)
