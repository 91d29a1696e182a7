"""Where queries register with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import half_away
from ..sources.roles import Roles

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of ``Roles`` under its name, with DuckDB SQL for the same rows."""

    def put(build: Callable[[Roles], DataFrame]):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(Roles(spark, sf_dir))
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return put


def r6(c: str | Column, digits: int = 6) -> Column:
    """Rounded, since engines add up doubles in different orders; the name stays. Adding zero turns -0.0 into 0.0."""
    if isinstance(c, str):
        return (half_away(F.col(c), digits) + 0.0).alias(c)
    return half_away(c, digits) + 0.0


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded."""
    return df.select(*(r6(c, digits) if t == "double" else F.col(c) for c, t in df.dtypes))
