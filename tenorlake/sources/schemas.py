"""Table schemas, and ``conform`` to bring a frame to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

KINDS = {"date": DateType(), "string": StringType(), "double": DoubleType(), "bigint": LongType(), "int": IntegerType(), "boolean": BooleanType()}


def schema(text: str) -> StructType:
    """From ``name kind, ...``, without a session."""
    return StructType([StructField(name, KINDS[kind]) for name, kind in (part.split() for part in text.split(", "))])


CHAIN = schema("date date, symbol string, expiration date, strike double, right string, bid double, ask double, mid double, iv double, delta double, gamma double, theta double, vega double, underlying double, oi bigint, volume bigint")
STOCKS = schema("date date, symbol string, open double, high double, low double, close double, volume bigint")
UNIVERSE = schema("date date, symbol string")
EVENTS = schema("symbol string, event_date date, session string, event_session date")
JUMP = schema("date date, symbol string, next_event date, days_to_event int, jump_var double, method string")
REFERENCE = schema("date date, symbol string, pnl_per_vega double, cost_per_vega double, exit_cost_per_vega double, dollar_vega double, entry_vega double, mid double, underlying double, dte int, event string")
RECORDS = schema("date date, symbol string, units double, option_pnl double, option_cost double, dollar_vega double, exit_cost double, stale boolean, event string")
TARGETS = schema("date date, symbol string, target_vega double")


def conform(df: DataFrame, to: StructType) -> DataFrame:
    """Exactly the columns of ``to``, in order and cast; a column that ``df`` lacks is null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in to.fields))
