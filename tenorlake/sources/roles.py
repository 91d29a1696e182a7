"""The driver's tables in the roles of option chains, bars, events and members.

``Roles`` gives them as DataFrames; ``ROLE_SQL`` is the same as DuckDB SQL for the oracles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import half_away

#: Rows of a partition where the role's table is laid out by symbol.
LINES = 200_000


class Roles:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._kept: dict[str, DataFrame] = {}

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table that a query reads several times, computed once and persisted: a stored table in production."""
        if name not in self._kept:
            self._kept[name] = build().persist()
        return self._kept[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def names(self) -> int:
        """Symbols of bars, chains and announcements: one for each 20 suppliers, so they grow with the tables; five at least."""
        return max(5, self.table("supplier").count() // 20)

    @cached_property
    def parts(self) -> int:
        """Partitions of ``LINES`` rows of the largest table; counted from its footers."""
        return max(1, -(-self.table("lineitem").count() // LINES))

    def name_of(self, key: str) -> Column:
        return F.concat(F.lit("S"), (F.col(key) % self.names).cast("string"))

    @cached_property
    def bars(self) -> DataFrame:
        """Daily bars, a symbol for each 20 suppliers."""
        return self._bars(self.table("lineitem"), F.to_date("l_shipdate"), self.name_of("l_suppkey"))

    @cached_property
    def xs_bars(self) -> DataFrame:
        """Monthly bars of one symbol for each supplier; laid out by symbol as the chain is, and kept: books and sweeps read them many times."""
        month, symbol = F.to_date(F.date_trunc("month", "l_shipdate")), F.col("l_suppkey").cast("string")
        return self.kept("xs_bars", lambda: self._bars(self.table("lineitem").repartition(self.parts, symbol.alias("symbol")), month, symbol))

    def _bars(self, lines, date, symbol) -> DataFrame:
        price = F.col("l_extendedprice") / F.col("l_quantity")
        order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
        return lines.groupBy(date.alias("date"), symbol.alias("symbol")).agg(
            F.round(F.min_by(price, order), 8).alias("open"),
            F.round(F.max(price), 8).alias("high"),
            F.round(F.min(price), 8).alias("low"),
            F.round(F.max_by(price, order), 8).alias("close"),
            F.sum("l_quantity").cast("bigint").alias("volume"),
        )

    @cached_property
    def chain(self) -> DataFrame:
        """Weekly option quotes on underlyings of 100, a symbol for each 20 suppliers; all of a symbol in one of as many partitions as the rows ask for.

        Queries of the chain group and order by symbol and more, so they need no further shuffle, and their tasks stay the same size.
        """
        week = F.to_date(F.date_trunc("week", "l_shipdate"))
        key = {
            "date": week,
            "symbol": self.name_of("l_suppkey"),
            "expiration": F.date_add(week, (7 * (2 + 4 * (F.col("l_linenumber") % 3))).cast("int")),
            "strike": (10 * F.floor((F.col("l_quantity") - 1) / 10) + 80).cast("double"),
            "right": F.when(F.col("l_tax") < 0.04, "C").otherwise("P"),
        }
        lines = self.table("lineitem").withColumns(key).select(*key, "l_discount", "l_tax", "l_linenumber")
        quotes = lines.repartition(self.parts, "symbol").groupBy(*key).agg(
            F.round(F.min("l_discount") * 10 + 0.05, 4).alias("bid"),
            F.round(F.min("l_discount") * 10 + 0.15 + F.max("l_tax"), 4).alias("ask"),
            F.round(F.avg("l_discount") + 0.1, 6).alias("iv"),
            F.count("*").alias("volume"),
            F.sum("l_linenumber").cast("bigint").alias("oi"),
        )
        call = 0.5 + (100 - F.col("strike")) / 100
        return quotes.withColumn("underlying", F.lit(100.0)).withColumn("delta", F.round(F.when(F.col("right") == "C", call).otherwise(call - 1), 6))

    @cached_property
    def kept_chain(self) -> DataFrame:
        """The chain for queries that read it several times."""
        return self.kept("chain", lambda: self.chain)

    @cached_property
    def announcements(self) -> DataFrame:
        """Of each symbol and month the day of its largest order: a few events a year, from all orders."""
        session = F.when(F.col("o_orderstatus") == "O", "amc").when(F.col("o_orderstatus") == "F", "bmo").otherwise("unknown")
        largest = F.max_by(F.struct(F.to_date("o_orderdate").alias("date"), session.alias("session")), F.struct("o_totalprice", "o_orderkey"))
        months = self.table("orders").groupBy(self.name_of("o_custkey").alias("symbol"), F.trunc("o_orderdate", "month").alias("month")).agg(largest.alias("e"))
        return months.select("symbol", "e.date", "e.session")

    @cached_property
    def actions(self) -> DataFrame:
        """Splits of 2 and dividends, several a day for some."""
        kind = F.when(F.col("event_type") == "signup", "split").otherwise("dividend")
        return self.table("events").filter(F.col("event_type").isin("signup", "purchase")).select(
            F.col("user_id").cast("string").alias("symbol"), F.to_date("ts").alias("date"), kind.alias("action"), F.when(kind == "split", 2.0).otherwise(F.round("value", 4)).alias("value")
        )

    @cached_property
    def ticks(self) -> DataFrame:
        """Each user's last known value of a day."""
        known = F.when(F.col("value").isNotNull(), F.struct("ts", "event_id"))
        return self.table("events").groupBy(F.col("user_id").cast("string").alias("symbol"), F.to_date("ts").alias("date")).agg(half_away(F.max_by("value", known), 6).alias("close"))

    @cached_property
    def membership(self) -> DataFrame:
        return self.table("events").filter("event_type = 'view'").select(F.to_date("ts").alias("date"), F.col("user_id").cast("string").alias("symbol")).distinct()

    @cached_property
    def sectors(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        return self.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("r_name").alias("sector"))

    @cached_property
    def sessions(self) -> DataFrame:
        """Trading days and their indexes, from the bars."""
        from ..operators.calendar import session_index

        return session_index(self.bars.select("date"))


_BARS = """select {date} as date, {symbol} as symbol,
    round(min_by(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)), 8) as open,
    round(max(l_extendedprice / l_quantity), 8) as high, round(min(l_extendedprice / l_quantity), 8) as low,
    round(max_by(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)), 8) as close,
    cast(sum(l_quantity) as bigint) as volume
  from lineitem group by 1, 2"""

_NAMES = "(select greatest(5, count(*) // 20) from supplier)"

ROLE_SQL = {
    "bars": _BARS.format(date="cast(l_shipdate as date)", symbol=f"'S' || cast(l_suppkey % {_NAMES} as varchar)"),
    "xs_bars": _BARS.format(date="cast(date_trunc('month', l_shipdate) as date)", symbol="cast(l_suppkey as varchar)"),
    "chain": f"""select *, 100.0::double as underlying, round(case when "right" = 'C' then 0.5 + (100 - strike) / 100 else (100 - strike) / 100 - 0.5 end, 6) as delta from (
    select week as date, 'S' || cast(l_suppkey % {_NAMES} as varchar) as symbol, week + cast(7 * (2 + 4 * (l_linenumber % 3)) as integer) as expiration,
    cast(10 * floor((l_quantity - 1) / 10) + 80 as double) as strike, case when l_tax < 0.04 then 'C' else 'P' end as "right",
    round(min(l_discount) * 10 + 0.05, 4) as bid, round(min(l_discount) * 10 + 0.15 + max(l_tax), 4) as ask,
    round(0.1 + avg(l_discount), 6) as iv, count(*) as volume, cast(sum(l_linenumber) as bigint) as oi
  from (select *, cast(date_trunc('week', l_shipdate) as date) as week from lineitem) group by 1, 2, 3, 4, 5)""",
    "announcements": f"""select symbol, cast(d as date) as date, session from (select 'S' || cast(o_custkey % {_NAMES} as varchar) as symbol, date_trunc('month', o_orderdate) as month,
    max_by(o_orderdate, (o_totalprice, o_orderkey)) as d, max_by(case o_orderstatus when 'O' then 'amc' when 'F' then 'bmo' else 'unknown' end, (o_totalprice, o_orderkey)) as session from orders group by 1, 2)""",
    "actions": """select cast(user_id as varchar) as symbol, cast(ts as date) as date, case event_type when 'signup' then 'split' else 'dividend' end as action,
    case event_type when 'signup' then 2.0::double else round(value, 4) end as value from events where event_type in ('signup', 'purchase')""",
    "ticks": "select cast(user_id as varchar) as symbol, cast(ts as date) as date, round(max_by(value, (ts, event_id)), 6) as close from events group by 1, 2",
    "membership": "select distinct cast(ts as date) as date, cast(user_id as varchar) as symbol from events where event_type = 'view'",
    "sectors": "select cast(s_suppkey as varchar) as symbol, r_name as sector from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
    "sessions": "select date, row_number() over (order by date) - 1 as session_index from (select distinct cast(l_shipdate as date) as date from lineitem)",
}


def with_roles(names: str, body: str) -> str:
    """SQL with the named roles as common table expressions; ``body`` starts with further ones or with ``select``."""
    ctes = ", ".join(f"{n} as ({ROLE_SQL[n]})" for n in names.split())
    return f"with {ctes}{'' if body.lstrip().lower().startswith('select') else ','} {body}"
