"""Queries of loaders, scalar functions (F) and composition (X)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import quotes as q
from ..functions.windows import rolling
from ..operators import reports
from ..operators.asof import next_on_buckets
from ..operators.compose import chain_of, sample_of_size, seeded_sample
from ..operators.panels import first_by
from ..sources import store
from ..sources.roles import Roles, with_roles
from .joins_queries import raw_chain
from .panel_queries import _PANEL, _SUMMARY, stock_panel, summarized
from .registry import query


def built(r: Roles, **tables) -> str:
    """A store of these tables: each written as the loaders expect it, below a path of its own."""
    root = store.scratch(r.spark, "store")
    for name, (df, partition) in tables.items():
        store.write_table(df, f"{root}/{name}", partition)
    return root


@query(with_roles("chain", 'select date, symbol, expiration, strike, "right", bid from chain where symbol in (\'S1\', \'S3\') and date between date \'1996-01-01\' and date \'1996-12-31\''))
def s4_s5_windowed_chain(r: Roles):
    """A window of a chain that lies by year and symbol."""
    root = built(r, option_greeks=(store.scan_chain(raw_chain(r)).withColumn("year", F.year("date")), ["year", "symbol"]))
    return store.load_chain(r.spark, root, "option_greeks", "1996-01-01", "1996-12-31", ["s1", "s3"]).select("date", "symbol", "expiration", "strike", "right", "bid")


@query(with_roles("bars", "select * from bars where date < date '1996-01-01' union all select * from bars where date >= date '1997-01-01' and date <= date '1997-12-31'"))
def s3_history_and_current_files(r: Roles):
    """One scan of a history's and a current table's files, over a window."""
    root = built(r, history=(r.bars.filter("date < '1996-01-01'"), None), current=(r.bars.filter("date >= '1997-01-01'"), None))
    return store.scan(r.spark, [f"{root}/history", f"{root}/current"], "bars", None, "1997-12-31")


@query(with_roles("xs_bars", "select date, close as rate from xs_bars where symbol = '3' and date <= date '1997-01-01'"))
def s8_reference_series(r: Roles):
    root = built(r, yields=(r.xs_bars.select("date", F.col("symbol").alias("tenor"), F.col("close").alias("rate")), None))
    return store.load_rates(r.spark, root, "3", None, "1997-01-01")


@query(with_roles("sectors announcements actions", """select symbol, cast(date as varchar) as value, 'announcement' as kind from announcements where date >= date '1996-01-01' union all select symbol, sector, 'sector' from sectors
    union all select symbol, cast(value as varchar), 'split' from actions where action = 'split'"""))
def s9_event_and_sector_tables(r: Roles):
    root = built(r, earnings=(r.announcements, None), sectors=(r.sectors, None), corporate_actions=(r.actions, None))
    a = store.load(r.spark, root, "earnings", "1996-01-01").select("symbol", F.col("date").cast("string").alias("value"), F.lit("announcement").alias("kind"))
    b = store.load(r.spark, root, "sectors").select("symbol", F.col("sector").alias("value"), F.lit("sector").alias("kind"))
    c = store.load_splits(r.spark, root).select("symbol", F.col("ratio").cast("string").alias("value"), F.lit("split").alias("kind"))
    return a.unionByName(b).unionByName(c)


@query(with_roles("bars", "select 'bars' as dataset, cast(year(date) as integer) as year, cast(count(distinct symbol) as integer) as symbols, cast(count(distinct symbol) as integer) as files, true as has_bytes from bars group by year(date)"))
def s15_store_inventory(r: Roles):
    """Datasets, years, symbols and files on disk."""
    root = built(r, bars=(r.bars.withColumn("year", F.year("date")), ["year", "symbol"]))
    return store.describe_store(r.spark, root).select("dataset", "year", "symbols", "files", (F.col("bytes") > 0).alias("has_bytes"))


@query(with_roles("bars", "select 'bars' as dataset, cast(null as varchar) as job, symbol, count(*) as rows from bars group by symbol union all select 'rates', 'reference', null, null"))
def s2_missing_dataset(r: Roles):
    """What a store holds by symbol; a dataset that is not there names the job that builds it."""
    root = built(r, bars=(r.bars, None))
    out = None
    for name, job in (("bars", "bars"), ("rates", store.TABLES["rates"][0])):
        try:
            rows = store.require(r.spark, f"{root}/{name}", job).groupBy("symbol").agg(F.count("*").alias("rows")).select(F.lit(name).alias("dataset"), F.lit(None).cast("string").alias("job"), "symbol", "rows")
        except store.MissingDataset as e:
            rows = r.spark.range(1).select(F.lit(name).alias("dataset"), F.lit(e.job).alias("job"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("long").alias("rows"))
        out = rows if out is None else out.unionByName(rows)
    return out


def bucketed(r: Roles, df, name: str):
    """``df`` as a bucketed table of its own."""
    path = store.scratch(r.spark, name)
    table = f"{name}_{path.rsplit('-', 1)[1]}"
    store.write_buckets(df, table, path)
    return r.spark.table(table)


@query(with_roles("bars announcements", """w as (select date, symbol, avg(close) over (partition by symbol order by date rows between 9 preceding and current row) as mean, count(*) over (partition by symbol order by date rows between 9 preceding and current row) as n from bars)
    select w.date, w.symbol, round(mean, 3) as mean_close, cast((select min(a.date) from announcements a where a.symbol = w.symbol and a.date >= w.date) - w.date as integer) as days_to_event from w where n = 10"""))
def s4_bucketed_windows(r: Roles):
    """Rolling means and the next event by symbol, from tables that lie by symbol: the plan shuffles neither."""
    bars, events = bucketed(r, r.bars, "bars_by_symbol"), bucketed(r, r.announcements, "events_by_symbol")
    w = Window.partitionBy("symbol").orderBy("date")
    rows = bars.select("date", "symbol", rolling(F.avg, F.col("close"), w, 10).alias("mean_close")).filter("mean_close is not null")
    out = next_on_buckets(rows, events)
    return out.select("date", "symbol", F.round("mean_close", 3).alias("mean_close"), F.datediff("next_event", "date").alias("days_to_event"))


@query(with_roles("bars", "select cast(year(date) as integer) as year, count(distinct symbol || '|' || date) as exact, true as sketch_within_3_percent from bars group by 1 union all select null, count(distinct symbol || '|' || date), true from bars where date between date '1995-01-01' and date '1997-12-31'"))
def a22_sketched_pairs(r: Roles):
    """Distinct pairs of symbol and day by year, from stored sketches, and of a window from the union of its years' sketches."""
    pair = F.concat_ws("|", "symbol", F.col("date").cast("string"))
    rows = r.bars.select(F.year("date").alias("year"), pair.alias("pair"))
    root = built(r, sketches=(reports.distinct_sketches(rows, ["year"], "pair"), ["year"]))
    sketches = store.require(r.spark, f"{root}/sketches", "sketches")
    exact = rows.groupBy("year").agg(F.count_distinct("pair").alias("exact"))
    window = "year between 1995 and 1997"
    whole = rows.filter(window).agg(F.lit(None).cast("int").alias("year"), F.count_distinct("pair").alias("exact"))
    found = reports.sketched_distinct(sketches, ["year"]).unionByName(reports.sketched_distinct(sketches.filter(window), []).withColumn("year", F.lit(None).cast("int")))
    both = exact.unionByName(whole).join(found.withColumnRenamed("year", "_year"), F.col("year").eqNullSafe(F.col("_year")))
    return both.select("year", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.03 * F.col("exact")).alias("sketch_within_3_percent"))


@query(with_roles("bars", "select date, symbol, close + 1 as close from bars"))
def s16_replaced_table(r: Roles):
    """A table that is written, and replaced as a whole by what is read from it."""
    root = built(r, bars=(r.bars.select("date", "symbol", "close"), None))
    store.write_table(store.require(r.spark, f"{root}/bars", "bars").withColumn("close", F.col("close") + 1), f"{root}/bars", None, ["date"])
    return store.require(r.spark, f"{root}/bars", "bars")


@query(with_roles("bars", "select date, symbol, cast(year(date) as integer) as year, case when year(date) = 1996 then -1.0 else close end as close from bars"))
def s17_replaced_years(r: Roles):
    """One year of a table replaced, the others kept."""
    rows = r.bars.select("date", "symbol", "close", F.year("date").alias("year"))
    root = built(r, bars=(rows, ["year"]))
    store.replace_years(rows.filter("year = 1996").withColumn("close", F.lit(-1.0)), f"{root}/bars")
    return store.require(r.spark, f"{root}/bars", "bars").select("date", "symbol", "year", "close")


@query(with_roles("bars", "select symbol, count(*) as days, row_number() over (order by symbol) as line from bars group by 1"))
def s18_t10_sorted_report(r: Roles):
    """A small result as one sorted file: the place of each line in it."""
    path = store.scratch(r.spark, "report")
    store.write_report(r.bars.groupBy("symbol").agg(F.count("*").alias("days")), path, ["symbol"])
    lines = r.spark.read.option("header", True).schema("symbol string, days long").csv(path).withColumn("at", F.monotonically_increasing_id())
    return lines.select("symbol", "days", F.row_number().over(Window.orderBy("at")).cast("long").alias("line"))


@query(with_roles("bars", "select date, symbol, open, high, low, close, cast(0 as bigint) as volume from bars where symbol = 'S0'"))
def s20_index_bars(r: Roles):
    root = built(r, indices=(r.bars.drop("volume"), None))
    return store.index_bars(store.load(r.spark, root, "indices", symbol="S0"))


@query(with_roles("membership ticks", "select distinct replace(upper('b.' || symbol), '.', '-') as symbol from membership where date between date '2024-01-05' and date '2024-01-15' and 'B-' || symbol not in (select 'B-' || symbol from ticks where close > 200) order by 1 limit 40"))
def s21_first_members(r: Roles):
    """The first 40 members of a window by name, spelled with a dash, without those that are excluded."""
    members = r.membership.withColumn("symbol", F.concat(F.lit("b."), "symbol"))
    known = r.ticks.filter("close > 200").select(F.concat(F.lit("B-"), "symbol").alias("symbol"))
    return store.universe_symbols(members, "2024-01-05", "2024-01-15", "-", known, 40)


@query(with_roles("ticks", "select cast(year(date) as integer) as year, symbol from ticks group by 1, 2 having count(*) >= 18"))
def s23_quality_verdicts(r: Roles):
    """Symbol-years that a stored verdict doesn't rule out."""
    verdicts = r.ticks.groupBy(F.year("date").alias("year"), "symbol").agg(F.count("*").alias("days"))
    verdicts = verdicts.withColumn("status", F.when(F.col("days") < 18, "wrong_instrument").when(F.col("days") < 25, "thin_overlap").otherwise("ok"))
    root = built(r, symbology_check=(verdicts, None))
    return store.usable_symbol_years(store.load(r.spark, root, "symbology_check")).select("year", "symbol")


@query(with_roles("chain", """select date, symbol, count(*) as rows, round(sum(bid), 4) as bids, max(oi) as open_interest from chain where date >= date '1997-01-01' group by 1, 2"""))
def s24_raw_scan(r: Roles):
    """The vendor's rows as they are, with a date, over a window."""
    root = built(r, raw=(raw_chain(r).drop("theta", "vega"), None))
    rows = store.scan_raw(r.spark, f"{root}/raw", "option-greeks", "1997-01-01")
    return rows.groupBy("date", "symbol").agg(F.count("*").alias("rows"), F.round(F.sum("bid"), 4).alias("bids"), F.max("open_interest").alias("open_interest"))


@query("select s_suppkey, replace(upper(s_name), '#', '.') as ticker, replace(replace(upper(s_name), '#', '.'), '.', '') as option_symbol, replace(replace(upper(s_name), '#', '.'), '.', '-') as dashed, regexp_extract(s_name, '([0-9]+)$', 1) as digits, split_part(s_name, '#', 1) as prefix from supplier")
def f1_f6_tickers(r: Roles):
    ticker = F.regexp_replace(F.upper("s_name"), "#", ".")
    return r.table("supplier").select("s_suppkey", ticker.alias("ticker"), q.normal_ticker(ticker).alias("option_symbol"), q.normal_ticker(ticker, separator="-").alias("dashed"), F.regexp_extract("s_name", "([0-9]+)$", 1).alias("digits"), F.split_part(F.col("s_name"), F.lit("#"), F.lit(1)).alias("prefix"))


@query(with_roles("bars", """select date, symbol, cast(year(date) as integer) as year, cast(day(date) as integer) as day, cast(isodow(date) as integer) as weekday, cast(date_trunc('month', date) as date) as month, cast(date - cast(date_trunc('year', date) as date) as integer) as days, strptime(strftime(date, '%Y-%m-%d'), '%Y-%m-%d')::date as parsed from bars"""))
def f2_dates(r: Roles):
    return r.bars.select("date", "symbol", F.year("date").alias("year"), F.dayofmonth("date").alias("day"), (F.weekday("date") + 1).alias("weekday"), F.trunc("date", "month").alias("month"), F.datediff("date", F.trunc("date", "year")).alias("days"), F.to_date(F.date_format("date", "yyyy-MM-dd"), "yyyy-MM-dd").alias("parsed"))


@query(with_roles("bars", """select date, symbol, round(ln(close) + sqrt(abs(open)) + pow(low / high, 2) + exp(-close / high), 6) as mix, cast(floor(close) as bigint) as low_int, cast(ceil(close) as bigint) as high_int, greatest(open, close) as top, least(open, close, 1000.0) as bottom, coalesce(case when volume > 50 then close end, 0.0) as filled from bars"""))
def f3_f4_math_and_nulls(r: Roles):
    c = F.col
    mix = F.ln("close") + F.sqrt(F.abs("open")) + F.pow(c("low") / c("high"), F.lit(2)) + F.exp(-c("close") / c("high"))
    return r.bars.select("date", "symbol", F.round(mix, 6).alias("mix"), F.floor("close").alias("low_int"), F.ceil("close").alias("high_int"), F.greatest("open", "close").alias("top"), F.least(c("open"), c("close"), F.lit(1000.0)).alias("bottom"), F.coalesce(F.when(c("volume") > 50, c("close")), F.lit(0.0)).alias("filled"))


@query(with_roles("chain", """g as (select date, symbol, list_sort(list(distinct strike)) as s from chain group by 1, 2) select date, symbol, cast(len(s) as integer) as n, s[1] as first, s[-1] as last, round(list_sum(s), 4) as total from g"""))
def f7_gathered_arrays(r: Roles):
    rows = r.chain.groupBy("date", "symbol").agg(F.sort_array(F.collect_set("strike")).alias("s"))
    return rows.select("date", "symbol", F.size("s").alias("n"), F.element_at("s", 1).alias("first"), F.element_at("s", -1).alias("last"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(with_roles("chain", """select count(*) as rows, count(distinct symbol) as symbols, (select count(*) from (select distinct date, symbol from chain)) as pairs from chain"""))
def a19_distinct_counts(r: Roles):
    pairs = r.chain.select("date", "symbol").distinct().agg(F.count("*").alias("pairs"))
    return r.chain.agg(F.count("*").alias("rows"), F.count_distinct("symbol").alias("symbols")).crossJoin(pairs)


@query(None)
def p10_seeded_sample(r: Roles):
    """A tenth of the rows, the same on every run: the feature is the sample."""
    return seeded_sample(r.xs_bars.select("date", "symbol", "close"), 0.1, 1, ["date", "symbol"])


@query(with_roles("xs_bars", "select date, symbol, close from xs_bars order by md5('7|' || date || '|' || symbol) limit 800"))
def p10_sample_of_size(r: Roles):
    """Eight hundred rows by hash, the same on every run and for any partitions: the feature is the sample."""
    return sample_of_size(r.xs_bars.select("date", "symbol", "close"), 800, 7, ["date", "symbol"])


@query(with_roles("xs_bars", """w as (select date, symbol, close, row_number() over (partition by date order by close desc, symbol) as n from xs_bars where volume > 20) select date, symbol, close, close * 2 as doubled from w where n <= 3"""))
def x4_composed_steps(r: Roles):
    steps = chain_of(lambda d: d.filter("volume > 20"), lambda d: first_by(d, ["date"], [F.col("close").desc(), F.col("symbol")], 3), lambda d: d.withColumn("doubled", F.col("close") * 2))
    return r.xs_bars.transform(steps).select("date", "symbol", "close", "doubled")


@query(with_roles("xs_bars", f"""{_PANEL}, two as (select month, decile, unnest(['ret', 'net']) as strategy, unnest([ret, ret - 0.002]) as v from panel), pm as (select strategy, month, decile, avg(v) as v from two group by 1, 2, 3),
    port as (select strategy, month, cast(decile as varchar) as decile, v from pm union all select t.strategy, t.month, '10-1', t.v - b.v from pm t join pm b on b.strategy = t.strategy and b.month = t.month and b.decile = 1 where t.decile = 10)
    select strategy, decile, {_SUMMARY} from port group by 1, 2"""))
def a23_strategy_deciles(r: Roles):
    """Two strategies by decile: the month's return before and after a fixed cost."""
    panel = stock_panel(r).withColumn("net", F.col("ret") - 0.002)
    return summarized(reports.returns_table(reports.portfolio_returns(panel, ["ret", "net"]), ["ret", "net"]))


@query(with_roles("xs_bars", f"{_PANEL} select {_SUMMARY.replace('v)', 'ret)').replace('(v', '(ret').replace('1 + v', '1 + ret')} from panel"))
def a5_summary(r: Roles):
    """Summary statistics of all returns of the panel."""
    return summarized(stock_panel(r).agg(*reports.summary_columns(F.col("ret"))))


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 4) as quantity, grouping(l_returnflag) + 2 * grouping(l_linestatus) as level from lineitem group by cube (l_returnflag, l_linestatus)")
def a22_subtotals(r: Roles):
    """All subtotals of two keys in one pass."""
    level = F.grouping("l_returnflag").cast("long") + 2 * F.grouping("l_linestatus").cast("long")
    return r.table("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"), level.alias("level"))


@query(with_roles("xs_bars sectors", "f as (select date, sector as factor, round(avg(close), 6) as ret from xs_bars join sectors using (symbol) group by 1, 2) select * from f where date between date '1996-01-01' and date '1996-06-30' and factor in ('ASIA', 'EUROPE')"))
def s10_risk_table_window(r: Roles):
    """A window of the stored factor returns, some factors."""
    table = r.xs_bars.join(r.sectors, "symbol").groupBy("date", F.col("sector").alias("factor")).agg(F.round(F.avg("close"), 6).alias("ret"))
    root = built(r, vol_factor_returns=(table, None))
    return store.load(r.spark, root, "vol_factor_returns", "1996-01-01", "1996-06-30", factor=["ASIA", "EUROPE"])


@query(with_roles("chain", "select symbol, count(*) filter (iv > 0 and abs(iv - 0.15) <= 0.05) as valid, count(*) as n from chain group by 1"))
def p4_valid_iv(r: Roles):
    good = q.has_valid_iv(tolerance=0.05)
    return r.chain.withColumn("iv_error", F.col("iv") - 0.15).groupBy("symbol").agg(F.count_if(good).alias("valid"), F.count("*").alias("n"))
