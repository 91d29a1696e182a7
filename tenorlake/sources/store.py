"""The table store: Parquet by year and symbol, windowed reads, versions that a commit makes current, bucketed tables."""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid
from collections.abc import Callable
from datetime import date as Date
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quotes import mid, normal_ticker, right_letter
from .schemas import CHAIN, STOCKS, UNIVERSE, conform


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which all executors share; a local master that names none has a folder of its own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="store-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a checkpoint in the folder that all executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or scratch(df.sparkSession, "checkpoints"))
    return df.checkpoint()


class MissingDataset(FileNotFoundError):
    """A table that a job has not built yet."""

    def __init__(self, path: str, job: str):
        super().__init__(f"{path} is missing; build it with the {job} job")
        self.path, self.job = path, job


#: A table that is replaced has a folder of commits: files ``<number>.json``, each naming the data folders of one state, ``{"folders": {name: years}}``
#: with null for all that a folder holds. The last number is current. Data folders never change once a commit names them.
COMMITS = "_commits"
#: Seconds that data of earlier commits stays, for readers that began before the last one.
RETAIN = 3600.0


def _commits(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the commits of a table, in order."""
    names = [x.getPath().getName() for x in _below(spark, f"{path}/{COMMITS}")]
    return sorted(int(n[:-5]) for n in names if re.fullmatch(r"[0-9]+\.json", n))


def _state(spark: SparkSession, path: str, number: int) -> dict[str, list[int] | None]:
    fs, target = _files(spark, f"{path}/{COMMITS}/{number:010d}.json")
    stream = fs.open(target)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["folders"]
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> dict[str, list[int] | None] | None:
    """The data folders of a table as its last commit has them, each with its years or null; None for a table without commits."""
    numbers = _commits(spark, path)
    return _state(spark, path, numbers[-1]) if numbers else None


def commit(spark: SparkSession, path: str, change: Callable[[dict | None], dict], tries: int = 20) -> None:
    """Makes what ``change`` makes of the last state current.

    The state is written beside and renamed to the next number, which fails if another writer has taken it: then ``change`` is asked again with what that one
    wrote. Until the rename readers see the state before, after it the new one; a writer that dies leaves files that no commit names.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    for _ in range(tries):
        numbers = _commits(spark, path)
        state = change(_state(spark, path, numbers[-1]) if numbers else None)
        fs, beside = _files(spark, f"{path}/{COMMITS}/{uuid.uuid4().hex}.tmp")
        out = fs.create(beside, False)
        out.write(bytearray(json.dumps({"folders": state}).encode()))
        out.close()
        _, target = _files(spark, f"{path}/{COMMITS}/{(numbers[-1] if numbers else 0) + 1:010d}.json")
        try:
            # without the option to overwrite: an error if the number is taken
            hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(target), spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return
        except Py4JJavaError as e:
            fs.delete(beside, False)
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
    raise RuntimeError(f"{path}: other writers were first {tries} times")


def vacuum(spark: SparkSession, path: str, retain: float = RETAIN) -> None:
    """Removes commits, but the last, that are older than ``retain`` seconds, and as old data folders that no commit left names."""
    fs, _ = _files(spark, path)
    old = lambda status: status.getModificationTime() < 1000 * (time.time() - retain)
    numbers = _commits(spark, path)
    for status in _below(spark, f"{path}/{COMMITS}"):
        if old(status) and status.getPath().getName() != f"{max(numbers, default=0):010d}.json":
            fs.delete(status.getPath(), False)
    named = {f for n in _commits(spark, path) for f in _state(spark, path, n)}
    for status in _below(spark, path):
        if status.getPath().getName().startswith("v-") and status.getPath().getName() not in named and old(status):
            fs.delete(status.getPath(), True)


def _parts(spark: SparkSession, path: str) -> list[DataFrame]:
    """A read of each data folder that the current state of a table has."""
    folders = current(spark, path)
    if folders is None:
        return [spark.read.parquet(path)]
    based = [(f"{path}/{name}".rstrip("/"), years) for name, years in folders.items()]
    return [spark.read.parquet(base) if years is None else spark.read.option("basePath", base).parquet(*(f"{base}/year={y}" for y in years)) for base, years in based]


def _united(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def require(spark: SparkSession, paths: str | list[str], job: str) -> DataFrame:
    """The Parquet table at ``paths``, as its last commit has it if it has commits; ``MissingDataset`` names the job that builds it if there is none."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    try:
        if not any(_commits(spark, p) for p in paths):
            return spark.read.parquet(*paths)
        return _united([part for p in paths for part in _parts(spark, p)])
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            raise MissingDataset(", ".join(paths), job) from e
        raise


def in_window(df: DataFrame, start: Date | str | None = None, end: Date | str | None = None, column: str = "date", year: str | None = None) -> DataFrame:
    """Rows from ``start`` to ``end``, both included; an end that is None is open.

    With ``year``, a partition column, its range is filtered too, so that only those directories are read.
    """
    for bound, keep in ((start, "__ge__"), (end, "__le__")):
        if bound is not None:
            bound = Date.fromisoformat(bound) if isinstance(bound, str) else bound
            df = df.filter(getattr(F.col(column), keep)(F.lit(bound)))
            if year:
                df = df.filter(getattr(F.col(year), keep)(bound.year))
    return df


def scan(spark: SparkSession, paths: str | list[str], job: str, start=None, end=None, symbols: list[str] | None = None, column: str = "date", year: str | None = None) -> DataFrame:
    """Windowed read of one table or of history and current files together."""
    df = in_window(require(spark, paths, job), start, end, column, year)
    return df if symbols is None else df.filter(F.col("symbol").isin(symbols))


def scan_chain(raw: DataFrame, oi: DataFrame | None = None, iv_error_tol: float = 1.0, vega_scale: float = 1.0) -> DataFrame:
    """The canonical chain of a vendor's: date and expiration as dates, ``C``/``P``, mid, IV only where its inversion is good, open interest."""
    key = ["date", "symbol", "expiration", "strike", "right"]
    out = raw.select(
        F.to_date("underlying_timestamp").alias("date"),
        "symbol",
        F.to_date("expiration").alias("expiration"),
        F.col("strike").cast("double").alias("strike"),
        right_letter().alias("right"),
        "bid",
        "ask",
        mid().alias("mid"),
        F.when((F.col("implied_vol") > 0) & (F.abs("iv_error") <= iv_error_tol), F.col("implied_vol")).alias("iv"),
        "delta",
        "theta",
        (F.col("vega") * vega_scale).alias("vega"),
        F.col("underlying_price").alias("underlying"),
        F.col("volume").cast("bigint").alias("volume"),
    )
    if oi is not None:
        out = out.join(scan_open_interest(oi), key, "left")
    return conform(out, CHAIN)


def scan_open_interest(raw: DataFrame) -> DataFrame:
    """``date, symbol, expiration, strike, right, oi``: the last stamp's figure of each contract and day."""
    key = [F.to_date("timestamp").alias("date"), F.col("symbol"), F.to_date("expiration").alias("expiration"), F.col("strike").cast("double").alias("strike"), right_letter().alias("right")]
    return raw.groupBy(*key).agg(F.max_by("open_interest", F.struct("timestamp", "open_interest")).cast("bigint").alias("oi"))


def scan_stocks(raw: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """Bars with a positive close, tickers without dots; with ``splits (symbol, date, ratio)`` a ``split_ratio``, 1 where there is none."""
    bars = conform(raw.filter(F.col("close") > 0).withColumn("symbol", normal_ticker("symbol")), STOCKS)
    if splits is None:
        return bars
    ratios = splits.groupBy("symbol", "date").agg(F.max("ratio").alias("ratio"))
    return bars.join(ratios, ["symbol", "date"], "left").withColumn("split_ratio", F.coalesce("ratio", F.lit(1.0))).drop("ratio")


def scan_universe(raw: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    return conform(raw.select("date", normal_ticker("ticker", overrides).alias("symbol")).distinct(), UNIVERSE)


def scan_raw(spark: SparkSession, path: str, job: str, start=None, end=None) -> DataFrame:
    """A vendor's chain as it was delivered, with the ``date`` of its quotes, over a window."""
    return in_window(require(spark, path, job).withColumn("date", F.to_date("underlying_timestamp")), start, end)


def index_bars(levels: DataFrame) -> DataFrame:
    """Index levels in the schema of stocks, with no volume."""
    return conform(levels.withColumn("volume", F.lit(0)), STOCKS)


def spot_from_chain(chain: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """``date, symbol, close`` (and ``split_ratio``): the underlying of each symbol and day, from its first contract."""
    spot = chain.filter(F.col("underlying") > 0).groupBy("date", "symbol").agg(F.min_by("underlying", F.struct("expiration", "strike", "right")).alias("close"))
    if splits is None:
        return spot
    ratios = splits.groupBy("symbol", "date").agg(F.max("ratio").alias("split_ratio"))
    return spot.join(ratios, ["symbol", "date"], "left").withColumn("split_ratio", F.coalesce("split_ratio", F.lit(1.0)))


def spot_series(levels: DataFrame, closes: DataFrame, roots: dict[str, str]) -> DataFrame:
    """``root, date, spot``: an index's level for its option roots, else the stock's close."""
    names = F.create_map(*(F.lit(x) for pair in roots.items() for x in pair)) if roots else None
    stock = closes.select(F.col("symbol").alias("root"), "date", F.col("close").alias("spot"))
    if names is None:
        return stock
    index = levels.select("symbol", "date", F.col("close").alias("spot"))
    pairs = levels.sparkSession.createDataFrame(list(roots.items()), "root string, symbol string")
    return index.join(F.broadcast(pairs), "symbol").select("root", "date", "spot").unionByName(stock.join(F.broadcast(pairs), "root", "left_anti"))


def _files(spark: SparkSession, path: str):
    """The file system of ``path`` and the path as Hadoop has it; any store that Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _below(spark: SparkSession, path: str) -> list:
    """What lies directly in a folder; empty if there is none. Folders are datasets or years: few."""
    fs, target = _files(spark, path)
    return list(fs.listStatus(target)) if fs.exists(target) else []


def _years_below(spark: SparkSession, path: str) -> list[int]:
    names = [x.getPath().getName() for x in _below(spark, path) if x.isDirectory()]
    return sorted(int(n[5:]) for n in names if n.startswith("year=") and n[5:].isdigit())


def year_folders(spark: SparkSession, path: str) -> dict[int, str]:
    """The folder of each year of a table that lies by year, as its last commit has it."""
    folders = current(spark, path)
    out = {}
    for name, years in ({"": None} if folders is None else folders).items():
        base = f"{path}/{name}".rstrip("/")
        out |= {y: f"{base}/year={y}" for y in (_years_below(spark, base) if years is None else years)}
    return out


def available_years(spark: SparkSession, root: str, dataset: str) -> list[int]:
    """The years of a dataset that are on disk, from its folders ``year=...``; others are not years."""
    return sorted(year_folders(spark, f"{root}/{dataset}"))


def available_symbols(spark: SparkSession, root: str, dataset: str, year: int) -> list[str]:
    """The symbols that a year of a dataset has, from its folders ``symbol=...``."""
    folder = year_folders(spark, f"{root}/{dataset}").get(year)
    names = [x.getPath().getName() for x in _below(spark, folder) if x.isDirectory()] if folder else []
    return sorted(n[7:] for n in names if n.startswith("symbol="))


def load_chain(spark: SparkSession, root: str, dataset: str, start: Date | str | None = None, end: Date | str | None = None, symbols: list[str] | None = None, job: str = "chain") -> DataFrame:
    """A window of a dataset that lies by ``year`` and ``symbol``: only the folders of both are read.

    ``MissingDataset`` names the window and what there is if no year of the window, or none of the symbols, is on disk.
    """
    low, high = (Date.fromisoformat(x).year if isinstance(x, str) else x and x.year for x in (start, end))
    have = available_years(spark, root, dataset)
    years = [y for y in have if (low is None or y >= low) and (high is None or y <= high)]
    wanted = None if symbols is None else {s.upper() for s in symbols}
    if not years or (wanted is not None and not any(wanted & set(available_symbols(spark, root, dataset, y)) for y in years)):
        raise MissingDataset(f"{dataset} of {sorted(wanted) if wanted else 'any symbol'} over {start or 'start'} to {end or 'end'} (there: {have})", job)
    df = require(spark, f"{root}/{dataset}", job).filter(F.col("year").isin(years))
    if wanted is not None:
        df = df.filter(F.col("symbol").isin(sorted(wanted)))
    return in_window(df, start, end)


#: The small tables of the store: the folder, the job that builds it, and the key that orders it.
TABLES = {
    "earnings": ("earnings", ["symbol", "date"]),
    "corporate_actions": ("corporate-actions", ["symbol", "date"]),
    "sectors": ("sectors", ["symbol"]),
    "indices": ("reference", ["date", "symbol"]),
    "yields": ("reference", ["date", "tenor"]),
    "rates": ("reference", ["date", "symbol"]),
    "vol_reference_returns": ("vol-risk-model", ["date", "symbol"]),
    "vol_factor_returns": ("vol-risk-model", ["date", "factor"]),
    "vol_factor_loadings": ("vol-risk-model", ["date", "symbol", "factor"]),
    "vol_factor_covariances": ("vol-risk-model", ["date", "factor_1", "factor_2"]),
    "vol_idio_vol": ("vol-risk-model", ["date", "symbol"]),
    "symbology_check": ("symbology", ["year", "symbol"]),
    "universe": ("universe", ["date", "symbol"]),
}


def load(spark: SparkSession, root: str, name: str, start: Date | str | None = None, end: Date | str | None = None, ordered: bool = False, **equal) -> DataFrame:
    """A table of ``TABLES`` by name, its window if it has dates, and rows whose columns equal what is given (``tenor=...``).

    Rows have no order unless ``ordered``: then they are sorted by the table's key.
    """
    job, key = TABLES[name]
    df = require(spark, f"{root}/{name}", job)
    df = in_window(df, start, end) if "date" in df.columns else df
    for column, value in equal.items():
        df = df.filter(F.col(column).isin(value) if isinstance(value, list) else F.col(column) == value)
    return df.orderBy(*key) if ordered else df


def load_rates(spark: SparkSession, root: str, tenor: str, start=None, end=None) -> DataFrame:
    """``date, rate`` of one tenor of the yields."""
    return load(spark, root, "yields", start, end, tenor=tenor).select("date", "rate")


def load_splits(spark: SparkSession, root: str, start=None, end=None) -> DataFrame:
    """``symbol, date, ratio`` of the corporate actions that are splits."""
    return load(spark, root, "corporate_actions", start, end, action="split").select("symbol", "date", F.col("value").alias("ratio"))


def usable_symbol_years(verdicts: DataFrame, bad: tuple[str, ...] = ("wrong_instrument",)) -> DataFrame:
    """``symbol, year`` whose verdict is not one of ``bad``: a check that could not run is no failure."""
    return verdicts.filter(~F.col("status").isin(*bad)).select("symbol", "year").distinct()


def universe_symbols(universe: DataFrame, start=None, end=None, separator: str = "", exclude: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """``symbol``: distinct members of a window in the spelling of a destination, without those of ``exclude``; the first ``limit`` by name if given."""
    rows = in_window(universe, start, end).select(F.regexp_replace(F.upper("symbol"), r"\.", separator).alias("symbol")).distinct()
    if exclude is not None:
        rows = rows.join(exclude.select("symbol").distinct(), "symbol", "left_anti")
    return rows if limit is None else rows.orderBy("symbol").limit(limit)


def describe_store(spark: SparkSession, root: str) -> DataFrame:
    """``dataset, year, symbols, files, bytes`` of the tables below ``root``: a row for each, and for each year of one that lies by year.

    Files and sizes are hidden columns of a scan that reads no others, grouped by Spark; the driver lists datasets only. A file without rows is not counted.
    """
    out = None
    for entry in _below(spark, root):
        if not entry.isDirectory():
            continue
        name = entry.getPath().getName()
        path = F.col("_metadata.file_path")
        files = _united([part.select(path.alias("path"), F.col("_metadata.file_size").alias("size")) for part in _parts(spark, f"{root}/{name}")]).groupBy("path").agg(F.max("size").alias("size"))
        part = lambda key: F.nullif(F.regexp_extract("path", f"/{key}=([^/]+)/", 1), F.lit(""))
        rows = files.select("size", part("year").cast("int").alias("year"), part("symbol").alias("symbol"))
        rows = rows.groupBy("year").agg(F.when(F.col("year").isNotNull(), F.count_distinct("symbol")).cast("int").alias("symbols"), F.count("*").cast("int").alias("files"), F.sum("size").alias("bytes"))
        rows = rows.select(F.lit(name).alias("dataset"), "year", "symbols", "files", "bytes")
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], "dataset string, year int, symbols int, files int, bytes long") if out is None else out


def inventory(df: DataFrame) -> DataFrame:
    """``year, symbols, rows, first_date, last_date`` of a stored table."""
    return df.groupBy(F.year("date").alias("year")).agg(F.count_distinct("symbol").alias("symbols"), F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def covered_members(universe: DataFrame, chain: DataFrame) -> DataFrame:
    """Members whose symbol has chain rows in the year."""
    have = chain.select("symbol", F.year("date").alias("chain_year")).distinct()
    return universe.join(have, (universe["symbol"] == have["symbol"]) & (F.year(universe["date"]) == have["chain_year"]), "left_semi")


def write_table(df: DataFrame, path: str, partition: list[str] | None = None, sort: list[str] | None = None, retain: float = RETAIN) -> None:
    """Replaces the table at ``path`` as a whole: written as a folder of its own, which a commit then makes the current one.

    Readers see the table before or the new one, also those that read while it is replaced, as data of earlier commits stays for ``retain`` seconds.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    out = df.repartition(*partition) if partition else df
    out = out.sortWithinPartitions(*(partition or []), *sort) if sort else out
    fresh = f"v-{uuid.uuid4().hex}"
    (out.write.partitionBy(*partition) if partition else out.write).parquet(f"{path}/{fresh}")
    commit(spark, path, lambda _: {fresh: None})
    vacuum(spark, path, retain)


def replace_years(df: DataFrame, path: str, year: str = "year", retain: float = RETAIN) -> None:
    """Replaces the years that ``df`` holds and keeps the others, in one commit; a table without commits gets its first one.

    Two writers of different years don't undo each other: the later one's commit builds on the other's.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    fresh = f"v-{uuid.uuid4().hex}"
    df.withColumnRenamed(year, "year").repartition("year").write.partitionBy("year").parquet(f"{path}/{fresh}")
    years = _years_below(spark, f"{path}/{fresh}")

    def change(before: dict | None) -> dict:
        out = {}
        for name, own in ({"": None} if before is None else before).items():
            left = [y for y in (_years_below(spark, f"{path}/{name}".rstrip("/")) if own is None else own) if y not in years]
            if left:
                out[name] = left
        return out | {fresh: years}

    if years:
        commit(spark, path, change)
        vacuum(spark, path, retain)


def write_buckets(df: DataFrame, name: str, path: str, key: str = "symbol", order: str = "date", buckets: int | None = None) -> None:
    """A table of the catalog below ``path``, whose rows lie in files by the hash of ``key``, in order: work by ``key`` on it needs no shuffle.

    ``buckets``: about as many as tasks should share the work, by default the shuffle partitions.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one file a bucket: tasks write whole buckets
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key, order).option("path", path).mode("overwrite").saveAsTable(name)


def write_report(df: DataFrame, path: str, order: list[str], kind: str = "csv") -> None:
    """A small result table as one sorted file."""
    out = df.orderBy(*order).coalesce(1).write.mode("overwrite")
    out.option("header", True).csv(path) if kind == "csv" else out.parquet(path)
