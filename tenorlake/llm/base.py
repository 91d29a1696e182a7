"""Helpers that the text operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Stands for a missing document id inside the operators: it sorts after every real id.
NO_ID = (1 << 63) - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share, set as the checkpoint folder.

    A folder of its own is made only for a local master that names none.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a checkpoint in the folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def clean(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files and checkpoints of tables that nothing refers to any more, between rounds of a long job.

    It does so when the driver happens to collect its garbage, which a driver with little to do puts off.
    """
    gc.collect()
    spark._jvm.System.gc()


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet below the shared folder, under a name of its own, and read again; and where it lies."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def erase(spark: SparkSession, path: str) -> None:
    """Removes what ``store`` wrote, once nothing reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that matter, so that other columns' names can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def texts(column) -> list[str]:
    """Python strings of an Arrow column; null is the empty text."""
    return [t or "" for t in column.to_pylist()]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the offsets where each begins and ends. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def ids(column) -> np.ndarray:
    """Document ids, with ``NO_ID`` for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def release() -> None:
    """Gives memory that a task has freed back to the system: Python workers stay alive for other stages, and should be small then."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def pieces(batches, limit: int = 1 << 19, text: str = "text"):
    """Record batches cut so that each holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    release()


#: Rows of a few numbers that may be broadcast: some 20 MB in an executor.
SMALL_ROWS = 1 << 19


def small(rows: DataFrame) -> DataFrame:
    """``rows`` (a checkpointed table of few numbers a row) with a broadcast hint if they are counted to be few; else as it is."""
    return F.broadcast(rows) if rows.count() <= SMALL_ROWS else rows


#: Bytes of text in a block, about: texts that one task holds at a time.
BLOCK_BYTES = 8 << 20


def blocks_for(docs: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of about ``block_bytes`` of text, so that they get more and not larger as the table grows.

    Smaller ones, down to half of that, if they are fewer than the shuffle partitions.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(1, -(-size // block_bytes), min(shuffle_partitions(docs.sparkSession), 2 * size // block_bytes))


def packed_blocks(source: DataFrame) -> DataFrame:
    """``block int, rows binary`` of ``source (block int, text, ...)``: the rows of a block, compressed, many in one.

    A block's rows may be in several of the result's, in any order.
    """
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in source.schema.fields if f.name != "block"])

    def flushed(held: dict):
        rows = []
        for own in held.values():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
                out.write_table(pa.Table.from_batches(own, schema).combine_chunks())
            rows.append(sink.getvalue().to_pybytes())
        return pa.record_batch([pa.array(list(held), pa.int32()), pa.array(rows, pa.binary())], ["block", "rows"])

    def of(batches):
        held, size = {}, 0
        for batch in pieces(batches):
            block = batch.column("block").to_numpy(zero_copy_only=False)
            order = np.argsort(block, kind="stable")
            own = pa.record_batch([batch.column(c).take(pa.array(order)).cast(schema.field(c).type) for c in schema.names], schema=schema)
            cuts = np.flatnonzero(np.diff(block[order], prepend=-1))
            for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(block)).tolist()):
                held.setdefault(int(block[order[a]]), []).append(own.slice(a, b - a))
            size += own.nbytes
            if size >= 2 * BLOCK_BYTES:
                yield flushed(held)
                held, size = {}, 0
        if held:
            yield flushed(held)

    return source.mapInArrow(of, "block int, rows binary")


def unpacked(table: pa.Table) -> pa.Table:
    """The rows of a block from ``packed_blocks``."""
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table["rows"]])


def held_out(id_col: str = "doc_id"):
    """True for the rows that no model may learn from: crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
