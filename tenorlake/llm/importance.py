"""Importance resampling of documents towards a target text, with exact weights from bit-sliced counts.

Method: bit-sliced aggregation. A feature (a run of words) falls into one of ``BUCKETS`` hash buckets, and a bucket's gain
is an integer: a thousand times the log ratio of its share in the target and in the documents. A document's bucket counts become
planes of as many bits as there are buckets, plane j holding bit j of each count; the gains become planes too, one set for
positive and one for negative ones. A plane of counts AND a plane of gains, its bits counted and multiplied by a power of two, adds
to the weight; the sum over all pairs of planes is exact. Documents are then drawn without replacement by adding Gumbel noise to the
weights, which depends on the id only, and taking the highest.

Bucket counts of the corpus are summed in each task and added up by Spark; only they, and how many rows each partition of
the sorted scores has, reach the driver.
"""

from __future__ import annotations

import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import checkpointed, id_and_text, pieces, shuffle_partitions, texts

BUCKETS = 10_000
#: In UTF-8 with A-Z in lower case: letters, digits and all that is not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Documents whose planes are built at a time.
STEP = 64


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


def feature_buckets(words: list[bytes], longest: int, buckets: int) -> np.ndarray:
    """The bucket of each run of 1 to ``longest`` words, repeats included."""
    features = words
    for n in range(2, longest + 1):
        features = features + [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return np.fromiter(map(crc32, features), np.uint32, len(features)) % np.uint32(buckets)


def bucket_counts(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``bucket, features`` over all texts; buckets without any are missing."""

    def of(batches):
        total = np.zeros(buckets, np.int64)
        for batch in pieces(batches):
            for t in texts(batch.column("text")):
                total += np.bincount(feature_buckets(words_of(t), longest, buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "features"])

    return docs.select("text").mapInArrow(of, "bucket int, features long").groupBy("bucket").agg(F.sum("features").alias("features"))


def bucket_gains(docs: DataFrame, target: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) for each bucket."""
    both = bucket_counts(docs, longest, buckets).withColumn("side", F.lit(0)).unionByName(bucket_counts(target, longest, buckets).withColumn("side", F.lit(1)))
    count = [[0] * buckets, [0] * buckets]
    for r in both.collect():
        count[r["side"]][r["bucket"]] = r["features"]
    own, wanted = (sum(c) + buckets for c in count)
    return np.array([math.floor(1000 * math.log((t + 1) * own / ((s + 1) * wanted))) for s, t in zip(*count)], np.int64)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans, a multiple of 64 wide, as rows of 64-bit words."""
    return np.packbits(bits, axis=-1).view(np.uint64)


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of numbers of at least 0, the lowest first."""
    return np.array([packed((values >> j & 1).astype(bool)) for j in range(max(1, int(values.max(initial=0)).bit_length()))])


class Weights:
    """The gains in planes."""

    def __init__(self, gains: np.ndarray):
        self.width = -(-len(gains) // 64) * 64
        wide = np.zeros(self.width, np.int64)
        wide[: len(gains)] = gains
        self.signed = [(sign, planes(np.maximum(sign * wide, 0))) for sign in (1, -1)]

    def of(self, counts: np.ndarray) -> np.ndarray:
        """The weight of each row of ``counts (documents x width)``."""
        out = np.zeros(len(counts), np.int64)
        for j, plane in enumerate(planes(counts)):
            for sign, gains in self.signed:
                for k, gain in enumerate(gains):
                    out += sign * (np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64) << (j + k))
        return out


def importance_weights(source: DataFrame, gains: np.ndarray, longest: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each row of ``doc_id, text``."""
    buckets, gains = len(gains), gains.tolist()

    def of(batches):
        weights = Weights(np.array(gains, np.int64))
        for batch in pieces(batches):
            own, n_words = [], []
            for t in texts(batch.column("text")):
                words = words_of(t)
                n_words.append(len(words))
                own.append(feature_buckets(words, longest, buckets))
            weight = np.zeros(len(own), np.int64)
            # documents of a size together, so that few planes of a batch are empty
            order = np.argsort([len(x) for x in own], kind="stable")
            for at in range(0, len(order), STEP):
                some = order[at : at + STEP]
                counts = np.zeros((len(some), weights.width), np.int32)
                for row, i in zip(counts, some):
                    row[:] = np.bincount(own[i], minlength=weights.width)
                weight[some] = weights.of(counts)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return source.mapInArrow(of, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int, id_col: str) -> Column:
    """A thousand times standard Gumbel noise, rounded down, that depends on the id and the seed."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, ... by ``order`` over the whole table: ranges are sorted apart, and know how many come before."""
    parts = shuffle_partitions(rows.sparkSession)
    # the upper bits tell the partition, the lower 33 the place in it
    placed = checkpointed(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    before, offsets = 0, []
    for r in sorted(placed.groupBy(F.shiftright("at", 33).alias("part")).count().collect()):
        offsets.append((r["part"], before))
        before += r["count"]
    offset = F.create_map(*(F.lit(x) for pair in offsets for x in pair))[F.shiftright("at", 33)] if offsets else F.lit(0)
    return placed.withColumn("rank", F.col("at").bitwiseAND((1 << 33) - 1) + offset + 1).drop("at")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, longest: int = 1, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``docs``; ``rank`` is null where it was not drawn.

    Of the documents with at least ``least_words`` words ``percent`` of 100 are drawn, rounded down: those with the highest scores,
    ties to the smaller id. A null text has no words and weight 0. The noise of a row without an id is that of an empty id, and it comes
    last among ties; rows that repeat an id have equal noise and are ranked each, in the order of features and weight on ties. Texts of any length are counted
    whole; other columns are ignored. Without target texts, or with an empty table of them, the gains tell how rare a bucket is. An empty table gives
    an empty result.
    """
    source = id_and_text(docs, id_col, text_col)
    gains = bucket_gains(source, target.select(F.col("text").cast("string").alias("text")), longest, buckets)
    scored = checkpointed(importance_weights(source, gains, longest).withColumn("score", F.col("weight") + gumbel(seed, "doc_id")))
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    in_order = ranked(able.select(*columns), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"))
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    rest = scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return in_order.select(*columns, rank.alias("rank")).unionByName(rest)
