"""Text quality by regularised quadratic discriminant analysis over document statistics.

Method: each text gives a vector of transformed statistics (logarithms of counts and shares). For each
class Spark sums the moments of all labelled training documents; the class covariances are shrunk
toward the pooled one and its diagonal. A score is the difference of the two Gaussian log densities,
each from a Mahalanobis distance by the cached Cholesky factor, made a probability with the class
shares as priors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import checkpointed, held_out, id_and_text, pieces, text_bytes
from .tokens import WORD, text_of_word, window_hashes, word_hashes, word_spans

FEATURES = ("words", "word_length", "symbols", "upper", "digits", "distinct", "adjacent", "bars", "marks", "shouts", "repeats", "lines")
#: Bytes of text that are measured at a time.
PIECE = 1 << 18
#: Shares of the pooled covariance and of its diagonal in a class covariance.
POOLED, DIAGONAL = 0.15, 0.05


def byte_class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER = byte_class(bytes(range(65, 91)))
DIGIT = byte_class(b"0123456789")
SYMBOL = byte_class(b"#*$%&|<>{}[]\\^~=_@")
MARK = byte_class(b".,;:?-'\"()")
SHOUT = byte_class(b"!")
LINE = byte_class(b"\n")


def statistics(column) -> np.ndarray:
    """One row of ``FEATURES`` for each text of an Arrow column. A null or empty text gives finite values too."""
    data, offsets = text_bytes(column)
    starts, ends, first = word_spans(data, offsets, WORD)
    n, of = len(offsets) - 1, text_of_word(first)
    words = np.diff(first).astype(float)
    size = np.diff(offsets).astype(float)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags[data])))[offsets]) / np.maximum(size, 1)

    hashes = word_hashes(data, starts, ends)
    # distinct words of each text: sorted by text, then by hash
    order = np.lexsort((hashes, of))
    new = np.ones(len(of), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][new], minlength=n)
    adjacent = np.zeros(n)
    if len(of) > 1:
        adjacent = np.bincount(of[1:][(hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])], minlength=n)
    single = (ends - starts == 1) & (data[starts] == 124) if len(starts) else np.zeros(0, bool)
    bars = np.bincount(of[single], minlength=n)
    repeats = np.zeros(n)
    if len(of) > 2:
        at = np.flatnonzero(of[:-2] == of[2:])
        key = np.sort(((window_hashes(hashes, 3)[at] >> np.uint64(24)) | (of[at].astype(np.uint64) << np.uint64(40))))
        again = key[1:][key[1:] == key[:-1]] >> np.uint64(40)
        repeats = np.bincount(again.astype(np.int64), minlength=n)
    many = np.maximum(words, 1)
    length = np.bincount(of, weights=ends - starts, minlength=n) / many
    out = [np.log1p(words), np.log(length + 1), share(SYMBOL), share(UPPER), share(DIGIT), distinct / many, adjacent / many, bars / many, share(MARK), share(SHOUT), repeats / many, share(LINE)]
    for i in (2, 3, 4, 6, 7, 8, 9, 10, 11):
        out[i] = np.log(out[i] + 0.005)
    # texts get more alike the longer they are: distinct words against what their length lets expect
    out[5] = np.log(out[5] + 0.01) + 0.1 * out[0]
    return np.stack(out, axis=1)


@dataclass
class Quadratic:
    """Means, inverse Cholesky factors and log weights of classes 0 and 1."""

    mean: np.ndarray
    factor: np.ndarray
    weight: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if not len(x):
            return np.zeros(0)
        density = [self.weight[k] - 0.5 * (((x - self.mean[k]) @ self.factor[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -30, 30)))


def from_moments(n: np.ndarray, first: np.ndarray, second: np.ndarray, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Quadratic:
    """The classifier from class counts, sums and sums of outer products. A class without rows gets the pooled moments."""
    total = max(n.sum(), 1.0)
    mean_all = first.sum(axis=0) / total
    mean = np.array([first[k] / n[k] if n[k] else mean_all for k in (0, 1)])
    spread = [second[k] / n[k] - np.outer(mean[k], mean[k]) if n[k] else None for k in (0, 1)]
    shared = sum(n[k] * spread[k] for k in (0, 1) if n[k]) / total if total and n.any() else np.eye(first.shape[1])
    shared = shared + 1e-4 * np.eye(len(shared))
    factor, weight = [], []
    for k in (0, 1):
        own = shared if spread[k] is None else spread[k]
        own = (1 - pooled - diagonal) * own + pooled * shared + diagonal * np.diag(np.diag(shared))
        low = np.linalg.cholesky(own)
        factor.append(np.linalg.inv(low))
        weight.append(np.log((n[k] + 1) / (n.sum() + 2)) - np.log(np.diag(low)).sum())
    return Quadratic(mean, np.array(factor), np.array(weight))


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, x array<double>``: the statistics of each text of ``doc_id, text``."""

    def of(batches):
        for batch in pieces(batches, PIECE):
            x = statistics(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, x array<double>")


def labelled(labels: DataFrame, column: str, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, y`` of the training rows: ids that are not held out, with one label 0 or 1 and no contradiction."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    return rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").select("doc_id", "y")


def fit(features: DataFrame, labels: DataFrame, column: str = "quality") -> Quadratic:
    """Moments of all training rows, summed by Spark; a few hundred numbers come to the driver."""
    k = len(FEATURES)
    rows = features.join(labelled(labels, column), "doc_id").select("y", "x")

    def of(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column("y").to_numpy(zero_copy_only=False)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            x = np.concatenate((np.ones((len(x), 1)), x), axis=1)
            for label in (0, 1):
                own = x[y == label]
                m = own.T @ own
                i, j = np.indices(m.shape)
                yield pa.record_batch([pa.array(np.full(m.size, label, np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(m.ravel())], ["y", "i", "j", "v"])

    sums = rows.mapInArrow(of, "y int, i int, j int, v double").groupBy("y", "i", "j").agg(F.sum("v").alias("v")).collect()
    m = np.zeros((2, k + 1, k + 1))
    for r in sums:
        m[r.y, r.i, r.j] = r.v
    return from_moments(m[:, 0, 0], m[:, 0, 1:], m[:, 1:, 1:])


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, column: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row for each row of ``docs``.

    Only labels of rows that are not held out are learned from; a score depends on the text alone. A null
    text is empty and gets a score too. Without training rows every score is 0.5. Repeated rows get
    equal scores; contradicting labels of an id are left out. Texts of any length are measured whole.
    Other columns are ignored. An empty table gives an empty result.
    """
    features = checkpointed(measured(id_and_text(docs, id_col, text_col)))
    model = fit(features, labels, column)

    def of(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.record_batch([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    scored = features.mapInArrow(of, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, column: str = "quality") -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``.

    Statistics are measured first and only they are joined with the labels; texts are not shuffled. A null text is
    empty and is judged as such; repeated rows stay or go together; an id plays no part, so it may be null.
    Texts of any length are measured whole. Without training rows every score is 0.5, so all stay at the
    usual threshold. Columns may have any names. An empty table gives an empty result. See ``score_quality``.
    """
    model = fit(measured(id_and_text(docs)), labels, column)

    def of(batches):
        for batch in pieces(batches, PIECE):
            yield batch.filter(pa.array(model.score(statistics(batch.column("text"))) >= threshold))

    return docs.mapInArrow(of, docs.schema)
