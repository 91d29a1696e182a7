"""Character n-gram counts over small fixed alphabets, counted by Spark.

Every character is folded to one of ``size`` classes, so an n-gram is a number below ``size ** order``.
That is the proven bound on what a model can hold, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import pieces, texts

#: Groups whose dense counts a task holds at a time; more groups only make it send counts earlier.
GROUPS_AT_ONCE = 6


class Alphabet:
    """Folds code points to classes; class 0 stands before the first character of a text."""

    def __init__(self, classes: list[str], rest: Callable[[int], int], size: int):
        self.size = size
        self.table = np.zeros(0x110000, np.uint8)
        low = {c: i for i, group in enumerate(classes) for c in group}
        for point in range(1, 0x110000):
            if point >= 0x2C00:
                self.table[0x2C00:] = rest(0x2C00)
                break
            c = chr(point).lower()
            self.table[point] = low.get(c, None) if c in low else rest(point)

    def codes(self, own: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
        """Classes of all texts, each after ``pad`` zeros, and where each text with its zeros begins."""
        start = "\0" * pad
        joined = start + start.join(own) if own else ""
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) + pad for t in own], np.int64)
        return self.table[points], np.concatenate(([0], np.cumsum(sizes)))

    def grams(self, codes: np.ndarray, order: int) -> np.ndarray:
        """The n-gram that ends at each position (the first ``order - 1`` are 0)."""
        out = np.zeros(len(codes), np.int32)
        n = len(codes) - order + 1
        if n > 0:
            key = codes[:n].astype(np.int32)
            for k in range(1, order):
                key *= self.size
                key += codes[k : k + n]
            out[order - 1 :] = key
        return out


def prose() -> Alphabet:
    """48 classes: white space, a-z, digits, 14 accented letters, other letters, stop, comma, other punctuation, symbols."""
    classes = ["", " \t\n\r\x0b\x0c\x85\xa0", *"abcdefghijklmnopqrstuvwxyz", "0123456789", *"äöüßéèêàçñíóáú", "", ".", ",", "!?'\"-:;()¿¡«»"]
    return Alphabet(classes, lambda p: 43 if (chr(p).isalpha() or p >= 0x2C00) else 47, 48)


def urls() -> Alphabet:
    """39 classes: a-z, digits, the marks that URLs use, and one for everything else."""
    return Alphabet(["", *"abcdefghijklmnopqrstuvwxyz", "0123456789", *".-_/?=&#%:"], lambda p: 38, 39)


def count_grams(rows: DataFrame, alphabet: Alphabet, order: int) -> DataFrame:
    """``label, gram int, n long`` over all of ``rows (label string, text string)``.

    Each task adds up dense counts and sends a row for each n-gram it saw; Spark adds those up.
    """
    width = alphabet.size**order

    def of(batches):
        held: dict = {}

        def flush():
            for label, counts in held.items():
                seen = np.flatnonzero(counts)
                for at in range(0, len(seen), 1 << 16):
                    own = seen[at : at + (1 << 16)]
                    yield pa.record_batch([pa.array([label] * len(own), pa.string()), pa.array(own.astype(np.int32)), pa.array(counts[own].astype(np.int64))], ["label", "gram", "n"])
            held.clear()

        for batch in pieces(batches):
            labels, own = np.array(batch.column("label").to_pylist(), object), texts(batch.column("text"))
            for label in dict.fromkeys(labels.tolist()):
                if label not in held and len(held) >= GROUPS_AT_ONCE:
                    yield from flush()
                codes, _ = alphabet.codes([own[i] for i in np.flatnonzero(labels == label)] if label is not None else [t for t, x in zip(own, labels) if x is None], order - 1)
                grams = alphabet.grams(codes, order)[codes > 0]
                if label not in held:
                    held[label] = np.zeros(width, np.uint32)
                seen, n = (np.unique(grams, return_counts=True)) if len(grams) < width // 20 else (None, np.bincount(grams, minlength=width))
                if seen is None:
                    held[label] += n.astype(np.uint32)
                else:
                    held[label][seen] += n.astype(np.uint32)
        yield from flush()

    return rows.select("label", "text").mapInArrow(of, "label string, gram int, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))


def dense_counts(counts: DataFrame, alphabet: Alphabet, order: int) -> dict[str | None, np.ndarray]:
    """All counts on the driver, by label: at most ``size ** order`` numbers each."""
    table = counts.toArrow()
    labels = table["label"].combine_chunks().dictionary_encode(null_encoding="encode") if table.num_rows else None
    if labels is None:
        return {}
    codes, names = labels.indices.to_numpy(zero_copy_only=False), labels.dictionary.to_pylist()
    gram, n = table["gram"].to_numpy(), table["n"].to_numpy()
    out = {}
    for i, name in enumerate(names):
        out[name] = np.zeros(alphabet.size**order, np.int64)
        own = codes == i
        out[name][gram[own]] = n[own]
    return out
