"""Perplexity under a modified Kneser-Ney character model of each language, and bands that reject.

Method: Spark counts the 5-grams of characters (code points as they are, so scripts, case and marks are
told apart) of every whole text by language, and DataFrame joins make a modified Kneser-Ney model of
them: three discounts an order, continuation counts below the highest order. Documents are dealt to two
folds by their text, and each is scored by the model of the other fold, so that a strange text can't
vouch for itself. The model grows with the corpus and is never gathered: it is dealt to buckets, where it
lies in arrays sorted by the hash of an n-gram; blocks of documents send the distinct n-grams that they
hold and get their log probabilities back. The bands are fences around each language's median,
narrower the longer a text is: the mean over n characters strays with 1 / sqrt(n).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import blocks_for, checkpointed, erase, packed_blocks, pieces, small, store, text_bytes, texts, unpacked
from .tokens import WORD, mixed, text_of_word, window_hashes, word_hashes, word_spans

ORDER = 5
#: Half the width of a band, in deviations (as the median absolute one tells them) of a text of its length.
FENCE = 5.0
#: Least deviation, in bits times the root of the characters, that a language is taken to have.
LEAST_SPREAD = 1.0
#: Bins of a bit, and of a doubling of the deviation, in the histograms that medians are read from.
BINS, SPREAD_BINS = 1024, 64
#: The symbols that the base counts.
SYMBOLS = b"#*$%&|<>"
#: Distinct n-grams that are held before their counts are added up, characters that a task counts at a time, and bytes of a block.
HELD, COUNT_CHARS, BLOCK = 1 << 21, 32 << 20, 16 << 20


def points_of(own: list[str], pad: int = ORDER - 1) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after ``pad`` zeros, and where each text with its zeros begins. NUL is read as U+FFFD."""
    joined = "".join("\0" * pad + t.replace("\0", "\ufffd") for t in own)
    sizes = np.array([len(t) + pad for t in own], np.int64)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate(([0], np.cumsum(sizes)))


class Grams:
    """Numbers for the n-grams over an alphabet, in the order of their characters."""

    def __init__(self, alphabet: np.ndarray, order: int = ORDER):
        self.alphabet, self.order = alphabet, order
        #: numbers fit into 63 bits; else n-grams are compared as strings
        self.fits = len(alphabet) ** order < 1 << 62

    def keys(self, points: np.ndarray) -> np.ndarray:
        """The n-gram that ends at each position from ``order - 1`` on."""
        n = max(0, len(points) - self.order + 1)
        if not self.fits:
            return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(points, self.order)).view(f"<U{self.order}").ravel() if n else np.zeros(0, f"<U{self.order}")
        codes = np.searchsorted(self.alphabet, points).astype(np.int64)
        out = codes[:n].copy()
        for k in range(1, self.order):
            out *= len(self.alphabet)
            out += codes[k : k + n]
        return out

    def points(self, keys: np.ndarray) -> np.ndarray:
        """The characters of n-grams, a row each."""
        if not self.fits:
            return keys.view(np.uint32).reshape(-1, self.order)
        out = np.empty((len(keys), self.order), np.uint32)
        left = keys.copy()
        for k in range(self.order - 1, -1, -1):
            left, code = np.divmod(left, len(self.alphabet))
            out[:, k] = self.alphabet[code]
        return out


def added_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts (rows of one or more)."""
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    every = np.concatenate(counts, axis=1)
    return key, np.stack([np.bincount(where, weights=c, minlength=len(key)) for c in every]).astype(np.int64)


def hashed(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of characters."""
    total = np.zeros(len(points), np.uint64)
    for k in range(points.shape[1]):
        total = total * np.uint64(0xD6E8FEB86659FD93) + mixed(points[:, k].astype(np.uint64))
    return mixed(total)


def strings(points: np.ndarray) -> pa.Array:
    """N-grams as strings. The last character is never NUL, so none is cut."""
    return pa.array(np.ascontiguousarray(points).view(f"<U{points.shape[1]}").ravel().tolist(), pa.string())


def counted(parts: list[np.ndarray]) -> tuple[Grams, np.ndarray, np.ndarray]:
    """The numbering, the distinct n-grams and their counts in ``parts``: code points of texts with their zeros, a few texts in each."""
    grams = Grams(np.unique(np.concatenate([np.unique(p) for p in parts])))
    keys, counts, size = [], [], 0
    for p in parts:
        key, n = np.unique(grams.keys(p)[p[ORDER - 1 :] > 0], return_counts=True)
        keys.append(key)
        counts.append(n[None, :])
        size += len(key)
        if size > HELD:
            key, n = added_up(keys, counts)
            keys, counts, size = [key], [n], 0
    key, n = added_up(keys, counts)
    return grams, key, n[0]


class Held:
    """The distinct n-grams of one language in some texts, and the buckets that they are dealt to."""

    def __init__(self, parts: list[np.ndarray], buckets: int):
        self.grams, self.keys, self.counts = counted(parts)
        self.points = self.grams.points(self.keys)
        # by context, so that what Spark sums over a context lies together
        bucket = hashed(self.points[:, :-1]) % np.uint64(buckets)
        self.by = np.argsort(bucket, kind="stable")
        self.cuts = np.searchsorted(bucket[self.by], np.arange(buckets + 1))

    def dealt(self):
        """Each bucket that has some, and which."""
        for b in np.flatnonzero(np.diff(self.cuts)).tolist():
            yield b, self.by[self.cuts[b] : self.cuts[b + 1]]


def languages(table: pa.Table):
    """Of a block: each language with its rows' places and code points, in parts of a few texts."""
    label = np.array(table["label"].to_pylist(), object)
    for name in sorted(set(label)):
        rows = np.flatnonzero(label == name)
        parts, at = [], 0
        for batch in pieces(table.take(pa.array(rows)).combine_chunks().to_batches()):
            own = texts(batch.column("text"))
            parts.append((rows[at : at + len(own)], *points_of(own)))
            at += len(own)
        yield name, parts


SEEN = pa.schema([("bucket", pa.int32()), ("label", pa.string()), ("fold", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
ASKED = pa.schema([("bucket", pa.int32()), ("label", pa.string()), ("block", pa.int32()), ("grams", pa.binary())])


def count(buckets: int):
    """Distinct n-grams and their counts of all texts of a task, some ``COUNT_BYTES`` at a time, a row for each language, fold and bucket."""

    def flushed(held: dict):
        pack = zstandard.ZstdCompressor().compress
        for (name, fold), parts in held.items():
            own = Held(parts, buckets)
            rows = [(b, name, fold, pack(own.points[x].T.tobytes()), pack(own.counts[x].astype(np.uint32).tobytes())) for b, x in own.dealt()]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), SEEN.types)], schema=SEEN)

    def of(batches):
        held, size = {}, 0
        for batch in pieces(batches):
            labels, folds, own = batch.column("label").to_pylist(), batch.column("fold").to_pylist(), texts(batch.column("text"))
            groups: dict = {}
            for name, fold, text in zip(labels, folds, own):
                groups.setdefault((name, fold), []).append(text)
            for key, group in groups.items():
                held.setdefault(key, []).append(points_of(group)[0])
            size += sum(map(len, own))
            if size > COUNT_CHARS:
                yield from flushed(held)
                held, size = {}, 0
        yield from flushed(held)

    return of


def ask(buckets: int):
    """For a block: its distinct n-grams, a row for each language and bucket."""

    def of(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        pack = zstandard.ZstdCompressor().compress
        rows = []
        for name, parts in languages(unpacked(table)):
            held = Held([p[1] for p in parts], buckets)
            rows += [(b, name, block, pack(held.points[x].T.tobytes())) for b, x in held.dealt()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, ASKED.types)], schema=ASKED)

    return of


def read_grams(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(packed), np.uint32).reshape(ORDER, -1).T)


def add_up(table: pa.Table) -> pa.Table:
    """For a bucket and a language: each n-gram with its counts in the two folds."""
    seen = [read_grams(x) for x in table["grams"].to_pylist()]
    grams = Grams(np.unique(np.concatenate([np.unique(a) for a in seen])))
    keys, counts, size = [], [], 0
    for points, packed, fold in zip(seen, table["counts"].to_pylist(), table["fold"].to_pylist()):
        n = np.zeros((2, len(points)), np.int64)
        n[fold] = np.frombuffer(zstandard.decompress(packed), np.uint32)
        keys.append(grams.keys(points.ravel())[::ORDER])
        counts.append(n)
        size += len(points)
        if size > HELD:
            key, n = added_up(keys, counts)
            keys, counts, size = [key], [n], 0
    key, n = added_up(keys, counts)
    label = pa.array([table["label"][0].as_py()] * len(key), pa.string())
    return pa.table([label, strings(grams.points(key)), pa.array(np.full(len(key), table["bucket"][0].as_py(), np.int32)), pa.array(n[0]), pa.array(n[1])], ["label", "gram", "bucket", "n0", "n1"])


def discounts() -> list[Column]:
    """Aggregates ``d0`` and ``d1`` over the n-grams of one language and order: the discounts of counts 1, 2, 3 and more."""
    out = []
    for f in ("0", "1"):
        n = [F.sum((F.col("n" + f) == i).cast("long")) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        known = (n[0] > 0) & (n[1] > 0)
        own = [F.when(known & (n[k - 1] > 0), F.least(F.greatest(k - (k + 1) * y * n[k] / n[k - 1], F.lit(0.05)), F.lit(float(k)))).otherwise(0.5) for k in (1, 2, 3)]
        out.append(F.array(*own).alias("d" + f))
    return out


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``label, gram, bucket, p0, p1``: the probability of each n-gram's last character after the others, in both folds' models.

    ``counts (label string, gram string, bucket int, n0 long, n1 long)`` has each n-gram that either fold saw, so every
    probability that a document of the other fold can ask for is there, backed off where the fold lacks it.
    """
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        suffix = levels[k + 1].groupBy("label", F.substring("gram", 2, k).alias("gram"))
        levels[k] = checkpointed(suffix.agg(*(F.sum((F.col(n) > 0).cast("long")).alias(n) for n in ("n0", "n1"))))
    lower = None
    for k in range(1, order + 1):
        level = levels[k].withColumn("context", F.substring("gram", 1, k - 1))
        seen = [F.sum((F.col(f"n{f}") == i).cast("long") if i < 3 else (F.col(f"n{f}") >= 3).cast("long")).alias(f"k{f}_{i}") for f in (0, 1) for i in (1, 2, 3)]
        contexts = level.groupBy("label", "context").agg(*(F.sum(f"n{f}").alias(f"total{f}") for f in (0, 1)), *seen)
        spread = small(checkpointed(level.groupBy("label").agg(*discounts(), F.count("*").alias("kinds"))))
        rows = level.join(contexts, ["label", "context"]).join(spread, "label")
        # of each fold: the share that the n-gram's own count gives, and the weight of the lower order
        shares = []
        for f in (0, 1):
            n, d, total = F.col(f"n{f}"), F.col(f"d{f}"), F.col(f"total{f}")
            own = F.when(n > 0, n - F.element_at(d, F.least(n, F.lit(3)).cast("int"))).otherwise(0.0)
            given = sum(d[i - 1] * F.col(f"k{f}_{i}") for i in (1, 2, 3))
            shares += [F.when(total > 0, own / total).otherwise(0.0).cast("float").alias(f"own{f}"), F.when(total > 0, given / total).otherwise(1.0).cast("float").alias(f"rest{f}")]
        kept = ["label", "gram", *(["bucket"] if k == order else [])]
        rows = rows.select(*kept, *shares, "kinds")
        if lower is None:
            rows = rows.withColumns({f"low{f}": 1 / (F.col("kinds") + 1) for f in (0, 1)})
        else:
            below = lower.select("label", F.col("gram").alias("suffix"), F.col("p0").alias("low0"), F.col("p1").alias("low1"))
            rows = rows.drop("kinds").withColumn("suffix", F.substring("gram", 2, k - 1)).join(below, ["label", "suffix"])
        p = [(F.col(f"own{f}") + F.col(f"rest{f}") * F.col(f"low{f}")).cast("float").alias(f"p{f}") for f in (0, 1)]
        lower = rows.select(*kept, *p)
    return lower


REPLY = "block int, label string, bucket int, bits binary"


def answer(key, asked: pa.Table, model: pa.Table) -> pa.Table:
    """For a bucket and a language: the log2 probabilities that each block asked for, from the other fold's model."""
    points = np.array(model["gram"].to_pylist(), f"<U{ORDER}").view(np.uint32).reshape(-1, ORDER)
    keys = hashed(points)
    by = np.argsort(keys)
    keys = keys[by]
    bits = [np.log2(model[p].to_numpy()[by].astype(np.float64)).astype(np.float32) for p in ("p0", "p1")]
    out = []
    for block, packed in zip(asked["block"].to_pylist(), asked["grams"].to_pylist()):
        h = hashed(read_grams(packed))
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        if (keys[at] != h).any():
            raise RuntimeError("the model lacks an n-gram that a block holds")
        out.append(bits[1 - block % 2][at].tobytes())
    n = len(out)
    return pa.table([asked["block"].combine_chunks(), asked["label"].combine_chunks(), pa.array([key[0].as_py()] * n, pa.int32()), pa.array(out, pa.binary())], ["block", "label", "bucket", "bits"])


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def score(buckets: int):
    """For a block and the answers to it: base counts, characters and bits a character of each document."""

    def of(key, table: pa.Table, replies: pa.Table) -> pa.Table:
        table = unpacked(table)
        bits, chars = np.full(table.num_rows, np.nan), np.zeros(table.num_rows, np.int64)
        said = {(name, b): x for name, b, x in zip(replies["label"].to_pylist(), replies["bucket"].to_pylist(), replies["bits"].to_pylist())}
        for name, parts in languages(table):
            held = Held([p[1] for p in parts], buckets)
            value = np.full(len(held.keys), np.nan)
            for b, own in held.dealt():
                value[own] = np.frombuffer(said[name, b], np.float32)
            for rows, points, at in parts:
                real = points > 0
                own = np.zeros(len(points))
                if len(value):
                    # where there is no character, any place will do
                    own[ORDER - 1 :] = value[np.minimum(np.searchsorted(held.keys, held.grams.keys(points)), len(value) - 1)]
                chars[rows] = np.add.reduceat(real.astype(np.int64), at[:-1])
                bits[rows] = -np.add.reduceat(np.where(real, own, 0), at[:-1]) / np.maximum(chars[rows], 1)
        bits[chars == 0] = np.nan
        counts = [base_counts(batch.column("text")) for batch in pieces(table.combine_chunks().to_batches())]
        base = [np.concatenate([c[k] for c in counts]) if counts else np.zeros(0, np.int64) for k in BASE]
        return pa.table([table["doc_id"].combine_chunks(), table["label"].combine_chunks(), *(pa.array(b) for b in base), pa.array(chars), pa.array(bits, from_pandas=True)], ["doc_id", "label", *BASE, "chars", "bits"])

    return of


def base_counts(column) -> dict[str, np.ndarray]:
    """Counts of each text: words, their characters, symbols, repeated lines, words in repeated windows of three."""
    data, offsets = text_bytes(column)
    starts, ends, first = word_spans(data, offsets, WORD)
    of, n = text_of_word(first), len(offsets) - 1

    def within(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])

    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out = {"n_words": np.diff(first), "word_chars": within(WORD[data] & ((data & 0xC0) != 0x80)), "n_symbols": within(symbol[data])}
    newline = np.zeros(256, bool)
    newline[10] = True
    line_starts, line_ends, line_first = word_spans(data, offsets, ~newline)
    line_words = np.searchsorted(starts, line_ends) - np.searchsorted(starts, line_starts)
    own = np.flatnonzero(line_words > 0)
    key = word_hashes(data, line_starts[own], line_ends[own], 1) ^ mixed(text_of_word(line_first)[own].astype(np.uint64))
    _, where = np.unique(key, return_index=True)
    again = np.ones(len(own), bool)
    again[where] = False
    out["n_dup_lines"] = np.bincount(text_of_word(line_first)[own[again]], minlength=n)
    windows = np.flatnonzero(of[: max(0, len(of) - 2)] == of[2:])
    key = window_hashes(word_hashes(data, starts, ends), 3)[windows] ^ mixed(of[windows].astype(np.uint64))
    order = np.argsort(key)
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    repeated = windows[order[same[1:] | same[:-1]]]
    covered = np.zeros(len(of), bool)
    for k in range(3):
        covered[repeated + k] = True
    out["n_repeat_words"] = np.bincount(of[covered], minlength=n)
    return {k: v.astype(np.int64) for k, v in out.items()}


def medians(rows: DataFrame, bin: Column, value, name: str) -> DataFrame:
    """``label, name``: the median of each language, exact to a bin. ``value`` makes one of a bin's middle."""
    bins = rows.groupBy("label", F.floor(bin).alias("bin")).count()
    middle = bins.groupBy("label").agg(F.percentile("bin", F.lit(0.5), F.col("count")).alias("bin"))
    return small(checkpointed(middle.select("label", value(F.col("bin") + 0.5).alias(name))))


def perplexity_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, bits, low, high, kept``.

    One row for each row of ``docs``. ``bits`` is the log2 perplexity a character under the model of the
    document's language, counted over all documents of that language in the other fold (a null language
    is one of its own), and ``low``/``high`` are its band; a text without characters has null bits and no
    verdict from the band. A language whose other fold is empty has one value for all texts and rejects
    none. A null text is empty: no words, so the base fails. Repeated rows are counted as often as they
    come, and get equal results. A text of any length is one row of one block, which one task holds whole.
    Other columns are ignored. An empty table gives an empty result.
    """
    blocks = buckets = -(-blocks_for(docs, text_col, BLOCK) // 2)
    label = F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), label.alias("label"))
    # equal texts are in one fold
    fold = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")
    seen = source.select("text", "label", fold.alias("fold")).mapInArrow(count(buckets), "bucket int, label string, fold int, grams binary, counts binary")
    counts, where = store(seen.groupBy("bucket", "label").applyInArrow(add_up, "label string, gram string, bucket int, n0 long, n1 long"), "grams")
    model = kneser_ney(counts)
    # blocks of fold 0 are even, those of fold 1 odd
    block = 2 * F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)) + fold
    by_block = packed_blocks(source.select(block.cast("int").alias("block"), "doc_id", "text", "label")).groupBy("block")
    asked = by_block.applyInArrow(ask(buckets), "bucket int, label string, block int, grams binary")
    replies = asked.groupBy("bucket", "label").cogroup(model.groupBy("bucket", "label")).applyInArrow(answer, REPLY)
    kinds = "doc_id long, label string, " + ", ".join(f"{c} long" for c in BASE) + ", chars long, bits double"
    scored, _ = store(by_block.cogroup(replies.groupBy("block")).applyInArrow(score(buckets), kinds), "scored")
    erase(docs.sparkSession, where)

    known = scored.where("bits is not null")
    middle = medians(known, F.col("bits") * BINS, lambda b: b / BINS, "middle")
    away = (F.abs(F.col("bits") - F.col("middle")) * F.sqrt("chars")).alias("away")
    far = known.join(middle, "label").select("label", away)
    # 1.4826 times the median absolute deviation is the standard one of normal values
    spread = medians(far, F.log2(F.col("away") + 1e-6) * SPREAD_BINS, lambda b: F.greatest(1.4826 * F.pow(F.lit(2.0), b / SPREAD_BINS), F.lit(LEAST_SPREAD)), "spread")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    wide = FENCE * F.col("spread") / F.sqrt(F.greatest("chars", F.lit(1)))
    out = scored.join(middle, "label", "left").join(spread, "label", "left")
    out = out.select("doc_id", *BASE, failed.alias("base_failed"), "bits", (F.col("middle") - wide).alias("low"), (F.col("middle") + wide).alias("high"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(True)))
