"""Documents that hold a benchmark item, also with its passages in another order.

Method: greedy string tiling. Seeds are runs of five tokens (letters and digits, A-Z in lower case).
A Bloom filter of fixed size over the benchmark's seeds says which positions of a document may be
seeds; those are joined with the benchmark's seeds by hash. A pair of document and item with enough
common seeds is tiled: the longest match that touches no marked token is marked, again and again,
until none of the least length is left, matches being runs of equal seeds (running Karp-Rabin). The
document is contaminated if the tiles cover enough of the item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import checkpointed, id_and_text, pieces, small, text_bytes
from .tokens import ALNUM, ALNUM_LOWER, BASES, modulo, powers, text_of_word, window_hashes, word_hashes, word_spans

#: Tokens in a seed, and so in the shortest tile.
SEED = 5
#: Share of an item's tokens that tiles must cover.
COVERAGE = 0.5
#: log2 of the bits of the Bloom filter: its size, 4 MB, is the same for any benchmark.
BLOOM_BITS = 25


def seeds_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: hash, text and position of each seed; and each text's number of tokens.

    A text of fewer than ``SEED`` tokens has none.
    """
    data, offsets = text_bytes(column)
    data = ALNUM_LOWER[data]
    starts, ends, first = word_spans(data, offsets, ALNUM)
    of = text_of_word(first)
    n = max(0, len(of) - SEED + 1)
    at = np.flatnonzero(of[:n] == of[SEED - 1 :][:n])
    hashes = window_hashes(word_hashes(data, starts, ends), SEED)[at]
    return hashes, of[at], at - first[of[at]], np.diff(first)


def benchmark_seeds(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, n_tokens, seeds array<long>`` for each item with a seed; items with one id are told apart by their text."""

    def of(batches):
        for batch in pieces(batches):
            hashes, text, _, n = seeds_of(batch.column("text"))
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1))
            own = [hashes[a:b].view(np.int64) for a, b in zip(cuts, cuts[1:])]
            yield pa.record_batch([batch.column("item_id"), batch.column("item"), pa.array(n, pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["item_id", "item", "n_tokens", "seeds"])

    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    items = items.where("text is not null").withColumn("item", F.xxhash64("item_id", "text")).dropDuplicates(["item"])
    return items.mapInArrow(of, "item_id long, item long, n_tokens long, seeds array<long>").where("size(seeds) > 0")


def bloom(items: DataFrame) -> np.ndarray:
    """A bitmap of ``2 ** BLOOM_BITS`` bits: bytes of the bits that the seeds set."""
    bit = items.select(F.explode("seeds").alias("seed")).selectExpr(f"shiftrightunsigned(seed, {64 - BLOOM_BITS}) as bit")
    words = bit.selectExpr("shiftright(bit, 5) as word", "shiftleft(1L, cast(bit & 31 as int)) as bit")
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BLOOM_BITS - 5), np.uint32)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return out


class Windows:
    """Karp-Rabin hashes of every window of a row of numbers, for any length of window."""

    def __init__(self, numbers: np.ndarray):
        self.sums = []
        for base in BASES[0]:
            up, down = powers(base, len(numbers) + 1)
            # numbers are below 2**31, so each summand is below 2**31 after modulo and the sum has room for 2**31 of them
            self.sums.append((np.concatenate((np.zeros(1, np.uint64), np.cumsum(modulo(numbers * up[: len(numbers)]), dtype=np.uint64))), down))

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the windows that start ``at``."""
        one, two = (modulo(modulo(sums[at + length] - sums[at]) * down[at]) for sums, down in self.sums)
        return one << np.uint64(31) | two


def tile(positions: np.ndarray, seeds: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles ``(document position, item position, length)`` of one pair, the longest first.

    ``positions, seeds``: the document's seeds, by position; ``item``: all seeds of the item in order.
    Ties go to the earlier place in the item, then in the document. The longest length that still has
    a match is sought by halving, with the windows' hashes of that length; then all its matches are
    marked. No list of pairs of positions is made, so texts that repeat themselves take no more memory.
    """
    if not len(positions) or not len(item):
        return []
    known = np.unique(item)
    number = np.full(len(known) + 1, 0, np.uint64)
    number[:-1] = np.arange(2, len(known) + 2)
    where = np.minimum(np.searchsorted(known, seeds), len(known) - 1)
    # places between the seeds that hits have hold 0; SEED of them keep two tiles apart as well as more do
    at = np.concatenate(([0], np.cumsum(np.minimum(np.diff(positions), SEED))))
    doc = np.zeros(at[-1] + 1, np.uint64)
    doc[at] = np.where(known[where] == seeds, number[where], 0)
    offset = np.zeros(len(doc), np.int64)
    offset[at] = positions
    own = number[np.searchsorted(known, item)]
    # seeds in a row, and tokens of the tiles, which reach SEED - 1 further
    doc_hash, item_hash = Windows(doc), Windows(own)
    free_doc, free_item = doc > 0, np.ones(len(own), bool)

    def matches(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and hashes of the free windows of ``length`` seeds that both have, of the item and of the document."""
        out = []
        for free, windows in ((free_item, item_hash), (free_doc, doc_hash)):
            run = np.concatenate(([0], np.cumsum(free)))
            starts = np.flatnonzero(run[length:] - run[:-length] == length) if length <= len(free) else np.zeros(0, np.int64)
            out.append((starts, windows.of(starts, length)))
        (b, hb), (a, ha) = out
        mine, others = np.isin(hb, ha), np.isin(ha, hb)
        return b[mine], hb[mine], a[others], ha[others]

    out, high = [], min(len(own), len(doc))
    while high >= least - SEED + 1:
        low, top = least - SEED, high  # the longest match has more than low seeds and at most top
        while low < top:
            middle = (low + top + 1) // 2
            if len(matches(middle)[0]):
                low = middle
            else:
                top = middle - 1
        if low < least - SEED + 1:
            return out
        b_at, b_hash, a_at, a_hash = matches(low)
        order = np.argsort(a_hash, kind="stable")
        a_at, a_hash = a_at[order], a_hash[order]
        next_a = {}
        for b, h in zip(b_at.tolist(), b_hash.tolist()):
            if not (free_item[b] and free_item[b + low - 1]):
                continue
            i = next_a.get(h)
            if i is None:
                i = int(np.searchsorted(a_hash, np.uint64(h)))
            while i < len(a_at) and a_hash[i] == h and not (free_doc[a_at[i]] and free_doc[a_at[i] + low - 1]):
                i += 1
            next_a[h] = i
            if i < len(a_at) and a_hash[i] == h:
                a, n = int(a_at[i]), low + SEED - 1
                out.append((int(offset[a]), b, n))
                # a free seed keeps all its tokens free: those that reach into the tile go too
                free_item[max(0, b - SEED + 1) : b + n] = False
                free_doc[max(0, a - SEED + 1) : a + n] = False
        high = low
    return out


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``uid, item_id, covered, coverage, tiles array<struct<doc_start, item_start, length>>``.

    ``docs``: ``uid long, text``. One row for each pair whose tiles cover at least ``coverage`` of the item.
    """
    items = checkpointed(benchmark_seeds(benchmark))
    bits = docs.sparkSession.sparkContext.broadcast(bloom(items))

    def hits(batches):
        for batch in pieces(batches):
            seed, text, at, _ = seeds_of(batch.column("text"))
            bit = seed >> np.uint64(64 - BLOOM_BITS)
            maybe = np.flatnonzero(bits.value[bit >> np.uint64(5)] >> (bit & np.uint64(31)).astype(np.uint32) & np.uint32(1))
            uid = batch.column("uid").to_numpy(zero_copy_only=False)
            if len(maybe):
                yield pa.record_batch([pa.array(uid[text[maybe]]), pa.array(at[maybe]), pa.array(seed[maybe].view(np.int64))], ["uid", "at", "seed"])

    found = docs.select("uid", "text").mapInArrow(hits, "uid long, at long, seed long")
    own = items.select("item", "n_tokens", F.explode("seeds").alias("seed")).groupBy("item", "n_tokens", "seed").agg(F.count("*").alias("times"))
    # every seed of the pair once for the item, with its places in the document
    met = found.join(own, "seed").groupBy("uid", "item").agg(F.first("n_tokens").alias("n_tokens"), F.sort_array(F.collect_set(F.struct("at", "seed"))).alias("hits"), F.collect_set(F.struct("seed", "times")).alias("common"))
    # tiles of at least SEED tokens that cover the share need this many tokens, each in a common seed at some place of the item
    places = F.aggregate("common", F.lit(0).cast("long"), lambda n, x: n + x["times"])
    met = met.where(places * SEED >= F.col("n_tokens") * coverage)
    pairs = met.join(items.select("item", "item_id", F.col("seeds").alias("item_seeds")), "item")
    pairs = pairs.select("uid", "item_id", "n_tokens", F.transform("hits", lambda h: h["at"]).alias("at"), F.transform("hits", lambda h: h["seed"]).alias("seed"), "item_seeds")
    kind = pa.list_(pa.struct([("doc_start", pa.int64()), ("item_start", pa.int64()), ("length", pa.int64())]))

    def tiled(batches):
        for batch in batches:
            rows = {k: [] for k in ("uid", "item_id", "covered", "coverage", "tiles")}
            for r in range(batch.num_rows):
                uid, item_id, n, at, seed, item = (batch.column(i)[r] for i in range(6))
                found = tile(*(x.values.to_numpy(zero_copy_only=False) for x in (at, seed, item)))
                covered, n = sum(x[2] for x in found), n.as_py()
                if covered >= coverage * n:
                    for k, v in (("uid", uid.as_py()), ("item_id", item_id.as_py()), ("covered", covered), ("coverage", covered / n), ("tiles", [{"doc_start": a, "item_start": b, "length": c} for a, b, c in found])):
                        rows[k].append(v)
            yield pa.record_batch([pa.array(rows["uid"], pa.int64()), pa.array(rows["item_id"], pa.int64()), pa.array(rows["covered"], pa.int64()), pa.array(rows["coverage"], pa.float64()), pa.array(rows["tiles"], kind)], list(rows))

    return pairs.mapInArrow(tiled, "uid long, item_id long, covered long, coverage double, tiles array<struct<doc_start long, item_start long, length long>>")


def find_contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, contaminated, item_ids, coverage, n_tiles``, one row for each row of ``docs``.

    ``item_ids``: all items whose tokens the document's tiles cover to ``coverage`` at least, in order;
    ``coverage`` and ``n_tiles`` are of the best of them (0 if there is none). Null texts have no
    tokens. Items of fewer than five tokens, and null ones, match nothing. Repeated rows get equal
    results; ids may be null or repeated. Texts of any length, and texts that repeat themselves, take
    memory in proportion to their length. Other columns are ignored. Empty tables are allowed.
    """
    source = id_and_text(docs, id_col, text_col).withColumn("uid", F.xxhash64("doc_id", "text"))
    pairs = contaminated_pairs(source, benchmark, coverage)
    best = pairs.groupBy("uid").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max(F.struct("coverage", (-F.size("tiles")).alias("fewer"))).alias("best"))
    best = checkpointed(best.select("uid", "item_ids", F.col("best.coverage").alias("coverage"), (-F.col("best.fewer")).cast("long").alias("n_tiles")))
    out = source.select("doc_id", "uid").join(best, "uid", "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("n_tiles", F.lit(0).cast("long")).alias("n_tiles"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item.

    Rows with a null or empty text hold none and stay, with whatever id; repeated rows stay or go together. Texts of
    any length are judged whole. Columns may have any names. An empty table gives an empty result. See
    ``find_contamination``.
    """
    uid = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = small(checkpointed(contaminated_pairs(docs.select(uid.alias("uid"), F.col("text").cast("string").alias("text")), benchmark, coverage).select(F.col("uid").alias("found_uid")).distinct()))
    return docs.join(found, uid == F.col("found_uid"), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
