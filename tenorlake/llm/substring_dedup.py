"""Repeated passages: words of long matches with an earlier document are removed.

Method: difference-cover anchors. Let D be a difference cover modulo a period p (every residue is a
difference of two members). For any two positions i and j some shift s < p puts both i + s and j + s at
cover positions. So two copies of a window of w words share an anchor of w - p + 1 words that starts
at a cover position in both. The job runs in three steps on blocks of documents:

1. hash the anchors at cover positions only; find those that two different documents share;
2. extend: every w-word window around a shared anchor is hashed whole (128 bits), and the smallest
   document id with the same window is found;
3. drop the words of each window that a smaller document also has.

Hashes travel as packed arrays, one for each pair of block and hash bucket, and only bitmaps come back.
A block sends each distinct hash once, whatever number of its documents hold it, so a passage that a
third of all documents share adds one entry a block to its bucket. Blocks and buckets are made by
bytes of text: they get more, not larger, as the table grows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import blocks_for, id_and_text, ids, packed_blocks, text_bytes, unpacked
from .tokens import WORD, text_of_word, window_hashes, word_hashes, word_spans

#: Difference covers by period.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}

SENT = "bucket int, block int, hashes binary, docs binary, counts binary"
REPLY = "block int, step int, bucket int, bits binary"


class Block:
    """The words of one block of documents, in an order that each step finds again."""

    def __init__(self, table: pa.Table):
        table = table.select(["doc_id", "text"])
        if table.num_rows > 1:
            table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.table = table
        self.doc = ids(table["doc_id"])
        self.data, offsets = text_bytes(table["text"])
        self.starts, self.ends, self.first = word_spans(self.data, offsets, WORD)
        self.of = text_of_word(self.first)

    def hashes(self, which: int) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends, which)

    def runs(self, length: int) -> np.ndarray:
        """For each start of ``length`` words: do they lie in one document?"""
        n = max(0, len(self.starts) - length + 1)
        return self.of[:n] == self.of[length - 1 : length - 1 + n]

    def anchors(self, length: int, period: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of each anchor."""
        at = np.flatnonzero(self.runs(length))
        cover = np.zeros(period, bool)
        cover[list(COVERS[period])] = True
        at = at[cover[(at - self.first[self.of[at]]) % period]]
        return at, window_hashes(self.hashes(0), length)[at]


class Entries:
    """The distinct hashes (of one or two words of 64 bits) of a block, dealt to buckets by value.

    ``run`` has for each occurrence its entry; an entry knows the least and the greatest document that holds it.
    """

    def __init__(self, hashes: np.ndarray, more: tuple, doc: np.ndarray, buckets: int):
        keys = np.stack((hashes, *more))
        order = np.lexsort(keys[::-1]) if more else np.argsort(hashes, kind="stable")
        inorder = keys[:, order]
        new = np.ones(len(order), bool)
        new[1:] = (inorder[:, 1:] != inorder[:, :-1]).any(axis=0)
        first = np.flatnonzero(new)
        self.run = np.empty(len(order), np.int64)
        self.run[order] = np.cumsum(new) - 1
        self.keys = inorder[:, first]
        empty = np.zeros(0, np.int64)
        self.least = np.minimum.reduceat(doc[order], first) if len(first) else empty
        self.greatest = np.maximum.reduceat(doc[order], first) if len(first) else empty
        bucket = (self.keys[0] >> np.uint64(33)) % np.uint64(buckets)
        self.by = np.lexsort((self.least, bucket))
        self.cuts = np.searchsorted(bucket[self.by], np.arange(buckets + 1))

    def packed(self, block: int, with_docs: bool) -> pa.Table:
        """A row a bucket: its hashes, and with ``with_docs`` their least documents as runs."""
        rows = {k: [] for k in ("bucket", "block", "hashes", "docs", "counts")}
        for b in np.flatnonzero(np.diff(self.cuts)):
            own = self.by[self.cuts[b] : self.cuts[b + 1]]
            rows["bucket"].append(int(b))
            rows["block"].append(block)
            rows["hashes"].append(self.keys[:, own].tobytes())
            d = self.least[own] if with_docs else np.zeros(0, np.int64)
            new = np.flatnonzero(np.diff(d, prepend=d[:1] - 1)) if len(d) else d
            rows["docs"].append(d[new].tobytes())
            rows["counts"].append(np.diff(np.append(new, len(d))).astype(np.int32).tobytes())
        return pa.table(rows, pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary())]))

    def answered(self, replies: pa.Table, step: int) -> np.ndarray:
        """The bits of all buckets, by entry."""
        hit = np.zeros(len(self.least), bool)
        for s, b, bits in zip(replies["step"].to_pylist(), replies["bucket"].to_pylist(), replies["bits"].to_pylist()):
            if s == step:
                own = self.by[self.cuts[b] : self.cuts[b + 1]]
                hit[own] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
        return hit


def reply(step: int, wide: int):
    """For a bucket: which entries count. Step 1: another block has the hash; step 2: another has it in a smaller document.

    A document is in one block only, so what two blocks hold two documents hold.
    """

    def of(table: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x, np.uint64).reshape(wide, -1) for x in table["hashes"].to_pylist()]
        keys = np.concatenate(sent, axis=1)
        order = np.argsort(keys[0]) if wide == 1 else np.lexsort(keys[::-1])
        inorder = keys[:, order]
        new = np.flatnonzero(np.concatenate(([True], (inorder[:, 1:] != inorder[:, :-1]).any(axis=0))))
        size = np.diff(np.append(new, len(order)))
        run = np.repeat(np.arange(len(new)), size)
        hit = np.empty(len(order), bool)
        if step == 1:
            hit[order] = (size > 1)[run]
        else:
            doc = np.concatenate([np.repeat(np.frombuffer(d, np.int64), np.frombuffer(c, np.int32)) for d, c in zip(table["docs"].to_pylist(), table["counts"].to_pylist())])[order]
            hit[order] = doc > np.minimum.reduceat(doc, new)[run]
        bits, blocks, at = [], [], 0
        for block, own in zip(table["block"].to_pylist(), sent):
            mine = hit[at : at + own.shape[1]]
            at += own.shape[1]
            if mine.any():
                blocks.append(block)
                bits.append(np.packbits(mine).tobytes())
        n = len(bits)
        return pa.table([pa.array(blocks, pa.int32()), pa.array([step] * n, pa.int32()), pa.array([table["bucket"][0].as_py()] * n, pa.int32()), pa.array(bits, pa.binary())], ["block", "step", "bucket", "bits"])

    return of


def remove_repeated_passages(docs: DataFrame, window: int = 13, period: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text``, one row for each row of ``docs``.

    A word (``[^\\x20\\x09-\\x0D]+``, unchanged) goes if a window of ``window`` words that covers it also
    starts in a document with a smaller id. Windows are judged on the input. Kept words are joined by
    one space. A null text has no words. Null ids sort after all others, and rows with the same id
    (repeated rows, null ids) never remove each other's words. A text of any length is one row of one
    block, which one task holds whole. Other columns are ignored. An empty table gives an empty result.
    """
    anchor = window - period + 1
    if anchor < 1 or period not in COVERS:
        raise ValueError(f"the period must be one of {sorted(COVERS)} and no longer than the window")
    blocks = buckets = blocks_for(docs, text_col)
    source = id_and_text(docs, id_col, text_col)
    source = packed_blocks(source.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text"))

    def anchors(block: Block) -> tuple[np.ndarray, Entries]:
        at, hashes = block.anchors(anchor, period)
        return at, Entries(hashes, (), block.doc[block.of[at]], buckets)

    def windows(block: Block, replies: pa.Table) -> tuple[np.ndarray, Entries]:
        """Starts of the windows around anchors that two documents share, and their 128-bit hashes."""
        at, entries = anchors(block)
        at = at[(entries.answered(replies, 1) | (entries.least < entries.greatest))[entries.run]]
        n = max(0, len(block.starts) - window + 1)
        # a window at i holds the anchors that start in i .. i + period - 1
        change = np.zeros(n + period + 1, np.int32)
        np.add.at(change, np.minimum(np.maximum(at - period + 1, 0), n), 1)
        np.add.at(change, np.minimum(at + 1, n), -1)
        own = np.flatnonzero((np.cumsum(change[:n]) > 0) & block.runs(window))
        one, two = (window_hashes(block.hashes(k), window, k)[own] if len(own) else np.zeros(0, np.uint64) for k in (0, 1))
        return own, Entries(one, (two,), block.doc[block.of[own]], buckets)

    def send_anchors(table: pa.Table) -> pa.Table:
        return anchors(Block(unpacked(table)))[1].packed(table["block"][0].as_py(), False)

    def send_windows(key, table: pa.Table, replies: pa.Table) -> pa.Table:
        return windows(Block(unpacked(table)), replies)[1].packed(key[0].as_py(), True)

    def keep(key, table: pa.Table, replies: pa.Table) -> pa.Table:
        block = Block(unpacked(table))
        n = len(block.starts)
        own, entries = windows(block, replies)
        # copies of a window inside the block are told by its own least document
        own = own[entries.answered(replies, 2)[entries.run] | (block.doc[block.of[own]] > entries.least[entries.run])]
        change = np.zeros(n + 1, np.int32)
        np.add.at(change, own, 1)
        np.add.at(change, own + window, -1)
        gone = np.cumsum(change[:n]) > 0
        raw = block.data.tobytes()
        starts, ends, first = block.starts.tolist(), block.ends.tolist(), block.first.tolist()
        kept, stay = [], (~gone).tolist()
        for a, b in zip(first, first[1:]):
            kept.append(b" ".join([raw[starts[i] : ends[i]] for i in range(a, b) if stay[i]]))
        removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[block.first])
        return pa.table([block.table["doc_id"].combine_chunks(), pa.array(np.diff(block.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    by_block = source.groupBy("block")
    shared = by_block.applyInArrow(send_anchors, SENT).groupBy("bucket").applyInArrow(reply(1, 1), REPLY)
    later = by_block.cogroup(shared.groupBy("block")).applyInArrow(send_windows, SENT).groupBy("bucket").applyInArrow(reply(2, 2), REPLY)
    return by_block.cogroup(shared.unionByName(later).groupBy("block")).applyInArrow(keep, "doc_id long, n_words long, n_removed long, kept_text string")
