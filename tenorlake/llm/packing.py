"""Packing of tokenized documents into sequences of a fixed length.

Method: best-two-fit. A bin is filled greedily, always with the longest piece that fits; then its smallest piece is taken out if two
unpacked ones fill the larger gap more tightly, the tightest two. What is packed is not pieces but counts of lengths, of
which there are no more than a sequence has tokens: as long as no length runs out the next bins come out alike, so they are made at once,
and the result is the same as one bin at a time over all pieces. So the packing is global, needs memory for the lengths only,
and is the same however the table is partitioned.

Spark tokenizes, numbers the pieces of each length (tasks number their own, sums over tasks place them), and each piece then
looks up its sequence and place by length and number.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_right
from zlib import crc32

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import checkpointed, id_and_text, pieces, release, texts
from .bpe import byte_letters

#: Fixed value: how byte-level vocabularies of this kind split text.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that all versions of Unicode class alike; texts with others are left to the slower library.
OTHERS = re.compile(r"[^\x00-\u024f\u0400-\u045f\u2013-\u2026\u3041-\u3096\u4e00-\u9fa5]")
_loaded: dict[str, Encoder] = {}


class Encoder:
    """Ids of whole texts as the ``tokenizers`` library gives them, for a byte-level BPE file.

    Where a merge's rank is its id ``tiktoken`` gives the same ids several times faster; it is used for texts of ordinary characters
    that hold no special token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.slow, self.fast, self.special = path, None, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        names = [t["content"] for t in spec["added_tokens"]]
        if names:
            self.special = re.compile("|".join(map(re.escape, names)))
        byte_of = {c: b for b, c in byte_letters().items()}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ranks = [model["vocab"].get(m, -1) for m in merged]
        plain = all(not spec.get(k) for k in ("normalizer", "truncation", "padding")) and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "ignore_merges"))
        if plain and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and ranks == list(range(256, 256 + len(ranks))):
            tokens = {bytes(byte_of[c] for c in name): i for name, i in model["vocab"].items() if name not in names}
            self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=WORDS, mergeable_ranks=tokens, special_tokens={})

    def ids(self, batch: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(batch)
        rest = []
        for i, t in enumerate(batch):
            if self.fast is None or not t.isascii() and OTHERS.search(t) or self.special and self.special.search(t):
                rest.append(i)
            else:
                out[i] = np.array(self.fast.encode_ordinary(t), "<u4")
        if rest:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
                self.slow.no_truncation()
                self.slow.no_padding()
            for i in rest:
                out[i] = np.array(self.slow.encode(batch[i], add_special_tokens=False).ids, "<u4")
        return out


def load(path: str) -> Encoder:
    """The encoder, once in each Python process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, part, nth[, ids]`` of ``doc_id, text``: each document's ids and ``end_id``.

    Documents of over ``capacity`` tokens are cut from their end, so that all pieces but the first are full. ``nth`` numbers the
    pieces of a length within the task ``part``.
    """
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * with_ids

    def of(batches):
        encoder, seen, part = load(path), [0] * (capacity + 1), TaskContext.get().partitionId()
        for batch in pieces(batches):
            owner, rows, found = [], [], []
            for i, own in enumerate(encoder.ids(texts(batch.column("text")))):
                whole = np.append(own, np.array([end_id], "<u4")).astype("<u4")
                n = len(whole)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    owner.append(i)
                    rows.append((k, a, b - a, crc32(whole[a:b]), part, seen[b - a]))
                    seen[b - a] += 1
                    if with_ids:
                        found.append(whole[a:b].astype(np.int32))
            piece, start, length, crc, at, nth = zip(*rows)
            columns = [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(at, pa.int32()), pa.array(nth, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:
                columns.append(pa.array(found, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(columns, names)
        release()

    return docs.mapInArrow(of, kinds)


def tightest_two(lengths: np.ndarray, free: np.ndarray, room: int) -> tuple[int, int]:
    """The two of the ascending ``lengths``, ``free`` of each, that fill ``room`` best, or (0, 0). On ties the one with the longest."""
    at = np.arange(len(lengths))
    mate = np.minimum(np.searchsorted(lengths, room - lengths, side="right") - 1, at)
    mate = np.where((mate == at) & (free < 2), mate - 1, mate)
    both = np.where(mate >= 0, lengths + lengths[mate], 0)
    if not len(both) or not both.max():
        return 0, 0
    best = len(both) - 1 - int(np.argmax(both[::-1]))
    return int(lengths[best]), int(lengths[mate[best]])


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first, times, sequence, offset) of the packing of ``counts`` pieces of each length.

    The pieces of a length are numbered from 0. From number ``first`` on, to the length's next run, each ``times`` of them
    in a row are in a sequence of their own, from ``sequence`` on, beginning at ``offset`` there.
    """
    lengths = np.array(sorted(counts), np.int64)
    free = np.array([counts[n] for n in lengths.tolist()], np.int64)
    used, runs, sequence = dict.fromkeys(counts, 0), [], 0
    while len(lengths):
        listed = lengths.tolist()
        gap, held, at = capacity, {}, len(listed) - 1
        while at >= 0:
            n = listed[at]
            held[n] = min(gap // n, int(free[at]))
            gap -= held[n] * n
            at = min(at, bisect_right(listed, gap)) - 1
        least = min(held)
        if gap and sum(held.values()) > 1:
            left = free - np.array([held.get(n, 0) for n in listed])
            a, b = tightest_two(lengths[left > 0], left[left > 0], gap + least)
            if a + b > least:
                held[least] -= 1
                for n in (a, b):
                    held[n] = held.get(n, 0) + 1
        own = [(n, t) for n, t in held.items() if t]
        place = {n: i for i, n in enumerate(listed)}
        # as many bins alike as the lengths last
        alike = min(int(free[place[n]]) // t for n, t in own)
        offset = 0
        for n, t in own:
            runs.append((n, used[n], t, sequence, offset))
            offset += n * t
            used[n] += t * alike
            free[place[n]] -= t * alike
        sequence += alike
        if not free.all():
            lengths, free = lengths[free > 0], free[free > 0]
    return runs


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]``: a row for each piece of each row of ``docs``.

    A document is its ids by the ``tokenizers`` library and then ``end_id``, so a null or empty text is one token. It is cut only if it is longer than
    ``capacity``, with the first piece the shorter one. ``sequence_id`` counts from 0; the pieces of a sequence have no gap between them, and
    ``start`` tells the document's ids before the piece. Rows that repeat an id are packed each; ids are carried, null ones too; other columns are ignored. Which of
    several pieces of a length goes where follows their order in the table. An empty table gives an empty result. ``path`` is read in each
    task and must exist there.
    """
    found = checkpointed(token_pieces(id_and_text(docs, id_col, text_col), path, capacity, end_id, with_ids))
    by_task = found.groupBy("part", "length").agg(F.count("*").alias("rows"))
    earlier = F.sum("rows").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    by_task = by_task.select("part", "length", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    # no more lengths than a sequence has tokens
    counts = {r["length"]: r["rows"] for r in found.groupBy("length").agg(F.count("*").alias("rows")).collect()}
    runs = sorted(best_two_fit(counts, capacity))
    numbered = found.join(by_task, ["part", "length"]).withColumn("nth", F.col("nth") + F.col("earlier"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches):
        length, first, times, sequence, offset = np.array(runs, np.int64).reshape(-1, 5).T
        for batch in batches:
            own, nth = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "nth"))
            at = np.searchsorted(length << 44 | first, own << 44 | nth, side="right") - 1
            among = nth - first[at]
            where = [pa.array(sequence[at] + among // times[at]), pa.array(offset[at] + among % times[at] * own)]
            yield pa.record_batch([*(batch.column(c) for c in names), *where, *([batch.column("ids")] if with_ids else [])], [*names, "sequence_id", "offset", *(["ids"] if with_ids else [])])

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return numbered.select(*names, "nth", *(["ids"] if with_ids else [])).mapInArrow(place, kinds)
