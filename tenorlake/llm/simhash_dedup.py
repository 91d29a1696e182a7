"""Near duplicates by SimHash, linked through the anchors of a covering code.

Method: anchor-point covering. A 64-bit fingerprint has two halves of 32 bits, and two fingerprints
that differ in at most 3 bits differ in at most 1 bit of one half. The anchors of a half are the
words of the [31, 26] Hamming code, a covering code of radius 1 (every 31-bit word is within 1 bit of
exactly one anchor), times the free 32nd bit. A fingerprint's home is the anchor within the covering
radius; it is replicated to every anchor within radius plus threshold, 1 + 1 bits. If x and y differ in
at most 1 bit of the half, then y lies within 2 bits of x's home, so comparing homes with replicas per
anchor finds every pair. Equal fingerprints are one row before that; an anchor emits only the links
of a spanning forest. Rows are counted by anchor first, and the rows of an anchor with very many are dealt to
pairs of blocks, so that no task holds a whole anchor.

Whole near copies (``keep_one_of_each``) are another relation, a similarity of 0.8 of five-word shingles. Two such texts differ in about 10 of 64 bits of a SimHash (the angle between their sets is 27 degrees), and 3 bits, the
most that the anchors reach, catch few of them. So candidates are both: texts whose SimHash over five-word
shingles meets at an anchor, and texts that share a band of MinHash values. A link is made only where the
shingles themselves agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .base import NO_ID, checkpointed, clean, id_and_text, pieces, release, shuffle_partitions, small, text_bytes, texts
from .components import components
from .tokens import STEPS, WORD, mixed, text_of_word, window_hashes, word_hashes, word_spans

#: An anchor with more rows is compared in pairs of blocks of about this many.
ANCHOR_ROWS = 8192
#: Rows that a print has at anchors, about, and rows that are compared at a time.
REPLICAS, BUCKET_ROWS = 34, 1 << 16


def majority(hashes: list[int]) -> int:
    """The bits that are set in over half of the 64-bit ``hashes``."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(np.array(hashes[at : at + 65536], ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        # bits are summed 255 rows at a time in bytes that cannot overflow
        whole = len(bits) // 255 * 255
        if whole:
            total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprint(text: str, shingle: int = 3) -> int:
    """SimHash over XXH64 (seed 42) of word shingles of the text with A-Z in lower case."""
    return of_shingles(text.encode().lower().split(), shingle)


def of_shingles(words: list[bytes], shingle: int) -> int:
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        return majority([xxh64_intdigest(b" ".join(words), 42)])
    if shingle == 3:
        return majority([xxh64_intdigest(b"%b %b %b" % x, 42) for x in zip(words, words[1:], words[2:])])
    return majority([xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(n - shingle + 1)])


def signed(values: list) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp``, one row for each row of ``doc_id, text``: the bits of the fingerprint as a long."""

    def of(batches):
        for batch in pieces(batches):
            fp = signed([of_shingles(t.encode().lower().split(), shingle) for t in texts(batch.column("text"))])
            yield pa.record_batch([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, fp long")


def syndrome(half: np.ndarray) -> np.ndarray:
    """Hamming syndrome of bits 1..31 of a 32-bit half: the exclusive or of the positions that are set."""
    out = np.zeros(len(half), np.uint32)
    for bit in range(5):
        mask = np.uint32(sum(1 << p for p in range(1, 32) if p >> bit & 1))
        out |= (np.bitwise_count(half & mask) & np.uint32(1)).astype(np.uint32) << np.uint32(bit)
    return out


def home(half: np.ndarray) -> np.ndarray:
    """The one anchor within one bit: the position that the syndrome names is turned over."""
    s = syndrome(half)
    return half ^ np.where(s > 0, np.uint32(1) << s, np.uint32(0)).astype(np.uint32)


def replicas(half: np.ndarray) -> list[np.ndarray]:
    """All anchors within two bits; the first is the home. Where there are fewer, the home is repeated.

    With bit 0, which is free, as it is: the home, and each anchor that two positions p, q with
    p ^ q = syndrome reach. With bit 0 turned over: the home's twin.
    """
    first, s = home(half), syndrome(half)
    out = [first, first ^ np.uint32(1)]
    for p in range(1, 32):
        q = s ^ np.uint32(p)
        # each pair once; the syndrome's own position alone is the home already
        use = (q > p) & (s > 0)
        if use.any():
            out.append(np.where(use, half ^ (np.uint32(1) << np.uint32(p)) ^ (np.uint32(1) << q), first).astype(np.uint32))
    return out


class Forest:
    """Union-find over the few nodes of one task, to keep only links that join two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def joins(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def spanning(starts: np.ndarray, fp: np.ndarray, is_home: np.ndarray, threshold: int, chunk: int = 1 << 20) -> list[tuple[int, int]]:
    """Links of a forest between homes and all rows of the same run; runs begin at ``starts``."""
    forest, links = Forest(), []
    size = np.diff(np.append(starts, len(fp)))
    run = np.repeat(np.arange(len(starts)), size)
    homes = np.flatnonzero(is_home)
    width = size[run[homes]]
    ends = np.cumsum(width)
    at = 0
    while at < len(homes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk, side="right")))
        h, w = homes[at:to], width[at:to]
        left = np.repeat(h, w)
        right = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + np.repeat(starts[run[h]], w)
        near = (np.bitwise_count(fp[left] ^ fp[right]) <= threshold) & (fp[left] != fp[right])
        for a, b in zip(fp[left[near]].tolist(), fp[right[near]].tolist()):
            if forest.joins(a, b):
                links.append((a, b))
        at = to
    return links


def near_links(prints: DataFrame, threshold: int = 3) -> DataFrame:
    """``a, b``: links that connect all of ``prints (fp long)``, distinct and checkpointed, that differ in at most ``threshold`` bits.

    Not every close pair is returned, but every close pair is connected through what is returned.
    """
    if threshold > 3:
        raise ValueError("two halves cover at most 3 differing bits")

    def send(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for which in (0, 1):
                half = (fp >> np.uint64(32 * which)).astype(np.uint32)
                for k, anchor in enumerate(replicas(half)):
                    own = slice(None) if k < 2 else anchor != home(half)
                    key = anchor[own].astype(np.int64) | (which << 32)
                    yield pa.record_batch([pa.array(key), pa.array(fp[own].view(np.int64)), pa.array(np.full(len(key), k == 0))], ["anchor", "fp", "home"])

    sent = prints.select("fp").mapInArrow(send, "anchor long, fp long, home boolean")
    large = checkpointed(sent.groupBy("anchor").count().where(F.col("count") > ANCHOR_ROWS).select("anchor", F.ceil(F.col("count") / ANCHOR_ROWS).cast("int").alias("parts")))
    if large.isEmpty():
        rows = sent.select("anchor", F.lit(0).alias("part_a"), F.lit(0).alias("part_b"), "fp", "home")
    else:
        # homes of block a meet the replicas of block b in the task (a, b); a home is a replica too
        dealt = sent.join(small(large), "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        rows = dealt.select("anchor", every.alias("part_a"), F.col("part").alias("part_b"), "fp", F.lit(False).alias("home"))
        rows = rows.unionByName(dealt.where("home").select("anchor", F.col("part").alias("part_a"), every.alias("part_b"), "fp", "home"))
    # buckets get more and not larger as the prints do
    buckets = max(4 * shuffle_partitions(prints.sparkSession), prints.count() * REPLICAS // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("anchor", "part_a", "part_b"), F.lit(buckets)).cast("int"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("anchor", "ascending"), ("part_a", "ascending"), ("part_b", "ascending")])
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for c in ("anchor", "part_a", "part_b"):
            v = table[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        links = spanning(np.flatnonzero(new), table["fp"].to_numpy().view(np.uint64), table["home"].combine_chunks().to_numpy(zero_copy_only=False), threshold)
        a, b = (np.array(links, np.uint64).view(np.int64).reshape(-1, 2)).T
        return pa.table({"a": a, "b": b})

    return rows.groupBy("bucket").applyInArrow(compare, "a long, b long")


def near_duplicate_classes(docs: DataFrame, threshold: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint (16 hex digits), component_id``, one row for each row of ``docs``.

    Fingerprints within ``threshold`` bits link their documents; a component is named by the smallest
    id that links reach. Texts without words (also null and empty ones) have fingerprint zero and link
    like any other. A document without an id takes part under the largest long; its ``doc_id`` is
    returned as null, and so is a component that only such documents form. Repeated ids and
    rows share their fingerprint's component. An empty table gives an empty result.
    """
    out = classified(id_and_text(docs, id_col, text_col), threshold, shingle)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def classified(source: DataFrame, threshold: int, shingle: int) -> DataFrame:
    """``doc_id, fp, component_id`` of ``doc_id, text``."""
    prints = checkpointed(fingerprints(source, shingle))
    # documents with equal fingerprints are one node
    nodes = checkpointed(prints.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("first")))
    classes = named(nodes.select(F.col("fp").alias("node"), "first"), near_links(nodes, threshold))
    return prints.join(classes.withColumnRenamed("node", "fp"), "fp").select("doc_id", "fp", "component_id")


def named(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component_id`` of ``nodes (node, first)``: the least ``first`` that links reach, null if it is ``NO_ID``."""
    grouped = checkpointed(nodes.join(components(links), "node", "left").select("node", "first", F.coalesce("component", "node").alias("component")))
    # most nodes are alone; for the others the least first is found and joined, from a table of its own so that a hot class can be split
    many = grouped.where("node <> component").select("component").distinct()
    many = small(checkpointed(many))
    least = small(checkpointed(grouped.join(many, "component", "left_semi").groupBy("component").agg(F.min("first").alias("least"))))
    joined = grouped.join(least, "component", "left").select("node", F.coalesce("least", "first").alias("least"))
    return checkpointed(joined.select("node", F.nullif("least", F.lit(NO_ID)).alias("component_id")))


#: Whole near copies: words of a shingle, and the share of alike shingles (a fraction) from which two texts are copies.
COPY_SHINGLE, ALIKE = 5, (4, 5)
#: Least share of the larger text's shingles that are equal in both: part of the loose relation.
EQUAL = (2, 5)
#: Words of the shingles that candidates share. A changed word spoils two of these, and not five: with a word changed in every ten two thirds of
#: all are equal, where one third of the five-word shingles is.
BAND_SHINGLE = 2
#: MinHash values of a band, and bands: a pair meets in none with a chance of 1 in 1,000 if two thirds of all its short shingles are equal, 1 in 5 at a half.
BAND_ROWS, BANDS = 5, 48
#: Candidates of one group, and bytes of their texts, that a task compares with as many others.
COPY_BLOCK, COPY_BYTES = 256, 4 << 20
#: Bytes of text that are measured at a time.
PIECE = 1 << 18
FACTORS = mixed(np.arange(1, BAND_ROWS * BANDS + 1, dtype=np.uint64)) | np.uint64(1)
LOWER = np.array([ord(chr(i).lower()) if i < 128 else i for i in range(256)], np.uint8)


def words_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, A-Z in lower case, and where each text's begin (one more at the end)."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, WORD)
    return word_hashes(data, starts, ends), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, length: int = COPY_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all texts in a row, and where each text's begin (one more at the end).

    A shorter text is one shingle, also one without words, so each text has some.
    """
    of = text_of_word(first)
    at = np.flatnonzero(of[: max(0, len(of) - length + 1)] == of[length - 1 :])
    short = np.flatnonzero(np.diff(first) < length)
    whole = [window_hashes(words[a:b], b - a)[0] if b > a else 0 for a, b in zip(first[short].tolist(), first[short + 1].tolist())]
    text = np.concatenate((of[at], short))
    by = np.argsort(text, kind="stable")
    hashes = np.concatenate((window_hashes(words, length)[at], np.array(whole, np.uint64)))[by]
    return hashes, np.searchsorted(text[by], np.arange(len(first)))


def band_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text a key a band, over the least of its shingles' hashes in ``BAND_ROWS`` orders."""
    out = np.tile(np.arange(BANDS, dtype=np.uint64), (len(first) - 1, 1))
    for k, factor in enumerate(FACTORS):
        least = np.minimum.reduceat(hashes * factor, first[:-1])
        out[:, k // BAND_ROWS] = mixed(out[:, k // BAND_ROWS] * STEPS[0] + least)
    return out


def four_of_five(words: np.ndarray) -> np.ndarray:
    """Of each shingle the hashes of what is left without one of its words, a row for each place."""
    n = max(0, len(words) - COPY_SHINGLE + 1)
    out = np.zeros((COPY_SHINGLE, n), np.uint64)
    for drop in range(COPY_SHINGLE):
        for k in range(COPY_SHINGLE):
            if k != drop:
                out[drop] = out[drop] * STEPS[0] + words[k : k + n]
    return mixed(out)


def loosely_alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Does each text have ``ALIKE`` of its shingles in the other, four of five words in order being enough? The loose relation's last part."""
    if min(len(a), len(b)) < COPY_SHINGLE:
        return False
    a, b = four_of_five(a), four_of_five(b)
    up, down = ALIKE
    return all(down * np.isin(x, y.ravel()).any(axis=0).sum() >= up * x.shape[1] for x, y in ((a, b), (b, a)))


def copy_links(words: np.ndarray, word_first: np.ndarray, left: np.ndarray, right: np.ndarray, known: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of texts, one of ``left`` and one of ``right`` (true for a text or not), that are copies, as a forest.

    Texts that are ``known`` are linked with each other already.
    """
    hashes, first = shingle_hashes(words, word_first)
    n = len(first) - 1
    text = text_of_word(first)
    by = np.lexsort((hashes, text))
    hashes, text = hashes[by], text[by]
    new = np.ones(len(text), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    text = text[new]
    starts, size = np.searchsorted(text, np.arange(n)), np.bincount(text, minlength=n)
    _, code = np.unique(hashes[new], return_inverse=True)
    has = np.zeros(len(code), np.int32)
    tree, links = np.where(known, n, np.arange(n)), []
    (up, down), (some, of) = ALIKE, EQUAL
    own_words = [words[a:b] for a, b in zip(word_first, word_first[1:])]
    for i in np.flatnonzero(left):
        # the sizes that both relations ask for; a pair in one tree needs no link
        other = right & (tree != tree[i]) & (down * np.minimum(size, size[i]) >= up * np.maximum(size, size[i]))
        if not other.any():
            continue
        own = code[starts[i] : starts[i] + size[i]]
        has[own] = 1
        common = np.add.reduceat(has[code], starts)
        has[own] = 0
        for j in np.flatnonzero(other & (of * common >= some * np.maximum(size, size[i]))):
            if tree[j] != tree[i] and (down * common[j] >= up * (size[j] + size[i] - common[j]) or loosely_alike(own_words[i], own_words[j])):
                links.append((int(i), int(j)))
                tree[tree == tree[j]] = tree[i]
    return links


def candidates(nodes: DataFrame) -> DataFrame:
    """``a, b``: links between ``nodes (node, fp, keys)`` that share a band, and between such as meet at an anchor."""
    bands = nodes.select("node", F.explode("keys").alias("key"))
    # equal fingerprints are one key more; close ones link the least nodes that have them
    prints = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    keyed = bands.unionByName(nodes.select("node", F.xxhash64(F.lit("fp"), "fp").alias("key")))
    least = keyed.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("rows")).where("rows > 1").select("key", "a")
    stars = keyed.join(least, "key").where("node <> a").select("a", F.col("node").alias("b"))
    near = checkpointed(near_links(prints.select("fp")))
    clean(nodes.sparkSession)
    a, b = (prints.select(F.col("fp").alias(f), F.col("least").alias(f"node_{f}")) for f in "ab")
    return stars.unionByName(near.join(a, "a").join(b, "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))).distinct()


def copies(source: DataFrame) -> DataFrame:
    """``doc_id, component_id`` of ``doc_id, text``: classes that pairs with a similarity of ``ALIKE`` or more connect.

    Two texts are copies by the strict relation if 0.8 of all their distinct five-word shingles are equal (Jaccard). They are by the loose one
    if their numbers of distinct shingles are within a fifth of the larger, 0.4 of the larger number are equal (``EQUAL``), and each has 0.8 of
    its shingles in the other, shingles with four of five words in order being alike: a changed word spoils no shingle then, and not five. So a
    word changed in every ten makes a copy, one in every eight none, and a text repeated twice is no copy of itself said once.
    Candidates are grouped by what links them (``candidates``), and in each group all pairs are compared, in one task.
    In a group of over ``COPY_BLOCK`` texts all are compared with one of them first, which takes them once; those
    that are its copies need not be compared with each other, but only with the others, in pairs of blocks,
    each a task. So a large group of close copies costs in proportion to its size.
    """
    spark = source.sparkSession

    def measured(batches):
        for batch in pieces(batches, PIECE):
            keys = band_keys(*shingle_hashes(*words_of(batch.column("text")), BAND_SHINGLE)).view(np.int64)
            fp = signed([of_shingles(t.encode().lower().split(), COPY_SHINGLE) for t in texts(batch.column("text"))])
            size = pa.array([len(t or "") for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.record_batch([batch.column("doc_id"), batch.column("node"), pa.array(fp), size, pa.array(list(keys), pa.list_(pa.int64()))], ["doc_id", "node", "fp", "size", "keys"])

    source = source.select("doc_id", "text", F.xxhash64("text").alias("node"))
    prints = checkpointed(source.mapInArrow(measured, "doc_id long, node long, fp long, size long, keys array<long>"))
    # documents with equal texts are one node
    nodes = checkpointed(prints.groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("first"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys")))
    groups = checkpointed(components(candidates(nodes)))
    clean(spark)
    groups = groups.join(nodes.select("node", "first", "size"), "node")
    parts_of = lambda rows=F.lit(True): F.ceil(F.greatest(F.count_if(rows) / COPY_BLOCK, F.sum(F.when(rows, F.col("size")).otherwise(0)) / COPY_BYTES)).cast("int")
    members = groups.join(small(checkpointed(groups.groupBy("component").agg(parts_of().alias("parts")))), "component")
    found = source.withColumn("first", F.coalesce("doc_id", F.lit(NO_ID))).join(members, ["node", "first"]).dropDuplicates(["node"]).select("node", "text", "size", "component", "parts")
    found = checkpointed(found)
    del members, groups
    nodes = checkpointed(nodes.select("node", "first"))
    prints = checkpointed(prints.select("doc_id", "node"))
    clean(spark)
    # a bucket has about one task's bytes, so buckets get more and not larger as the candidates do
    size = found.agg(F.sum("size")).first()[0] or 0
    buckets = max(4 * shuffle_partitions(spark), size // COPY_BYTES)

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("part_a", "ascending"), ("part_b", "ascending")])
        component, part_a, part_b, node = (table[c].to_numpy() for c in ("component", "part_a", "part_b", "node"))
        left, right, known = (table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("left", "right", "known"))
        new = np.ones(len(node), bool)
        new[1:] = (component[1:] != component[:-1]) | (part_a[1:] != part_a[:-1]) | (part_b[1:] != part_b[:-1])
        starts = np.flatnonzero(new)
        links = []
        for s, e in zip(starts, np.append(starts[1:], len(node))):
            own = copy_links(*words_of(table["text"].slice(s, e - s)), left[s:e], right[s:e], known[s:e])
            links += [(node[s + i], node[s + j]) for i, j in own]
        release()
        a, b = (np.array(links, np.int64).reshape(-1, 2)).T
        return pa.table({"a": a, "b": b})

    def compared(rows: DataFrame) -> DataFrame:
        """Links of ``component, part_a, part_b, node, text, left, right, known``; each (component, part_a, part_b) is a task's."""
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("component", "part_a", "part_b"), F.lit(buckets)).cast("int"))
        return rows.groupBy("bucket").applyInArrow(compare, "a long, b long")

    def task(rows: DataFrame, a, b, left, right, known) -> DataFrame:
        return rows.select("component", a.cast("int").alias("part_a"), b.cast("int").alias("part_b"), "node", "text", left.alias("left"), right.alias("right"), known.alias("known"))

    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    # each comparison is settled by itself, as the driver would hold the plans and tasks of all of them at once
    links = checkpointed(compared(task(found.where("parts = 1"), zero, zero, yes, yes, no)))
    clean(spark)
    large = found.where("parts > 1")
    if not large.isEmpty():
        # the leader of a group, its least node, goes to each of the group's parts
        leads, part = F.col("node") == F.col("component"), F.pmod(F.xxhash64("node"), F.col("parts"))
        leaders = large.where(leads).withColumn("part", F.explode(F.sequence(zero, F.col("parts") - 1)))
        stars = checkpointed(compared(task(leaders, F.col("part"), zero, yes, no, no).unionByName(task(large.where(~leads), part, zero, no, yes, no))))
        ends = checkpointed(stars.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("known", yes))
        clean(spark)
        marked = large.join(small(ends), "node", "left").withColumn("known", F.coalesce("known", leads))
        # the known of a group in blocks, and the others in blocks; pairs of blocks of the known alone need no task
        counts = marked.groupBy("component").agg(parts_of(F.col("known")).alias("n_known"), parts_of(~F.col("known")).alias("n_others"))
        marked = marked.join(small(checkpointed(counts)), "component").where("n_others > 0")
        block = F.pmod(F.xxhash64("node"), F.when(F.col("known"), F.col("n_known")).otherwise(F.col("n_others"))).cast("int")
        marked = marked.withColumn("block", block)
        others = marked.where("not known")
        # (other block, -1 - known block)
        rows = task(marked.where("known").withColumn("with", F.explode(F.sequence(zero, F.col("n_others") - 1))), F.col("with"), -1 - F.col("block"), no, yes, yes)
        rows = rows.unionByName(task(others.withColumn("with", F.explode(F.sequence(zero, F.col("n_known") - 1))), F.col("block"), -1 - F.col("with"), yes, no, no))
        # (other block, other block)
        both = others.withColumn("with", F.explode(F.sequence(zero, F.col("n_others") - 1)))
        low, high = F.least("block", "with"), F.greatest("block", "with")
        rows = rows.unionByName(task(both, low, high, F.col("block") == low, F.col("block") == high, no))
        links = links.unionByName(stars).unionByName(checkpointed(compared(rows)))
        clean(spark)
    return prints.select("doc_id", "node").join(named(nodes.select("node", "first"), links), "node").select("doc_id", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their class of near copies.

    Near copies are 0.8 alike or more in their five-word shingles: 0.8 of all are equal, or 0.4 are equal in texts of about one size and 0.8 of each text's are in the
    other but for one word (exactly: see ``copies``); texts of fewer words are one
    shingle, and null, empty and blank ones are copies of each other. The document with the class's smallest id
    stays; of rows that repeat that id, the one with the smallest text. Rows without an id can't be named
    by a class and stay. Texts of any length are compared whole. Columns may have any names. An empty table
    gives an empty result.
    """
    classes = copies(id_and_text(docs)).where("doc_id is not null")
    ids = checkpointed(classes.groupBy("doc_id").agg(F.max(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))).alias("stays"), F.count("*").alias("rows")).where("not stays or rows > 1"))
    gone = small(checkpointed(ids.select(F.col("doc_id").alias("gone_id"))))
    id_of = F.col("doc_id").cast("long")
    names = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.join(gone, id_of == F.col("gone_id"), "left_anti").select(*names)
    again = ids.where("stays").select(F.col("doc_id").alias("again_id"))
    if again.isEmpty():
        return kept
    # an id that is repeated: rare, so only these rows are ordered
    order = F.struct(F.col("text").cast("string"), F.xxhash64(*(c.cast("string") for c in names)))
    rows = docs.join(again, id_of == F.col("again_id"), "left_semi")
    return kept.unionByName(rows.groupBy(id_of.alias("again_id")).agg(F.min_by(F.struct(*names), order).alias("row")).select("row.*"))
