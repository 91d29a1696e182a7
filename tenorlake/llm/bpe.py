"""Byte-pair encoding of whole texts with a given vocabulary, and decoding.

Method: a segment tree over adjacent pair ranks. The leaves of a word's tree are the merge ranks of
its adjacent symbol pairs. The root tells the lowest rank, and going down to the left child where it
holds that rank leads to the leftmost such pair. A merge changes three leaves, each updated up to the
root in logarithmic time; it ends when no pair can be merged. The trees of all words of a batch that are
about as long lie in one array, so each step runs for all of them at once. Words that were encoded
before are taken from a bounded cache.

The vocabulary file is of the ``tokenizers`` library: BPE with an end-of-word suffix, a normalizer of
NFC, white space and lower case, and a pattern for words that are then mapped byte by byte.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .base import id_and_text, pieces, release, texts

#: Words that a task remembers; it starts again when there are more.
CACHE_WORDS = 250_000
#: From this many bytes on a word has a tree of its own.
LONG_WORD = 256
NONE = np.int32(2**31 - 1)
#: Code points that are letters or numbers only since Unicode 17, which the library's patterns don't know as such.
LATER = (
    "\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d\U000107bb-\U000107bf"
    "\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f"
    "\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff"
    "\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    "\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2"
    "\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    "\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Capitals that Python has no lower case for, and the library's distances to it.
LATER_LOWER = {0x1C89: 1, 0xA7CB: -42343, 0xA7CC: 1, 0xA7CE: 1, 0xA7D2: 1, 0xA7D4: 1, 0xA7DA: 1, 0xA7DC: -42561} | dict.fromkeys(range(0x10D50, 0x10D66), 32) | dict.fromkeys(range(0x16EA0, 0x16EB9), 27)
LOWER_TABLE = {c: c + d for c, d in LATER_LOWER.items()}
RARE = regex.compile("[" + LATER + "".join(map(chr, LATER_LOWER)) + "]")
_loaded: dict[str, Vocabulary] = {}


def byte_letters() -> dict[int, str]:
    """The letter of each byte in byte-level vocabularies: printable ones stand for themselves, the others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Vocabulary:
    """Symbols, merges and the word pattern of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for name, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = name
        self.name_bytes = [n.encode() for n in self.names]
        letters = byte_letters()
        # a byte inside a word and a byte at its end; -1: not in the vocabulary
        self.inner = np.array([vocab.get(letters[b], -1) for b in range(256)], np.int32)
        self.last = np.array([vocab.get(letters[b] + self.suffix, -1) for b in range(256)], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.ranks = pairs[order], order.astype(np.int32)
        self.rank_of: dict[int, int] | None = None
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # white space as the Unicode property has it
        self.words = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}"), regex.V0)
        later = pattern.replace(r"[^\s\p{L}\p{N}]+", rf"(?:[{LATER}]|[^\p{{White_Space}}\p{{L}}\p{{N}}])+").replace(r"[\p{L}]+", rf"(?:(?![{LATER}])\p{{L}})+").replace(r"[\p{N}]", rf"(?![{LATER}])\p{{N}}")
        self.words_later = regex.compile(later, regex.V0)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, tuple[bytes, bytes]] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where they don't merge or a side is missing."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NONE)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word (its bytes)."""
        out: list[list[int]] = [[]] * len(words)
        size = np.array([len(w) for w in words])
        width = np.where(size > 0, 1 << np.ceil(np.log2(np.maximum(size, 4))).astype(int), 0)
        for w in np.unique(width[width > 0]):
            group = np.flatnonzero(width == w)
            if w >= LONG_WORD:
                for i in group:
                    out[i] = self.encode_long(words[i])
                continue
            step = max(1, (1 << 17) // int(w))
            for k in range(0, len(group), step):
                own = group[k : k + step]
                for i, x in zip(own.tolist(), self.encode_group([words[j] for j in own], int(w))):
                    out[i] = x
        return out

    def encode_long(self, word: bytes) -> list[int]:
        """One long word, by a tree of its own."""
        data = np.frombuffer(word, np.uint8)
        symbol = self.inner[data]
        symbol[-1] = self.last[data[-1]]
        symbol = symbol[symbol >= 0]
        n = len(symbol)
        width = 1 << max(1, int(n).bit_length())
        tree = np.full(2 * width, NONE, np.int32)
        tree[width : width + n - 1] = self.rank(symbol[:-1], symbol[1:])
        for level in (1 << k for k in range(width.bit_length() - 2, -1, -1)):
            tree[level : 2 * level] = np.minimum(tree[2 * level : 4 * level : 2], tree[2 * level + 1 : 4 * level : 2])
        tree, symbol, none = tree.tolist(), symbol.tolist(), int(NONE)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        if self.rank_of is None:
            self.rank_of = dict(zip(self.pairs.tolist(), self.ranks.tolist()))

        def put(at: int, value: int) -> None:
            at += width
            tree[at] = value
            while at > 1:
                at >>= 1
                tree[at] = min(tree[2 * at], tree[2 * at + 1])

        while tree[1] < none:
            rank, at = tree[1], 1
            while at < width:
                at *= 2
                at += tree[at] != rank
            at -= width
            right = after[at]
            beyond = after[right]
            symbol[at], symbol[right], after[at] = int(self.merged[rank]), -1, beyond
            put(right, none)
            if beyond < n:
                before[beyond] = at
                put(at, self.rank_of.get(symbol[at] << 32 | symbol[beyond], none))
            else:
                put(at, none)
            if before[at] >= 0:
                put(before[at], self.rank_of.get(symbol[before[at]] << 32 | symbol[at], none))
        return [x for x in symbol if x >= 0]

    def encode_group(self, words: list[bytes], width: int) -> list[list[int]]:
        n = len(words)
        size = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        column = np.arange(width)
        symbol = np.where(column < size[:, None], self.inner[data], -1)
        symbol[np.arange(n), size - 1] = self.last[data[np.arange(n), size - 1]]
        if (symbol[column < size[:, None]] < 0).any():  # bytes that the vocabulary lacks leave no symbol
            for i in np.flatnonzero(((symbol < 0) & (column < size[:, None])).any(axis=1)):
                have = symbol[i][symbol[i] >= 0]
                symbol[i] = -1
                symbol[i, : len(have)] = have
                size[i] = len(have)
        after = np.where(column + 1 < size[:, None], column + 1, width).astype(np.int32)
        before = np.broadcast_to(column - 1, (n, width)).astype(np.int32)
        tree = np.full((n, 2 * width), NONE, np.int32)
        tree[:, width : 2 * width - 1] = self.rank(symbol[:, :-1], symbol[:, 1:])
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            rank = tree[live, 1]
            at = np.ones(len(live), np.int64)
            while at[0] < width:
                at *= 2
                at += tree[live, at] != rank
            at -= width
            right = after[live, at]
            beyond = after[live, right]
            symbol[live, at] = self.merged[rank]
            symbol[live, right] = -1
            after[live, at] = beyond
            inside = beyond < width
            before[live[inside], beyond[inside]] = at[inside]
            end = np.minimum(beyond, width - 1)
            fresh = np.where(inside, self.rank(symbol[live, at], symbol[live, end]), NONE)
            left = before[live, at]
            has_left = left >= 0
            prior = np.maximum(left, 0)
            left_rank = np.where(has_left, self.rank(symbol[live, prior], symbol[live, at]), NONE)
            self.update(tree, live, right + width, np.full(len(live), NONE, np.int32))
            self.update(tree, live, at + width, fresh)
            self.update(tree, live[has_left], prior[has_left] + width, left_rank[has_left])
            live = live[tree[live, 1] < NONE]
        whole = symbol >= 0
        ids = symbol[whole].tolist()
        ends = np.cumsum(whole.sum(axis=1)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    @staticmethod
    def update(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        at = leaf.astype(np.int64)
        tree[rows, at] = value
        while len(at) and at[0] > 1:
            at >>= 1
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

    def split(self, text: str) -> list[str]:
        """The words of a text, and special tokens as they are, in order."""
        if self.specials and "<|" in text:
            out = []
            for i, part in enumerate(self.specials.split(text)):
                out += [part] if i % 2 else self.find(part)
            return out
        return self.find(text)

    def find(self, text: str) -> list[str]:
        if not text.isascii() and RARE.search(text):
            return self.words_later.findall(normalized(text).translate(LOWER_TABLE))
        return self.words.findall(normalized(text))

    def learn(self, words: set[str]) -> None:
        """Puts all of ``words`` into the cache."""
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = list(words)
        plain = [w for w in new if w not in self.special]
        for w in new:
            if w in self.special:
                self.cache[w] = (self.special[w].to_bytes(4, "little"), w.encode())
        for w, ids in zip(plain, self.encode_words([w.encode() for w in plain])):
            self.cache[w] = (struct.pack(f"<{len(ids)}I", *ids), b" ".join([self.name_bytes[i] for i in ids]))

    def decode(self, ids: list[int]) -> str:
        """The names of the ids, joined by one space (the file has no decoder)."""
        return " ".join([self.names[i] for i in ids])


def normalized(text: str) -> str:
    """NFC and lower case, each character by itself; white space never reaches a word."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


def load(path: str) -> Vocabulary:
    """The vocabulary, once in each Python process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids array<int>, decoded`` for every row of ``docs``.

    With ``digests`` the last two are ``ids_sha256, decoded_sha256`` (of the ids as little-endian
    unsigned 32-bit integers, and of the decoded text in UTF-8). A null text is empty: no ids, and the
    decoded text is empty. Ids are carried as they are, null and repeated ones too; other columns are
    ignored. Texts and words of any length are encoded whole. An empty table gives an empty result. ``path`` is
    read in each task and must exist there.
    """

    def of(batches):
        vocabulary = load(path)
        for batch in pieces(batches):
            words = [vocabulary.split(t) for t in texts(batch.column("text"))]
            vocabulary.learn(set().union(*words))
            get = vocabulary.cache.__getitem__
            n, ids, decoded = [], [], []
            for own in words:
                parts = [get(w) for w in own]
                raw = b"".join([x[0] for x in parts])
                text = b" ".join([x[1] for x in parts if x[0]])
                n.append(len(raw) // 4)
                ids.append(hashlib.sha256(raw).hexdigest() if digests else np.frombuffer(raw, "<u4").astype(np.int32))
                decoded.append(hashlib.sha256(text).hexdigest() if digests else text.decode())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string() if digests else pa.list_(pa.int32())), pa.array(decoded, pa.string())], names)
        vocabulary.cache.clear()
        release()

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, n_tokens long, ids array<int>, decoded string"
    return id_and_text(docs, id_col, text_col).mapInArrow(of, kinds)
