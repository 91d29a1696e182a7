"""Secrets in whole texts: keyword prefilter, anchored patterns near hits, embedded checksums.

Method: one Aho-Corasick pass over the text (A-Z in lower case) finds keywords; a pattern is tried
only where a keyword begins. Tokens that carry a checksum of their own (the six last base-62 digits
are the CRC-32 of what stands before them) are reported only if it is right. Runs of hexadecimal
digits have no keyword; for them the pattern itself is the scan.
"""

from __future__ import annotations

import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import id_and_text, pieces, texts

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Prefixes of tokens that end in a checksum, and the length of what follows the prefix.
CHECKED = {"ghp_": 36, "gho_": 36, "ghu_": 36, "ghs_": 36, "ghr_": 36, "npm_": 36}
CHECKED_TAIL = re.compile(r"[A-Za-z0-9]+")
#: Base-62 digits in the order of their values.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: The kinds in the order that decides between spans with one start.
KINDS = ("assign", "access", "hex", "checked")
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "api_key": "assign", "apikey": "assign", "akia": "access"} | dict.fromkeys(CHECKED, "checked")

_machine: ahocorasick.Automaton | None = None


def machine() -> ahocorasick.Automaton:
    global _machine
    if _machine is None:
        _machine = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            _machine.add_word(word, (kind, len(word)))
        _machine.make_automaton()
    return _machine


def checksum_holds(token: str) -> bool:
    """Are the last six base-62 digits the CRC-32 of the rest of what follows the prefix?"""
    body, tail = token[4:-6], token[-6:]
    value = zlib.crc32(body.encode())
    digits = ""
    while value:
        value, digit = divmod(value, 62)
        digits = DIGITS[digit] + digits
    return digits.rjust(6, "0") == tail


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points by start, then by kind. Spans of one kind don't overlap."""
    lower = text.lower() if text.isascii() else text.encode().lower().decode()
    found = [("hex", *m.span()) for m in HEX.finditer(text)]
    hits: dict[str, list[int]] = {}
    for end, (kind, n) in machine().iter(lower):
        hits.setdefault(kind, []).append(end - n + 1)
    for kind, pattern, value, least in (("assign", ASSIGN, 1, 12), ("access", ACCESS, 0, 18)):
        free = 0
        for start in sorted(hits.get(kind, ())):
            if start >= free and (m := pattern.match(text, start)):
                free = m.end()
                if len(m[value]) >= least:
                    found.append((kind, start, free))
    for start in hits.get("checked", ()):
        prefix = text[start : start + 4]
        tail = CHECKED_TAIL.match(text, start + 4)
        if prefix in CHECKED and tail and len(tail[0]) == CHECKED[prefix] and not text[start - 1 : start].isalnum() and checksum_holds(prefix + tail[0]):
            found.append(("checked", start, tail.end()))
    if len(found) > 1:
        found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return found


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans array<struct<kind, start, end>>`` for every row of ``docs``, spans in order.

    A null text is empty and has no spans. Ids are carried as they are, null and repeated ones too;
    texts of any length are scanned whole; other columns are ignored. An empty table gives an empty result.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def of(batches):
        for batch in pieces(batches):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t)] for t in texts(batch.column("text"))]
            yield pa.record_batch([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(of, "doc_id long, spans array<struct<kind string, start long, end long>>")


def redact(text: str) -> str:
    """The text with every secret replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    spans = find_secrets(text)
    i = 0
    while i < len(spans):
        kind, start, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += text[at:start], f"[{kind}]"
        at = end
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs``, all columns, with every secret in the text replaced by its kind in brackets.

    ``size_col``, if it is there and was not null, becomes the new number of characters of a changed text.
    A null text stays null, an empty one empty. Repeated rows are changed alike; an id plays no part, so it may
    be null. Texts of any length are scanned whole. Other columns may have any names and stay as they are.
    An empty table gives an empty result.
    """
    at = docs.columns.index(text_col)
    size = docs.columns.index(size_col) if size_col in docs.columns else None

    def of(batches):
        for batch in pieces(batches, text=text_col):
            before = batch.column(at).to_pylist()
            after = [None if t is None else redact(t) for t in before]
            columns = list(batch.columns)
            columns[at] = pa.array(after, columns[at].type)
            if size is not None:
                columns[size] = pa.array([n if n is None or a == b else len(b) for n, a, b in zip(columns[size].to_pylist(), before, after)], columns[size].type)
            yield pa.record_batch(columns, schema=batch.schema)

    return docs.mapInArrow(of, docs.schema)
