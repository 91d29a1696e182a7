"""Tokens, secrets, perplexity, contamination, classifiers, URLs and revisits."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tenorlake.llm import decontamination as gst
from tenorlake.llm import ngram_perplexity as ppl
from tenorlake.llm import quality_qda as qda
from tenorlake.llm import secrets as sec
from tenorlake.llm import toxicity as tox
from tenorlake.llm import url_filter as urls
from tenorlake.llm.bpe import encode_documents, load
from tenorlake.llm.queries import URL_RULES, WORD_BPE
from tenorlake.llm.warc_revisits import canonical_url, resolve_revisits

from .conftest import ODD

TOKENS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
SAMPLES = [":\U0003d000 ab\u0c5cc \U00011de0 \ua7ceX \u1c89 \U00010d50", "it's we're don't", "İstanbul ΣΑΣ ς é", "<|endoftext|>X <|startoftext|> <|endoftext", "x" * 700 + " " + "ab" * 300, "漢字かな 한글 🎉 ½ 1234", "\x1c a\x85b\u3000c", ""]


def key(x):
    return tuple((v is None, str(v)) for v in x)


def test_tokens_match_the_library(make):
    rows = [r[:2] for r in ODD] + [(100 + i, t) for i, t in enumerate(SAMPLES)]
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_documents(make(rows), WORD_BPE, digests=True).collect()]
    want = []
    for d, t in rows:
        ids = TOKENS.encode(t or "", add_special_tokens=False).ids
        text = TOKENS.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(got, key=key) == sorted(want, key=key)
    plain = {r.doc_id: r for r in encode_documents(make([(1, "Hello there")]), WORD_BPE).collect()}
    assert list(plain[1].ids) == TOKENS.encode("Hello there", add_special_tokens=False).ids and plain[1].decoded == load(WORD_BPE).decode(plain[1].ids)
    assert encode_documents(make([]), WORD_BPE).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_encoded_as_the_library_does(text):
    vocabulary = load(WORD_BPE)
    words = vocabulary.split(text)
    vocabulary.learn(set(words))
    ids = np.frombuffer(b"".join(vocabulary.cache[w][0] for w in words), "<u4").tolist()
    assert ids == TOKENS.encode(text, add_special_tokens=False).ids


def slow_secrets(t):
    any_case = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join([*map(any_case, ("password", "passwd", "secret", "token")), any_case("api") + "_?" + any_case("key")])
    found = [("assign", *m.span()) for m in re.finditer(f"({names})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(found, key=lambda x: (x[1], sec.KINDS.index(x[0])))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["password", "PASSWD", "Token", "api_key", "apikey", "secret", "AKIA", "ABCDEF0123456789", "0123456789abcdef", " ", "=", ":", '"', "'", "ſ", "é", "zzzzzz", "_", "/", "\n"]), max_size=14))
def test_base_spans_match_the_patterns(parts):
    text = "".join(parts)
    assert [s for s in sec.find_secrets(text) if s[0] != "checked"] == slow_secrets(text)


def test_checksums_decide_and_redaction_hides(make):
    body = "ghp_" + "aB3" * 10
    value, digits = zlib.crc32(body[4:].encode()), ""
    while value:
        value, d = divmod(value, 62)
        digits = sec.DIGITS[d] + digits
    good = body + digits.rjust(6, "0")
    bad = good[:-1] + ("1" if good[-1] != "1" else "2")
    assert [s[0] for s in sec.find_secrets(f"see {good}, {bad}, x{good}")] == ["checked"]
    rows = [*(r[:2] for r in ODD), (50, f"token = abcdefghijklmnop {good}")]
    out = {r.doc_id: r for r in sec.redact_documents(make(rows)).collect()}
    assert out[50].text == "[assign] [checked]" and out[50].n_chars == len(out[50].text) and out[1].text is None and out[5].text == "word " * 30000
    assert len(sec.scan_secrets(make(rows)).collect()) == len(rows) and sec.scan_secrets(make([])).collect() == []


def test_base_rules_match_brute_force(make):
    rng = random.Random(1)
    rows = [r for r in ODD] + [(60 + i, "\n".join(rng.choice(["a b c", "a b c", "# x|y", "", "ü ü ü ü", "z q r s t"]) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None])) for i in range(30)]
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in ppl.perplexity_rules(make(rows)).collect()]
    want = []
    for d, t, *_ in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        seen, again = set(), 0
        for line in t.split("\n"):
            if re.search("[^\x20\x09-\x0d]", line):
                again += line in seen
                seen.add(line)
        counts = collections.Counter(zip(w, w[1:], w[2:]))
        covered = [False] * len(w)
        for i in range(len(w) - 2):
            if counts[tuple(w[i : i + 3])] > 1:
                covered[i : i + 3] = [True] * 3
        n = sum(covered)
        want.append((d, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), again, n, len(w) < 50 or 100 * n > 50 * len(w)))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert ppl.perplexity_rules(make([])).collect() == []


def slow_discounts(counts):
    n = [sum(c == i for c in counts) for i in range(5)]
    if not n[1] or not n[2]:
        return [0, 0.5, 0.5, 0.5]
    y = n[1] / (n[1] + 2 * n[2])
    return [0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k) if n[k] else 0.5 for k in (1, 2, 3)]


def slow_model(counts, kinds):
    """Modified Kneser-Ney by recursion over {n-gram: count}."""
    order = max(map(len, counts), default=5)
    levels = {order: collections.Counter(counts)}
    for k in range(order - 1, 0, -1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    d = {k: slow_discounts(list(v.values())) for k, v in levels.items()}

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (kinds + 1)
        row = [c for g, c in levels[k].items() if g[:-1] == gram[:-1]]
        if not row:
            return p(gram[1:])
        c = levels[k][gram]
        return (max(c - d[k][min(c, 3)], 0) + sum(d[k][min(x, 3)] for x in row) * p(gram[1:])) / sum(row)

    return p


def test_bits_and_bands_match_brute_force(make, spark):
    rng = random.Random(5)
    words = ["the", "rain", "ünd", "сад", "in", "of", "\x00x", "漢字", "A"]
    rows = [r for r in ODD if r[0] != 5] + [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))), rng.choice(["en", "en", "de", None])) for i in range(60)]
    rows.append(rows[-1])
    docs = make(rows)
    fold = {r.text: r.f for r in docs.selectExpr("text", "pmod(xxhash64(text), 2) f").collect()}
    got = ppl.perplexity_rules(docs).collect()
    lang = lambda r: r[2] if len(r) > 2 else "en"
    want = {}
    for name in {lang(r) for r in rows}:
        own = [(r, (r[1] or "").replace("\0", "\ufffd")) for r in rows if lang(r) == name]
        counts = {0: collections.Counter(), 1: collections.Counter()}
        for r, t in own:
            counts[fold[r[1]]].update(("\0" * 4 + t)[i : i + 5] for i in range(len(t)))
        kinds = len(set("".join(t for _, t in own)))
        models = {f: slow_model(c, kinds) for f, c in counts.items()}
        known = {}
        bits = []
        for r, t in own:
            f = 1 - fold[r[1]]
            value = 0
            for i in range(len(t)):
                g = ("\0" * 4 + t)[i : i + 5]
                if (f, g) not in known:
                    known[f, g] = models[f](g)
                value -= math.log2(known[f, g])
            bits.append((r[0], len(t), value / len(t) if t else None))
        for d, n, b in bits:
            want.setdefault(d, []).append((n, b, name))
    for r in got:
        options = want[r.doc_id]
        assert any((b is None) == (r.bits is None) and (b is None or abs(b - r.bits) < 1e-5) for _, b, _ in options), (r, options)
    # the bands from the bits themselves
    for name in {lang(r) for r in rows}:
        own = sorted(b for v in want.values() for n, b, x in v if x == name and b is not None)
        if not own:
            continue
        middle = float(np.median(own))
        away = [abs(b - middle) * math.sqrt(n) for v in want.values() for n, b, x in v if x == name and b is not None]
        spread = max(1.4826 * float(np.median(away)), ppl.LEAST_SPREAD)
        for r in got:
            for n, b, x in want[r.doc_id]:
                if x == name and b is not None and len(want[r.doc_id]) == 1 and n:
                    wide = ppl.FENCE * spread / math.sqrt(n)
                    assert abs(r.low - (middle - wide)) < 0.02 + 0.03 * wide and abs(r.high - (middle + wide)) < 0.02 + 0.03 * wide


def test_wide_alphabets_are_compared_as_strings():
    texts = ["".join(chr(0x4E00 + (i * 37 + k * k) % 9000) for i in range(4000)) for k in range(3)] + ["ab", ""]
    held = [ppl.Held([ppl.points_of(own)[0] for own in (texts[:2], texts[2:])], 3) for _ in range(2)]
    assert not held[0].grams.fits
    want = collections.Counter(("\0" * 4 + t)[i : i + 5] for t in texts for i in range(len(t)))
    assert dict(zip(ppl.strings(held[0].points).to_pylist(), held[0].counts.tolist())) == want
    small = ppl.Held([ppl.points_of(["abcabc", "ab", "é"])[0]], 3)
    assert small.grams.fits and dict(zip(ppl.strings(small.points).to_pylist(), small.counts.tolist())) == collections.Counter(("\0" * 4 + t)[i : i + 5] for t in ["abcabc", "ab", "é"] for i in range(len(t)))


def test_perplexity_bands_reject_noise_and_keep_prose(make):
    rng = random.Random(5)
    part = lambda lang: rng.choice({"en": ("the", "an", "re", "in", "st", "ing", "er", "ed", "ly", "or"), "es": ("ción", "de", "que", "lla", "mente", "os", "ar", "ía")}[lang])
    text = lambda lang: " ".join("".join(part(lang) for _ in range(rng.randrange(1, 4))) for _ in range(150)) + "."
    prose = [(i, text(lang), lang) for i, lang in enumerate(["en"] * 150 + ["es"] * 60)]
    letters = lambda abc: " ".join("".join(rng.choice(abc) for _ in range(6)) for _ in range(100))
    noise = [(500 + i, letters("abcdefghijklmnopqrstuvwxyz"), "en") for i in range(4)] + [(510 + i, letters("абвгдежзиклмнопрст"), "en") for i in range(4)]
    noise += [(520, letters("あいうえおかきくけこ"), "es"), (530, text("es"), "en"), (531, text("en"), "es")]
    # a thousand languages cost no more than their documents
    many = [(1000 + i, text("en"), f"x{i}") for i in range(300)]
    got = {r.doc_id: r for r in ppl.perplexity_rules(make(prose + noise + many)).collect()}
    assert not any(got[d].base_failed for d, *_ in prose + noise)
    assert [d for d, *_ in noise if got[d].kept] == []
    assert sum(got[d].kept for d, *_ in prose) >= 0.98 * len(prose) and all(got[d].kept for d, *_ in many)


def slow_tiles(doc, item, least):
    """Greedy string tiling by search over all pairs."""
    a_used, b_used, out = [False] * len(doc), [False] * len(item), []
    while True:
        best = None
        for b in range(len(item)):
            for a in range(len(doc)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and not a_used[a + n] and not b_used[b + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (a, b, n)
        if best is None:
            return out
        a, b, n = best
        a_used[a : a + n] = [True] * n
        b_used[b : b + n] = [True] * n
        out.append(best)


def test_tiles_match_brute_force_and_catch_reordering(make, spark):
    rng = random.Random(6)
    items = [[f"t{rng.randrange(40)}" for _ in range(30)] for _ in range(4)]
    docs = []
    for d in range(100, 124):
        item = rng.choice(items)
        cut = rng.randrange(6, 24)
        parts = [item[cut:], item[:cut]] if d % 2 else [item[: rng.randrange(3, 30)]]
        text = []
        for part in parts:
            text += part + [f"u{rng.randrange(9)}" for _ in range(rng.randrange(1, 5))]
        docs.append((d, " ".join(text)))
    rows = [r[:2] for r in ODD] + docs
    bench = spark.createDataFrame([(i, " ".join(x).upper() + ".") for i, x in enumerate(items)] + [(90, None), (91, "too short"), (0, " ".join(items[0]).upper() + ".")], "item_id long, text string")
    got = {r.doc_id: r for r in gst.find_contamination(make(rows), bench).collect()}
    for d, text in docs:
        found = []
        for i, item in enumerate(items):
            tiles = slow_tiles(text.split(), item, 5)
            if sum(t[2] for t in tiles) >= 0.5 * len(item):
                found.append((i, sum(t[2] for t in tiles) / len(item), len(tiles)))
        assert list(got[d].item_ids) == [f[0] for f in found] and got[d].contaminated == bool(found)
        if found:
            assert abs(got[d].coverage - max(f[1] for f in found)) < 1e-12
    assert sum(got[d].contaminated for d, _ in docs) > 12
    kept = gst.drop_contaminated(make(rows), bench)
    assert kept.columns == make(rows).columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(d or -1 for d, _ in rows if not (d in got and d is not None and got[d].contaminated))
    empty = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in gst.find_contamination(make(rows), empty).collect()) and gst.find_contamination(make([]), bench).collect() == []


def test_a_copy_of_a_repetitive_item_is_found(make, spark):
    phrase = "one two three four five "
    bench = spark.createDataFrame([(1, phrase * 30), (2, phrase * 3 + " ".join(f"w{i}" for i in range(200)))], "item_id long, text string")
    got = {r.doc_id: r for r in gst.find_contamination(make([(1, phrase * 30), (2, "before " + phrase * 16 + "after"), (3, phrase * 14)]), bench).collect()}
    assert [(list(got[d].item_ids), got[d].coverage) for d in (1, 2, 3)] == [([1], 1.0), ([1], 80 / 150), ([], 0.0)]


def test_tiling_of_repetitive_texts():
    def seeds(words):
        return np.array([hash(tuple(words[i : i + gst.SEED])) for i in range(len(words) - gst.SEED + 1)])

    rng = random.Random(8)
    for _ in range(40):
        doc, item = ([rng.choice("ab") for _ in range(rng.randrange(6, 25))] for _ in range(2))
        s = seeds(doc)
        have = np.isin(s, seeds(item))
        got = gst.tile(np.flatnonzero(have), s[have], seeds(item))
        want = slow_tiles(doc, item, gst.SEED)
        assert sorted(t[2] for t in got) == sorted(t[2] for t in want)


def test_repetitive_texts_through_the_operator_match_brute_force(make, spark):
    rng = random.Random(11)
    text = lambda letters, n: [rng.choice(letters) * 2 for _ in range(rng.randrange(5, n))]
    items = [text("abc"[: rng.randrange(1, 4)], 40) for _ in range(25)]
    docs = [text("abcd"[: rng.randrange(1, 5)], 60) for _ in range(60)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: r for r in gst.find_contamination(make([(d, " ".join(x)) for d, x in enumerate(docs)]), bench).collect()}
    for d, doc in enumerate(docs):
        tiles = {i: slow_tiles(doc, item, gst.SEED) for i, item in enumerate(items)}
        covered = {i: sum(t[2] for t in x) / len(items[i]) for i, x in tiles.items()}
        found = sorted(i for i, c in covered.items() if c >= gst.COVERAGE)
        assert list(got[d].item_ids) == found, d
        assert abs(got[d].coverage - max((covered[i] for i in found), default=0)) < 1e-12


def test_tiling_of_long_repetitive_texts_takes_little_memory():
    import tracemalloc

    item = np.arange(5, dtype=np.int64)[np.arange(996) % 5]
    doc = np.arange(5, dtype=np.int64)[np.arange(200_000) % 5]
    tracemalloc.start()
    got = gst.tile(np.arange(len(doc)), doc, item)
    assert got == [(0, 0, 1000)] and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def corpus(rng, n):
    rows, labels = [], []
    for d in range(n):
        good, toxic = d % 3 > 0, d % 4 == 0
        words = [rng.choice(["rain", "field", "stone", "river", "light", "corn"]) + rng.choice(["s", "", "ed", "ing"]) for _ in range(60)]
        if not good:
            words = [words[0]] * 60 if d % 2 else [w + "###" for w in words]
        if toxic:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["vilest", "V1LEST", "vіlest!", "vilest,"])
        rows.append((d, " ".join(words)))
        labels.append((d, int(good), int(toxic)))
    return rows, labels


def test_classifiers_learn_only_from_what_they_may(make, labels_of):
    rows, labels = corpus(random.Random(9), 300)
    docs = make(rows + [r[:2] for r in ODD if r[0] is None or r[0] > 1000])
    held = {d for d, _ in rows if zlib.crc32(str(d).encode()) % 5 == 0}
    flipped = [(d, 1 - q, 1 - t) if d in held else (d, q, t) for d, q, t in labels]
    for score, at in ((qda.score_quality, 1), (tox.score_toxicity, 2)):
        got = {r.doc_id: r for r in score(docs, labels_of(labels)).collect()}
        assert {d for d, r in got.items() if r.held_out} == held
        right = [got[x[0]].predicted == x[at] for x in labels if x[0] in held]
        assert sum(right) / len(right) > 0.95
        assert all(0 <= r.score <= 1 for r in got.values())
        again = {r.doc_id: r.score for r in score(docs, labels_of(flipped)).collect()}
        assert all(abs(again[d] - got[d].score) < 1e-9 for d in again)


def test_classifiers_take_odd_rows_and_no_labels(make, labels_of):
    odd = make([r[:2] for r in ODD])
    strange = labels_of([(4, 1, 1), (4, 0, 0), (None, 1, 0), (2, None, None), (6, 3, 9)])
    for score in (qda.score_quality, tox.score_toxicity):
        rows = score(odd, strange).collect()
        assert len(rows) == len(ODD) and all(r.score == 0.5 for r in rows)
        assert score(make([]), labels_of([])).collect() == []
    kept = qda.keep_good(odd, strange)
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_quality_matches_a_plain_discriminant(make, labels_of):
    rows, labels = corpus(random.Random(19), 200)
    rows.append((500, None))
    x = qda.statistics(__import__("pyarrow").array([t for _, t in rows]))
    y = {d: q for d, q, _ in labels if zlib.crc32(str(d).encode()) % 5}
    own = {k: x[[i for i, (d, _) in enumerate(rows) if y.get(d) == k]] for k in (0, 1)}
    n = {k: len(v) for k, v in own.items()}
    spread = {k: np.cov(v.T, bias=True) for k, v in own.items()}
    pooled = sum(n[k] * spread[k] for k in (0, 1)) / sum(n.values()) + 1e-4 * np.eye(x.shape[1])
    log = {}
    for k in (0, 1):
        cov = (1 - qda.POOLED - qda.DIAGONAL) * spread[k] + qda.POOLED * pooled + qda.DIAGONAL * np.diag(np.diag(pooled))
        away = x - own[k].mean(axis=0)
        log[k] = np.log((n[k] + 1) / (sum(n.values()) + 2)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away)
    want = 1 / (1 + np.exp(np.clip(log[0] - log[1], -30, 30)))
    got = {r.doc_id: r.score for r in qda.score_quality(make(rows), labels_of(labels)).collect()}
    assert all(abs(got[d] - w) < 1e-6 for (d, _), w in zip(rows, want))
    kept = {r.doc_id for r in qda.keep_good(make(rows), labels_of(labels)).collect()}
    assert kept == {d for (d, _), w in zip(rows, want) if w >= 0.3}


def slow_hits(lexicon, text):
    """Hits by trying every entry at every beginning of a word."""
    line, found, calm = tox.folded(text), {}, []
    for at in range(len(text)):
        if at and text[at - 1].isalnum():
            continue
        for term, weight in lexicon.weights.items():
            n = at + len(term.rstrip("*"))
            if line.startswith(term.rstrip("*"), at) and (term.endswith("*") or n >= len(text) or not text[n].isalnum()):
                found[at] = max(weight, found.get(at, 0))
        for phrase in lexicon.exceptions:
            n = at + len(phrase)
            if line.startswith(phrase, at) and (n >= len(text) or not text[n].isalnum()):
                calm.append((at, n))
    return {at: w for at, w in found.items() if not any(a <= at < b for a, b in calm)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["trash", "TR4$H", "tra", "trаsh", "can", " ", " ", "vile", "vilest", "x", "!", ", ", "é", "bin"]), max_size=16))
def test_hits_match_string_search(parts):
    text = "".join(parts)
    lexicon = tox.Lexicon({tox.folded(k): v for k, v in {"trash": 2.0, "vile*": 1.5, "tra*": 0.5, "can": 1.0}.items()}, (tox.folded("trash can"), tox.folded("bin trash")))
    assert lexicon.hits(text) == slow_hits(lexicon, text)


def test_exceptions_are_learned_from_clean_texts(make, labels_of):
    rng = random.Random(21)
    rows, labels = (x[1::3] + x[2::3] for x in corpus(rng, 600))
    rows = [(d, t + (" the vilest weather" if not y and d % 3 == 1 else "")) for (d, t), (_, _, y) in zip(rows, labels)]
    rows += [(1001, "river vilest weather here"), (1002, "river vilest stone vilest here")]
    got = {r.doc_id: r.score for r in tox.score_toxicity(make(rows), labels_of(labels)).collect()}
    assert got[1001] < 0.2 < got[1002]
    held = [(d, y) for d, _, y in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum((got[d] >= 0.5) == bool(y) for d, y in held) > 0.95 * len(held)


def test_exceptions_and_folding():
    lexicon = tox.Lexicon({"trash": 2.0, "vilest": 1.0, tox.folded("bomen") + "*": 3.0}, ("trash can",))
    lexicon = tox.Lexicon({tox.folded(k.rstrip("*")) + "*" * k.endswith("*"): v for k, v in lexicon.weights.items()}, lexicon.exceptions)
    assert lexicon.hits("the trash can") == {} and lexicon.hits("TR4$H here") == {0: 2.0}
    assert lexicon.hits("a vіlest### xvilest vilestly") == {2: 1.0} and lexicon.hits("bomentes") == {0: 3.0}
    assert all(len(tox.folded(t)) == len(t) for t in ("İstanbul", "ẞ1", "ŉ"))


def test_learned_weights_exceptions_and_scores_match_plain_python(make, labels_of):
    """Document frequencies by splitting and slicing, log-odds by their formula, and the regression by its gradient."""
    rng = random.Random(21)
    calm, nasty = [f"word{i}" for i in range(40)], ["Trashy", "vіlest", "id1ot", "scumbags"]
    rows, labels = [], []
    for i in range(400):
        y = int(i % 4 == 0)
        words = [rng.choice(calm) for _ in range(rng.randrange(3, 60))]
        for _ in range(rng.randrange(1, 5) if y else rng.random() < 0.08):
            words.insert(rng.randrange(len(words)), rng.choice(nasty) + rng.choice(["", "!", "..."]))
        if not y and i % 7 == 1:
            words += ["trashy", "novel"]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, y))
    got = tox.score_toxicity(make(rows), labels_of(labels)).collect()
    learn = [(t, y) for (d, t), (_, _, y) in zip(rows, labels) if zlib.crc32(str(d).encode()) % 5]

    def slow_terms(text):
        out = set()
        for word in text.split():
            word = re.sub(r"^[\W_]+|[\W_]+$", "", word)
            if len(word) >= 3:
                word = tox.folded(word)
                out |= {word} | {word[:k] + "*" for k in range(4, 9) if k < len(word)}
        return out

    n = {y: sum(b == y for _, b in learn) for y in (0, 1)}
    found = {y: collections.Counter(t for text, b in learn if b == y for t in slow_terms(text)) for y in (0, 1)}
    odds = lambda y, k: math.log((k + 0.5) / (n[y] - k + 0.5))
    weights = {}
    for term, t in found[1].items():
        c = found[0][term]
        w = odds(1, t) - odds(0, c)
        if t >= 5 and w >= 1 and w / math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)) >= 3.5:
            weights[term] = w
    assert tox.folded("trashy") in weights
    lexicon = tox.Lexicon(weights)
    near = {0: collections.Counter(), 1: collections.Counter()}
    for text, y in learn:
        words = [(m.start(), tox.folded(m[0])) for m in re.finditer(r"[^\W_]+", text)]
        hits = lexicon.hits(text)
        near[y].update({f"{u} {v}" for (a, u), (b, v) in zip(words, words[1:]) if a in hits or b in hits})
    calm_phrases = []
    for phrase, c in near[0].items():
        t = near[1][phrase]
        if c >= 5 and (odds(0, c) - odds(1, t)) / math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)) >= 2:
            calm_phrases.append(phrase)
    assert calm_phrases
    lexicon = tox.Lexicon(weights, tuple(sorted(calm_phrases)))

    def features(text):
        own = lexicon.hits(text).values()
        return [1.0, math.log1p(sum(own)), math.log1p(1000 * sum(own) / len(text.split())), max(own)] if own else [1.0, 0.0, 0.0, 0.0]

    x, y = np.array([features(t) for t, _ in learn]), np.array([b for _, b in learn])
    beta = np.zeros(4)
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x.T * (p * (1 - p))) @ x + np.eye(4), x.T @ (y - p) - beta)
    by = {r.doc_id: r for r in got}
    for d, text in rows:
        want = 1 / (1 + math.exp(-float(np.dot(features(text), beta))))
        assert abs(by[d].score - want) < 1e-6 and by[d].predicted == int(by[d].score >= 0.5)
        assert by[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0)


def slow_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :], re.S)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len) if fits else None


def test_url_rules_and_scores(spark):
    rng = random.Random(11)
    rows = [(None, "http://x.net/"), (1, None), (2, ""), (3, "no scheme.net/"), (4, "HTTP://A.Example.NET/en/x?y#z"), (5, "http://net"), (6, "ftp://é.org/fr/\n?"), (7, "a://b://c.net/"), (8, "http://org/fr/"), (9, "http://u.com#/x"), (9, "http://u.com#/x")]
    for i in range(20, 420):
        rows.append((i, f"https://{rng.choice(['casino-win', 'bets-free', 'cheap-pills'])}{i % 7}.example.net/de/{i}" if i % 2 else f"https://{rng.choice(['river', 'stone', 'field'])}{i % 7}.example.net/en/{i}"))
    rows += [(900, "https://casino-bets.example.com/de2/5"), (901, "https://stone3.example.com/en/5")]
    pages = spark.createDataFrame([(*r, "h", 1.0, "rule") for r in rows], "page_id long, url string, html string, score double, rule string")
    got = urls.judge_urls(pages, URL_RULES).collect()
    assert sorted([(r.page_id, r.host, r.path, r.rule) for r in got], key=key) == sorted([(d, *slow_rule(u)) for d, u in rows], key=key)
    assert all(r.verdict == URL_RULES[r.rule] for r in got if r.rule)
    by = {r.page_id: r for r in got}
    assert by[900].verdict == "block" and by[901].verdict == "allow"
    allowed = [r for r in got if r.rule and URL_RULES[r.rule] == "allow"]
    assert sum(r.score > r.threshold for r in allowed) <= 0.01 * len(allowed)
    assert urls.judge_urls(pages.limit(0), URL_RULES).collect() == []
    check_scores(spark, rows, got)


def check_scores(spark, rows, got):
    """Scores, threshold and verdicts by Witten-Bell models over dictionaries."""
    table = urls.urls().table
    classes = lambda u: [0] * 3 + [int(table[ord(c)]) for c in u or ""]
    hosts = {slow_rule(u)[0] for _, u in rows}
    fold = {r.h: r.f for r in spark.createDataFrame([(h,) for h in hosts], "h string").selectExpr("h", "pmod(xxhash64(h), 2) f").collect()}
    counts = {(f, said): collections.Counter() for f in (0, 1) for said in ("allow", "block")}
    for _, u in rows:
        host, _, rule = slow_rule(u)
        if rule:
            c = classes(u)
            counts[fold[host], URL_RULES[rule]].update(tuple(c[i : i + k]) for k in range(1, 5) for i in range(4 - k, len(c) - k + 1) if len(c) >= 4)
    follow = {}
    for name, own in counts.items():
        for g, n in own.items():
            follow.setdefault((name, g[:-1]), {})[g[-1]] = n

    def p(name, gram):
        if not gram:
            return 1 / 39
        row = follow.get((name, gram[:-1]), {})
        lower, total = p(name, gram[1:]), sum(row.values())
        if total < (urls.LEAST_CONTEXT if len(gram) > 1 else 1):
            return lower
        return (row.get(gram[-1], 0) + len(row) * lower) / (total + len(row))

    def score(u, folds):
        c = classes(u)
        grams = [tuple(c[i : i + 4]) for i in range(len(c) - 3)]
        return sum(math.log(p((f, "block"), g)) - math.log(p((f, "allow"), g)) for f in folds for g in grams) / len(folds) / max(1, len(grams))

    want = {}
    for d, u in rows:
        host, _, rule = slow_rule(u)
        want[d] = score(u, [1 - fold[host]])
    assert all(abs(r.score - want[r.page_id]) < 1e-3 for r in got)
    for f in (0, 1):
        own = [r for r in got if fold[r.host] == f]
        scores = {said: [math.ceil(r.score * urls.BINS) for r in own if r.rule and URL_RULES[r.rule] == said] for said in ("allow", "block")}
        above = lambda said, v: sum((x > v) if said == "allow" else (x < v) for x in scores[said]) <= urls.FALSE_REJECTS * len(scores[said])  # noqa: E731,B023
        if len(scores["allow"]) >= 100:
            high = min(v for v in scores["allow"] if above("allow", v))
            low = max(v for v in scores["block"] if above("block", v))
            limit = max(high, (high + low) / 2)
        else:
            limit = np.mean(scores["allow"]) + 1.5 * 2.3263478740408408 * np.std(scores["allow"], ddof=1)
        assert all(abs(r.threshold - limit / urls.BINS) < 1e-9 for r in own)
    assert all(r.verdict == ("block" if r.score > r.threshold else "allow") for r in got if not r.rule)


def test_few_urls_do_not_set_the_threshold_alone():
    near = {b: 10 for b in range(-60, -40)}
    assert urls.limit(near | {-41: 0, 0: 1}, {100: 50}, 0.01) < 0.3  # 201 accepted: read from the tail, which two may be beyond
    few = {b: 2 for b in range(-60, -40)}
    assert abs(urls.limit(few | {150: 1}, {100: 50}, 0.01) - urls.limit(few, {100: 50}, 0.01)) < 0.75 and urls.limit(few, {}, 0.01) < 0


def test_long_urls_are_scored_whole(spark):
    long = "https://bets1.example.net/de/" + "casino-pills/" * 40_000
    rows = [(i, f"https://bets{i % 5}.example.net/de/casino-pills/{i}" if i % 2 else f"https://river{i % 5}.example.net/en/stone/{i}") for i in range(200)] + [(900, long), (901, long.replace("example.net/de", "example.com/fr"))]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()}
    assert got[900].path == long[len("https://bets1.example.net") :] and got[900].verdict == "block" and got[901].verdict == "block"


def test_witten_bell_is_a_distribution():
    rng = np.random.default_rng(3)
    p = np.exp(urls.witten_bell(rng.poisson(0.3, 6**4), 6)).reshape(-1, 6)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)


@pytest.mark.parametrize("bucket", [3, 4096])
def test_revisits_match_brute_force(spark, bucket):
    rng = random.Random(12)
    rows = []
    for i in range(400):
        status = rng.choice([200, 304, 304, 404])
        url = rng.choice(["http://www.a.com/x/", "https://A.com/x?utm_source=f#top", "http://a.com/x?b=2&a=1", "https://m.a.com/x?a=1&b=2", "http://b.org/index.html", None])
        etag = rng.choice(["e1", "W/e1", "e2", None])
        rows.append((i, url, rng.choice([rng.randrange(40), rng.randrange(40), None]), status, etag, rng.choice(["d1", "d2", None]), {"ETag": etag or "-", "etag": "dup", "Date": str(i), "X": "y"}))
    df = spark.createDataFrame([(*r, "z", "s") for r in rows], "record_id long, url string, at long, http_status int, etag string, last_modified string, headers map<string,string>, bucket string, status string")
    got = {r.record_id: r for r in resolve_revisits(df, bucket).collect()}
    names = {r.record_id: r.k for r in df.select("record_id", canonical_url(df["url"]).alias("k")).collect()}
    assert {names[r[0]] for r in rows} == {"a.com/x", "a.com/x?a=1&b=2", "b.org", None}
    bare = lambda e: e.removeprefix("W/") if e else None
    assert set(got) == {r[0] for r in rows if r[3] == 304}
    for i, url, at, status, etag, modified, headers in rows:
        if status != 304:
            continue
        past = [r for r in rows if r[3] == 200 and url and at is not None and r[2] is not None and names[r[0]] == names[i] and r[2] < at]
        found = max(past, key=lambda r: (r[2], r[0])) if past else None
        if not found:
            want = "orphan"
        elif etag and found[4]:
            want = "resolved" if bare(etag) == bare(found[4]) else "mismatch"
        elif modified and found[5]:
            want = "resolved" if modified == found[5] else "mismatch"
        else:
            want = "unchecked"
        assert (got[i].status, got[i].refers_to) == (want, found and found[0])
        if want in ("resolved", "unchecked"):
            assert got[i].headers == {"etag": headers["ETag"], "date": str(i), "x": "y"}
    assert resolve_revisits(df.limit(0)).collect() == []


def test_scores_need_no_words():
    assert math.isfinite(qda.statistics(__import__("pyarrow").array([None, "", " "])).sum())


def test_very_long_texts_and_words(make, labels_of, spark):
    rng = random.Random(31)
    vocabulary = ["rain", "field", "stone", "river", "light", "corn", "token = abcdefghijklmnop"]
    long = " ".join(rng.choice(vocabulary) for _ in range(300_000))
    word = "".join(rng.choice("ghijklmn") for _ in range(1_500_000))
    rows = [(1, long), (2, word), (3, long), (4, "short text"), (5, f"{word} {word}")]
    assert len(long) > 1 << 20
    docs, labels = make(rows), labels_of([(1, 1, 0), (2, 0, 1), (4, 1, 0), (5, 0, 1)])
    spans = {r.doc_id: r.spans for r in sec.scan_secrets(docs).collect()}
    assert len(spans[1]) == long.count("token =") and not spans[2]
    redacted = {r.doc_id: r for r in sec.redact_documents(docs).collect()}
    assert redacted[1].text.count("[assign]") == len(spans[1]) and redacted[2].text == word
    base = {r.doc_id: r for r in ppl.perplexity_rules(docs).collect()}
    assert base[1].n_words == len(long.split()) and base[5].n_words == 2 and base[5].word_chars == 2 * len(word) and base[1].bits == base[3].bits
    for score in (qda.score_quality, tox.score_toxicity):
        got = {r.doc_id: r.score for r in score(docs, labels).collect()}
        assert set(got) == {1, 2, 3, 4, 5} and got[1] == got[3] and all(0 <= v <= 1 for v in got.values())
    bench = spark.createDataFrame([(1, " ".join(long.split()[1000:1100]))], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in gst.find_contamination(docs, bench).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}
    tokens = {r.doc_id: r.n_tokens for r in encode_documents(make([(1, long), (2, word[:60_000])]), WORD_BPE, digests=True).collect()}
    assert tokens == {1: len(TOKENS.encode(long, add_special_tokens=False).ids), 2: len(TOKENS.encode(word[:60_000], add_special_tokens=False).ids)}
