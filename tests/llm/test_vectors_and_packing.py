"""Whitening, importance resampling and packing."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tenorlake.llm import importance as imp
from tenorlake.llm import packing as pck
from tenorlake.llm import whitening as wht
from tenorlake.llm.queries import BYTE_BPE

from .conftest import ODD

TOKENS = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def key(x):
    return tuple((v is None, str(v)) for v in x)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], "vec_id long, embedding array<double>, n int, component string, whitened double")


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 7), st.integers(0, 10**6))
def test_polynomial_modulo_a_prime_is_the_characteristic_one(d, seed):
    rng = random.Random(seed)
    m = np.array([[rng.choice([0, 0, 1, rng.randrange(-50, 50)]) for _ in range(d)] for _ in range(d)], object)
    p = wht.primes_below(1 << 31, 1)[0]

    def det(a):  # by expansion, over polynomials with the lowest power first
        if not a:
            return [1]
        out = [0] * (len(a) + 1)
        for j, x in enumerate(a[0]):
            rest = det([r[:j] + r[j + 1 :] for r in a[1:]])
            for s, u in enumerate(x):
                for t, v in enumerate(rest):
                    out[s + t] += (-1) ** j * u * v
        return out

    want = det([[[-int(m[i, j]), int(i == j)] for j in range(d)] for i in range(d)])
    assert wht.polynomial_modulo(m, p).tolist() == [c % p for c in want[::-1]]


def test_roots_are_isolated_exactly():
    roots = [Fraction(900), Fraction(900), Fraction(7), Fraction(7) - Fraction(1, 1 << 60), Fraction(1, 3), Fraction(0)]
    poly = [Fraction(1)]
    for r in roots:
        poly = [a - r * b for a, b in zip([*poly, 0], [0, *poly])]
    scale = 3 << 60  # makes all of them whole
    sums = [int(abs(c) * scale**j) for j, c in enumerate(poly)]
    for k, r in enumerate(roots[:5]):
        assert abs(wht.root(sums, k + 1) - r * scale) <= r * scale / 2**150


def test_whitening_matches_an_eigensolver_and_is_exact(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(300, 12)) * np.geomspace(3, 0.01, 12)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    odd = [(900, None), (901, []), (902, [1.0, None, *[0.0] * 10]), (903, [float("nan"), *[0.0] * 11]), (904, [float("inf"), *[0.0] * 11]), (905, [1e300, *[0.0] * 11]), (906, [1.0, 2.0]), (None, data[3].tolist()), (3, data[3].tolist())]
    got = wht.whiten(vectors(spark, rows + odd).repartition(5)).collect()
    fit = np.floor(1024 * np.vstack([data, data[3], data[3]])) + 100_000
    ids = [*range(300), None, 3]
    n = len(fit)
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    centred = fit - fit.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    axes *= np.sign(axes[abs(axes).argmax(axis=0), range(8)])
    want = collections.defaultdict(list)
    whole = fit.astype(int).tolist()
    total = [sum(c) for c in zip(*whole)]
    for i, w, x in zip(ids, centred @ axes / np.sqrt(values), whole):
        far = sum((n * a - s) ** 2 for a, s in zip(x, total))
        for k in range(8):
            want[i, k + 1].append((far, w[k]))
    for r in got:
        far, w = want[r.vec_id, r.component][0]
        assert int(r.deviation) == far and abs(r.whitened - w) < 1e-9
        assert abs(r.explained / (values[r.component - 1] / (centred**2).sum() * n) - 1) < 1e-9 and r.identity_error < 1e-9
    assert wht.whiten(vectors(spark, [])).collect() == []
    assert wht.whiten(vectors(spark, odd[:6])).collect() == []
    assert wht.whiten(vectors(spark, rows[:1])).collect() == []  # no variance


def test_whitening_of_equal_roots_low_rank_and_large_numbers(spark):
    # the corners of an octahedron and a dead direction: three equal roots, rank 3 of 4
    corners = [[s * float(i == j) for j in range(3)] + [5.0] for i in range(3) for s in (1, -1)]
    got = wht.whiten(vectors(spark, list(enumerate(corners)))).collect()
    assert {r.component for r in got} == {1, 2, 3} and all(abs(r.explained - 1 / 3) < 1e-12 and r.identity_error < 1e-12 for r in got)
    far = [[1e14, 3.0, 0.1], [-1e14, 5.0, 0.3], [2e13, -7.0, 0.2], [1.0, 1.0, 1.0]]
    got = {(r.vec_id, r.component): r for r in wht.whiten(vectors(spark, list(enumerate(far)))).collect()}
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in far]
    total = [sum(c) for c in zip(*x)]
    assert [int(got[i, 1].deviation) for i in range(4)] == [sum((4 * a - s) ** 2 for a, s in zip(v, total)) for v in x]
    assert len(got) == 12 and got[0, 1].identity_error < 1e-4


def slow_weights(docs, target):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    bucket = lambda w: zlib.crc32(w.encode()) % 10_000
    s = collections.Counter(bucket(w) for _, t in docs for w in words(t))
    t = collections.Counter(bucket(w) for x in target for w in words(x))
    ns, nt = s.total() + 10_000, t.total() + 10_000
    out = []
    for d, text in docs:
        weight = sum(math.floor(1000 * math.log((t[bucket(w)] + 1) * ns / ((s[bucket(w)] + 1) * nt))) for w in words(text))
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(words(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: len(able) * 10 // 100]):
        r[4] = k + 1
    return [tuple(r) for r in out]


def test_resampling_matches_brute_force(spark, make):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "ß", "ABC", "漢字"]
    docs = [r[:2] for r in ODD] + [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(150)] + [(400, "same text " * 15)] * 7
    target = [" ".join(rng.choice(vocabulary[:40]) for _ in range(500)), None, ""]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = imp.resample(make(docs).repartition(3), bench).collect()
    assert sorted(map(tuple, got), key=key) == sorted(slow_weights(docs, target), key=key)
    assert imp.resample(make([]), bench).collect() == []
    assert sorted(map(tuple, imp.resample(make(docs), bench.where("false")).collect()), key=key) == sorted(slow_weights(docs, []), key=key)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5000), min_size=70, max_size=70), min_size=1, max_size=5), st.lists(st.integers(-40_000, 40_000), min_size=70, max_size=70))
def test_planes_give_exact_weights(counts, gains):
    weights = imp.Weights(np.array(gains))
    rows = np.zeros((len(counts), weights.width), np.int32)
    rows[:, :70] = counts
    assert weights.of(rows).tolist() == [sum(c * g for c, g in zip(r, gains)) for r in counts]


def one_bin_at_a_time(counts, capacity):
    """Sequences as sorted lists, by the same rule over a list of single pieces."""
    free, out = collections.Counter(counts), []
    while +free:
        held, gap = [], capacity
        while fits := [n for n in free if free[n] and n <= gap]:
            held.append(max(fits))
            free[held[-1]] -= 1
            gap -= held[-1]
        if gap and len(held) > 1:
            room = gap + held[-1]
            pairs = [(a + b, a, b) for a in free for b in free if a >= b and a + b <= room and free[a] > (a == b) and free[b]]
            if pairs and max(pairs)[0] > held[-1]:
                free[held.pop()] += 1
                for n in max(pairs)[1:]:
                    held.append(n)
                    free[n] -= 1
        out.append(sorted(held))
    return out


def sequences_of(runs, counts):
    out = collections.defaultdict(list)
    by_length = collections.defaultdict(list)
    for run in runs:
        by_length[run[0]].append(run)
    for n, own in by_length.items():
        own.sort(key=lambda r: r[1])
        for (_, first, times, sequence, offset), after in zip(own, [*(r[1] for r in own[1:]), counts[n]]):
            for at in range(after - first):
                out[sequence + at // times].append((offset + at % times * n, n))
    return out


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), min_size=1, max_size=12))
def test_packing_counts_equals_packing_one_bin_at_a_time(counts):
    got = sequences_of(pck.best_two_fit(counts, 40), counts)
    assert sorted(got) == list(range(len(got)))
    for own in got.values():
        ends = 0
        for offset, n in sorted(own):
            assert offset == ends
            ends += n
        assert ends <= 40
    assert [sorted(n for _, n in got[i]) for i in range(len(got))] == one_bin_at_a_time(counts, 40)


def test_two_pieces_replace_the_smallest():
    # 6 + 3 leaves a gap of 1; 2 + 2 in the place of 3 leaves none
    runs = pck.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert sorted(sorted(n for _, n in s) for s in sequences_of(runs, {6: 1, 3: 1, 2: 2}).values()) == [[2, 2, 6], [3]]


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_those_of_the_library(text):
    assert pck.load(BYTE_BPE).ids([text])[0].tolist() == TOKENS.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [2048, 7])
def test_packing_keeps_every_token(spark, make, capacity):
    rng = random.Random(2)
    docs = [r[:2] for r in ODD] + [(100 + i, "<|endoftext|> café's  12 한글 " * rng.randrange(12)) for i in range(60)]
    rows = pck.pack(make(docs).repartition(3), BYTE_BPE, capacity, with_ids=True).collect()
    want = collections.Counter((d, (*TOKENS.encode(t or "", add_special_tokens=False).ids, 0)) for d, t in docs)
    # pieces of a row lie in order in the table of pieces; rows with one id are told apart by their lengths
    by_id, whole = collections.defaultdict(list), collections.Counter()
    for r in rows:
        assert r.length == len(r.ids) <= capacity and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.piece == 0 or r.length == capacity
        by_id[r.doc_id].append(r)
    for d, own in by_id.items():
        if sum(r.piece == 0 for r in own) == 1:
            own.sort(key=lambda r: r.piece)
            assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
            whole[d, tuple(t for r in own for t in r.ids)] += 1
        else:
            assert {len(r.ids) for r in own} == {len(TOKENS.encode("one", add_special_tokens=False).ids) + 1}
            whole.update((d, tuple(r.ids)) for r in own)
    assert whole == want
    for own in (lambda m: [m[r] for r in m])({s: sorted((r.offset, r.length) for r in rows if r.sequence_id == s) for s in {r.sequence_id for r in rows}}):
        ends = 0
        for offset, n in own:
            assert offset == ends
            ends += n
        assert ends <= capacity
    assert pck.pack(make([]), BYTE_BPE).collect() == []
