"""Toxicity by a weighted lexicon that one Aho-Corasick pass matches in folded text.

Method: text is folded character by character (lower case, look-alike letters of other scripts, digits
and marks that stand for letters), so positions stay those of the text. The lexicon holds words and
word beginnings with log-odds weights; a hit counts from a word's start, once for a word with its
largest weight, and not inside an exception phrase: a hit with the word before or after it that clean
texts hold and toxic ones don't. The weights that a text collects, alone and for each thousand words,
become a probability by logistic regression.

Weights are learned from the labels of rows that are not held out, on a sample bounded by
``SAMPLE_ROWS`` a class; the bound is all that is limited, every text is scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import checkpointed, held_out, id_and_text, pieces, texts
from .quality_qda import labelled

SAMPLE_ROWS = 4000
#: The least number of toxic documents, score and weight that an entry needs; the sample bounds how many have them.
LEAST_DOCS, LEAST_Z, LEAST_WEIGHT = 5, 3.5, 1.0
#: Clean documents that must hold an exception phrase, and the score against toxic ones that it needs.
EXCEPTION_DOCS, EXCEPTION_Z = 5, 2.0
#: Lengths of word beginnings that can be entries.
BEGINNINGS = range(4, 9)
#: Letters of other scripts that look like Latin ones.
LOOK_ALIKE = dict(zip("авекмнорстухіјѕһԁԛԝαορυικντε", "abekmhopctyxijshdqwaopuikvte"))
#: Digits and marks that stand for letters. l, 1 and i are one letter after folding.
STANDS_FOR = dict(zip("0134578@$!|l", "oieastbasiii"))
FOLD = str.maketrans(LOOK_ALIKE | STANDS_FOR)


def folded(text: str) -> str:
    """As long as the text, character for character."""
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join(c.lower()[0] for c in text)
    return lower.translate(FOLD)


def terms(text: str) -> set[str]:
    """Folded words of a text without marks at their ends, and their beginnings, which end in ``*``."""
    out = set()
    for word in set(text.split()):
        while word and not word[0].isalnum():
            word = word[1:]
        while word and not word[-1].isalnum():
            word = word[:-1]
        if len(word) >= 3:
            word = folded(word)
            out.add(word)
            out.update(word[:k] + "*" for k in BEGINNINGS if k < len(word))
    return out


@dataclass
class Lexicon:
    """``weights``: by folded word, or by word beginning with ``*`` at its end."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    _machine: ahocorasick.Automaton | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.weights, self.exceptions

    def __setstate__(self, state):
        self.weights, self.exceptions = state
        self._machine = None

    def machine(self) -> ahocorasick.Automaton:
        if self._machine is None:
            entries: dict[str, list] = {}
            for term, weight in self.weights.items():
                entries.setdefault(term.rstrip("*"), [0.0, 0.0, False])[term.endswith("*")] = weight
            for phrase in self.exceptions:
                entries.setdefault(folded(phrase), [0.0, 0.0, False])[2] = True
            self._machine = ahocorasick.Automaton()
            for text, entry in entries.items():
                if text:
                    self._machine.add_word(text, (len(text), *entry))
            self._machine.make_automaton()
        return self._machine

    def hits(self, text: str) -> dict[int, float]:
        """Weights by the position of the word that begins there."""
        found: dict[int, float] = {}
        calm = []
        machine = self.machine()
        if not len(machine):
            return found
        size = len(text)
        for end, (n, whole, beginning, exception) in machine.iter(folded(text)):
            start = end - n + 1
            if start and text[start - 1].isalnum():
                continue
            ends = end + 1 >= size or not text[end + 1].isalnum()
            if exception and ends:
                calm.append((start, end))
            weight = max(whole, beginning) if ends else beginning
            if weight > found.get(start, 0.0):
                found[start] = weight
        for a, b in calm:
            for at in [x for x in found if a <= x <= b]:
                del found[at]
        return found

    def phrases(self, text: str) -> set[str]:
        """Each hit's word with the word before it, and with the one after it, folded, with a space between."""
        out = set()
        if hits := self.hits(text):
            words = [(m.start(), folded(m[0])) for m in re.finditer(r"[^\W_]+", text)]
            for (a, one), (b, two) in zip(words, words[1:]):
                if a in hits or b in hits:
                    out.add(f"{one} {two}")
        return out

    def features(self, own: list[str]) -> np.ndarray:
        """Logarithms of the weight collected, of that for each thousand words, and the largest weight."""
        out = np.zeros((len(own), 3))
        for i, text in enumerate(own):
            weights = self.hits(text).values()
            if weights:
                total = sum(weights)
                out[i] = math.log1p(total), math.log1p(1000 * total / len(text.split())), max(weights)
        return out


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> Lexicon:
    """The entries with the clearest log-odds between toxic and other documents of ``text, y``."""

    def of(batches):
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, y in zip(texts(batch.column("text")), batch.column("y").to_pylist()):
                (toxic if y else clean).update(terms(text))
        both = list(toxic.keys() | clean.keys())
        for at in range(0, len(both), 1 << 15):
            own = both[at : at + (1 << 15)]
            yield pa.record_batch([pa.array(own), pa.array([toxic[t] for t in own], pa.int64()), pa.array([clean[t] for t in own], pa.int64())], ["term", "t", "c"])

    counts = sample.select("text", "y").mapInArrow(of, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    t, c = F.col("t"), F.col("c")
    weight = F.log((t + 0.5) / (n_toxic - t + 0.5)) - F.log((c + 0.5) / (n_clean - c + 0.5))
    z = weight / F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
    best = counts.where(t >= LEAST_DOCS).select("term", weight.alias("w"), z.alias("z")).where((F.col("z") >= LEAST_Z) & (F.col("w") >= LEAST_WEIGHT))
    return Lexicon({r.term: r.w for r in best.orderBy("term").collect()})


def learn_exceptions(lexicon: Lexicon, sample: DataFrame, n_toxic: int, n_clean: int) -> tuple[str, ...]:
    """Phrases around hits that clean documents of ``text, y`` hold clearly more often than toxic ones do."""

    def of(batches):
        for batch in pieces(batches):
            for text, y in zip(texts(batch.column("text")), batch.column("y").to_pylist()):
                if own := list(lexicon.phrases(text)):
                    yield pa.record_batch([pa.array(own), pa.array([y] * len(own), pa.int32())], ["phrase", "y"])

    counts = sample.select("text", "y").mapInArrow(of, "phrase string, y int").groupBy("phrase").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    t, c = F.col("t"), F.col("c")
    weight = F.log((c + 0.5) / (n_clean - c + 0.5)) - F.log((t + 0.5) / (n_toxic - t + 0.5))
    found = counts.where((c >= EXCEPTION_DOCS) & (weight / F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)) >= EXCEPTION_Z))
    return tuple(r.phrase for r in found.select("phrase").orderBy("phrase").collect())


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Coefficients, intercept first, by Newton's method."""
    x = np.concatenate((np.ones((len(x), 1)), x), axis=1)
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        beta = beta + np.linalg.solve(curve, slope)
    return beta


def score_toxicity(docs: DataFrame, labels: DataFrame, column: str = "toxic", id_col: str = "doc_id", text_col: str = "text", exceptions: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row for each row of ``docs``. ``exceptions`` are harmless phrases besides those that are learned.

    Only labels of rows that are not held out are learned from; a score depends on the text alone. A null
    text is empty; it scores as a text without hits. Without training rows every score is 0.5.
    Contradicting labels of an id are left out. Repeated rows get equal scores. Texts of any length are
    scored whole. Other columns are ignored. An empty table gives an empty result.
    """
    source = id_and_text(docs, id_col, text_col)
    training = checkpointed(labelled(labels, column))
    totals = {r.y: r["count"] for r in training.groupBy("y").count().collect()}
    # a bounded sample of each class, the same on every run
    ordered = [training.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS) for y in (0, 1)]
    ids = F.broadcast(ordered[0].unionByName(ordered[1]))
    sample = checkpointed(source.join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).select("text", "y"))
    used = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    lexicon = learn_lexicon(sample, used.get(1, 0), used.get(0, 0))
    lexicon.exceptions = (*exceptions, *learn_exceptions(lexicon, sample, used.get(1, 0), used.get(0, 0)))
    lexicon._machine = None

    def measure(batches):
        for batch in pieces(batches):
            x = lexicon.features(texts(batch.column("text")))
            yield pa.record_batch([batch.column("y"), *(pa.array(v) for v in x.T)], ["y", "a", "b", "c"])

    rows = sample.mapInArrow(measure, "y int, a double, b double, c double").toPandas().sort_values(["y", "a", "b", "c"])
    y = rows["y"].to_numpy()
    share = np.array([totals.get(k, 0) / used[k] if used.get(k) else 1.0 for k in (0, 1)])
    beta = logistic(rows[["a", "b", "c"]].to_numpy(), y, share[y]) if len(rows) else np.zeros(4)

    def of(batches):
        for batch in pieces(batches):
            x = lexicon.features(texts(batch.column("text")))
            score = 1 / (1 + np.exp(-np.clip(beta[0] + x @ beta[1:], -30, 30)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    scored = source.mapInArrow(of, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
