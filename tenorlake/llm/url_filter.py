"""URL verdicts from host and path rules, and from character models of accepted and rejected URLs.

Method: two variable-order Markov models over the characters of URLs, one learned from accepted and
one from rejected URLs. A character is predicted from up to three before it; a context that was seen
too rarely gives way to a shorter one, and each order is smoothed with the next by Witten-Bell. The
score is the difference of the log likelihoods a character. Hosts are dealt to two folds, each with
models of its own, and every URL, decided by a rule or not, is scored by the other fold's, which its host
did not train. Each fold's threshold is calibrated on such scores: a given share of the accepted URLs at
most lies above it, and it is not lower than it must be to reject all but as many of the rejected ones.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import pieces, texts
from .charlm import Alphabet, count_grams, dense_counts, urls

ORDER = 4
#: A context needs so many characters after it to be used.
LEAST_CONTEXT = 4
#: Share of the accepted URLs that the threshold may reject.
FALSE_REJECTS = 0.01
#: Accepted URLs that have to lie beyond a threshold for it to be read from their tail; deviations beyond the normal ones otherwise.
TAIL, CAUTION = 1, 1.5
#: Bins of one unit of score in the histogram that the threshold is read from, and where it ends.
BINS, SPAN = 200, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of ``rules`` (``host/path`` to verdict) that fits, ties by text; null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        at = rule.index("/")
        own, start = rule[:at], rule[at:]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def witten_bell(counts: np.ndarray, size: int, order: int = ORDER) -> np.ndarray:
    """Natural log probability of each n-gram (its last character given the others), as a dense array."""
    p = np.full(size, 1 / size)
    for k in range(1, order + 1):
        c = counts.reshape(-1, size**k).sum(axis=0).reshape(-1, size)
        total = c.sum(axis=1, keepdims=True)
        kinds = (c > 0).sum(axis=1, keepdims=True)
        lower = p.reshape(-1, size)[np.arange(len(c)) % max(1, len(p) // size)]
        used = total >= (LEAST_CONTEXT if k > 1 else 1)
        p = np.where(used, (c + kinds * lower) / np.maximum(total + kinds, 1), lower).ravel()
    return np.log(p).astype(np.float32)


def difference(counts: dict, fold: int, alphabet: Alphabet) -> np.ndarray:
    """Log probability as a rejected URL less that as an accepted one, for each n-gram, in a fold's models."""
    zero = np.zeros(alphabet.size**ORDER, np.int64)
    block, allow = (witten_bell(counts.get(f"{said}{fold}", zero), alphabet.size) for said in ("block", "allow"))
    return block - allow


def top(counts: dict[int, int], share: float) -> int:
    """The least bin above which at most ``share`` of the counts lie."""
    left = share * sum(counts.values())
    for b in sorted(counts, reverse=True):
        left -= counts[b]
        if left < 0:
            return b
    return min(counts)


def limit(allowed: dict[int, int], blocked: dict[int, int], share: float) -> float:
    """The score above which at most ``share`` of accepted URLs lie, from counts of scores by bin.

    From ``TAIL / share`` URLs on it is read from their tail; where the two classes don't overlap, half-way between what nearly all accepted stay below
    and nearly all rejected reach. With fewer URLs a tail is one URL or none, so mean and deviation tell where it lies: at ``CAUTION`` times as many
    deviations as a normal distribution has there.
    """
    n = sum(allowed.values())
    if n * share >= TAIL:
        highest = top(allowed, share)
        lowest = -top({-b: c for b, c in blocked.items()}, share) if blocked else highest
        return max(highest, (highest + lowest) / 2) / BINS
    mean = sum(b * c for b, c in allowed.items()) / n
    spread = (sum(c * (b - mean) ** 2 for b, c in allowed.items()) / max(1, n - 1)) ** 0.5
    return (mean + CAUTION * NormalDist().inv_cdf(1 - share) * spread) / BINS


def judge_urls(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url", false_rejects: float = FALSE_REJECTS) -> DataFrame:
    """``page_id, host, path, rule, verdict, score, threshold``, one row for each row of ``pages``.

    ``rules``: ``host/path`` to ``allow`` or ``block``; a rule fits its host and all subdomains if the path
    starts with its path. The longest that fits decides. URLs that a rule decides train the models; the
    others get the models' verdict, ``block`` if ``score`` is above ``threshold``. Hosts are in two folds, decided or not, and a URL is scored by the models that
    the other fold's decided URLs trained, so undecided URLs and those that the threshold is read from are scored alike; ``false_rejects`` of the
    accepted URLs at most exceed the threshold of their fold (``limit``). A null URL, or one
    without ``://``, has an empty host and path and is scored as it is written (null: empty, score 0).
    Without accepted or without rejected URLs nothing is blocked by score. Repeated rows count as
    often as they come and are judged alike. URLs of any length are scored whole. Other columns are
    ignored. An empty table gives an empty result.
    """
    alphabet = urls()
    url = F.col(url_col).cast("string")
    source = pages.select(F.col(id_col).alias("page_id"), url.alias("text"), host_of(url).alias("host"), path_of(url).alias("path"))
    source = source.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for rule, said in rules.items():
        verdict = F.when(F.col("rule") == rule, F.lit(said)).otherwise(verdict)
    source = source.withColumn("label", verdict)
    source = source.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(2)).cast("int"))
    counts = dense_counts(count_grams(source.where("label is not null").select(F.concat("label", F.col("fold").cast("string")).alias("label"), "text"), alphabet, ORDER), alphabet, ORDER)
    # by the fold of a URL's host, decided or not: the other fold's models
    weights = np.stack([difference(counts, 1 - fold, alphabet) for fold in (0, 1)])
    shared = pages.sparkSession.sparkContext.broadcast((alphabet.table, alphabet.size, weights))
    kept = [f for f in source.schema.fields if f.name not in ("text", "fold")]

    def score(batches):
        table, size, weights = shared.value
        alphabet = Alphabet.__new__(Alphabet)
        alphabet.table, alphabet.size = table, size
        for batch in pieces(batches):
            codes, at = alphabet.codes(texts(batch.column("text")), ORDER - 1)
            fold = np.repeat(batch.column("fold").to_numpy(zero_copy_only=False), np.diff(at))
            value = np.where(codes > 0, weights[fold, alphabet.grams(codes, ORDER)], 0).astype(np.float64)
            n = np.maximum(np.add.reduceat((codes > 0).astype(np.int64), at[:-1]), 1)
            out = np.round(np.add.reduceat(value, at[:-1]) / n, 6)
            yield pa.record_batch([*(batch.column(f.name) for f in kept), pa.array(out)], [*(f.name for f in kept), "score"])

    kinds = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "score double"])
    scored = source.select(*(f.name for f in kept), "fold", "text").mapInArrow(score, kinds)
    place = F.greatest(F.lit(-SPAN * BINS), F.least(F.lit(SPAN * BINS), F.ceil(F.col("score") * BINS))).cast("int")
    fold = F.pmod(F.xxhash64("host"), F.lit(2)).cast("int")
    bins = scored.where("label is not null").groupBy("label", fold.alias("fold"), place.alias("bin")).count().collect()  # at most 4 * (2 * SPAN * BINS + 1) rows
    limits = []
    for k in (0, 1):
        # what the fold's models, which never saw these hosts, give to its accepted and rejected URLs
        allowed, blocked = ({r.bin: r["count"] for r in bins if r.label == said and r.fold == k} for said in ("allow", "block"))
        trained = all(f"{said}{1 - k}" in counts for said in ("allow", "block"))
        limits.append(limit(allowed, blocked, false_rejects) if allowed and trained else float("inf"))
    threshold = F.when(fold == 0, F.lit(limits[0])).otherwise(F.lit(limits[1]))
    method = F.when(F.col("score") > threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("label", method).alias("verdict"), "score", threshold.alias("threshold"))
