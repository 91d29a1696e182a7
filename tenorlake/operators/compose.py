"""Extension points: steps are callables from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


def chain_of(*steps: Step) -> Step:
    """One step that runs ``steps`` in order, for ``df.transform``."""
    return lambda df: reduce(lambda d, step: step(d), steps, df)


def seeded_sample(df: DataFrame, fraction: float, seed: int, keys: list[str]) -> DataFrame:
    """About ``fraction`` of the rows, chosen by a hash of ``keys`` and ``seed``: the same rows whatever the partitions are."""
    place = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000))
    return df.filter(place < int(fraction * 1_000_000))


#: Rows that a sample of a given size may have: they meet in one task.
MOST_SAMPLED = 1_000_000


def sample_of_size(df: DataFrame, size: int, seed: int, keys: list[str]) -> DataFrame:
    """``size`` rows, or all if there are fewer: those whose MD5 of ``seed`` and ``keys`` (joined by ``|``, as text, null empty) is least.

    The same rows whatever the partitions are, as long as ``keys`` are unique. Each task keeps its least ``size`` rows, and only these are merged.
    """
    if size > MOST_SAMPLED:
        raise ValueError(f"a sample has at most {MOST_SAMPLED} rows; take a fraction with seeded_sample")
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys))
    return df.withColumn("_place", F.md5(text)).orderBy("_place", *keys).limit(size).drop("_place")
