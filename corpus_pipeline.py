"""A corpus cleaned in five stages: quality, near duplicates, contamination, secrets, tokens.

Each stage takes what its predecessor kept, with the columns of ``documents``; the last returns one row of
token counts and digests for each document that is left. All stages take nulls in any column, empty and very
long texts (judged whole), repeated rows, further columns of any names, and an empty table, which stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenorlake.llm.base import erase, store
from tenorlake.llm.bpe import encode_documents
from tenorlake.llm.decontamination import drop_contaminated
from tenorlake.llm.quality_qda import keep_good
from tenorlake.llm.queries import WORD_BPE, table
from tenorlake.llm.secrets import redact_documents
from tenorlake.llm.simhash_dedup import keep_one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null or empty text is judged as an empty one; repeated rows stay or go together, and texts with equal
    statistics too, so there are no ties to break. Rows without an id are judged like others.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the smallest id.

    Null, empty and blank texts are duplicates of each other. Of rows that repeat an id the one with the
    smallest text stays. Rows without an id stay.
    """
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; repeated rows stay or go together. Without benchmark items all stay.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and ``n_chars`` follows.

    A null text stays null, an empty one empty. Spans that overlap become one, named by the first, on ties by the
    order of the kinds. Repeated rows are changed alike.
    """
    return redact_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text, a row for each row.

    A null or empty text has no tokens. Ids are carried as they are, null and repeated ones too. Of merges with one
    rank the leftmost goes first.
    """
    return encode_documents(docs, WORD_BPE, digests=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("tokens", tokens)]
#: SQL cannot express the classifier, the tiling or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = store(stage(spark, docs, sf_dir), name)
        if last:
            erase(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
