import pytest

WIDE = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, block int, y int, label string, bucket int, held_out boolean"


@pytest.fixture(scope="session")
def make(spark):
    """Documents with columns whose names operators use inside; ``rows``: (doc_id, text) or (doc_id, text, lang)."""

    def of(rows):
        full = [(r[0], r[1], (r[2] if len(r) > 2 else "en"), "src", None if r[1] is None else len(r[1]), 1.0, 7, 3, 1, "x", 2, True) for r in rows]
        return spark.createDataFrame(full, WIDE)

    return of


@pytest.fixture(scope="session")
def labels_of(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


#: Rows that every operator has to take: nulls in any column, empty and blank texts, repeated rows, a long text.
ODD = [(None, "alpha beta gamma delta epsilon zeta eta theta"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "word " * 30000), (6, "é ü 漢字 \x00 🎉 \ud7ff"), (7, "one", None)]
