import random

import pytest

#: Columns that an input may bring and that operators use inside: all must be left alone.
CLASHES = ("h", "d", "fp", "_h", "_row", "base", "spans", "more", "rate", "copies", "tokens", "posterior", "label", "score", "held_out", "lang_pred", "n", "row", "rejected")


def _rows():
    rnd = random.Random(3)
    prose = lambda n: " ".join("".join(rnd.choice("abdeghilmnorstu") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    long = prose(40_000)
    copy = prose(120)
    near = copy.split()
    near[50] = "changed"
    return [
        (None, "A text without an id, in twelve words or so, to be on its own."), (1, None), (2, ""), (3, " \n\t \x0b"), (4, "word"), (5, long), (6, long + " end"),
        (7, copy), (8, copy), (9, " ".join(near)), (10, copy.upper()), (11, copy), (11, copy), (12, "line one is here\n" * 30), (13, "12345 67890 !!! ###"),
        (14, "ÀÉ çà été über straße " * 5), (15, "a\x00b \U0001f600 tail"), (16, prose(30) + ' password = "abc123def" AKIA' + "Q" * 16 + " " + "0a" * 20 + " " + prose(30)),
        (17, "x" * 50_000), (18, "ab" * 30_000), (19, "### | ### " * 20), (None, None)]


@pytest.fixture(scope="session")
def texts():
    return _rows()


@pytest.fixture(scope="session")
def edge(spark, texts):
    """Rows with nulls, empty and very long texts, repeats, and extra columns whose names clash with inner ones."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(d, t, "en" if (d or 0) % 3 else None, None if d == 5 else "s", None if t is None else len(t)) for d, t in texts],
                               "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(None, 1, 0), (5, None, 0), (7, 1, 0), (7, 1, 0), (8, 0, 1), (9, 1, None), (12, 0, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.01"
