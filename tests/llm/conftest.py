import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, x string, t string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with names that operators use."""
    random.seed(5)
    words = ["alpha", "beta", "gamma", "delta", "ein", "und", "der", "the", "of", "#", "Ça", "<|endoftext|>", "x\u00a0y", "\u4e2d\u6587"]
    long = " ".join(random.choice(words) for _ in range(30_000))
    base = " ".join(random.choice(words[:9]) + str(i % 7) for i in range(120))
    texts = [None, "", "   \n\t ", "one", "one two", "one two three", base, base, base + " tail", base.replace("alpha", "omega", 1), long, long + " end", "\x1c\x1f odd\u0301 \u1e9e", "A" * 5000, "line\nline\n\nline", "!!! ???"]
    rows = [(i, t, random.choice(["en", "de", None]), random.choice(["s1", "s2", None]), None if t is None else len(t), 0.5, 1, "x", "t") for i, t in enumerate(texts)]
    rows += [rows[6], (None, "no id", None, None, None, None, None, None, None), (None, base, "en", "s1", 1, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, None if i == 3 else i % 2, 0) for i in range(12)] + [(None, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
