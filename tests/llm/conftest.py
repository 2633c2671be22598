import random

import pytest

ODD = [None, "", " \n\t ", "x", "one two", "ends with space ", "é ñ 日本語 🙂 word", "z" * 5000, ("long text of many words " * 3000).strip(), "<|endoftext|> |x| [y]", "null\x00byte"]


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(800)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing extra columns."""
    rows = [(i, t, "en", "s", 1, "x", 0.5) for i, t in enumerate(ODD)]
    rows += [(3, "x", "en", "s", 1, "x", 0.5), (4, "another text for four", None, None, None, None, None), (None, "one two", None, "s", 1, None, None), (None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, spans double"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
