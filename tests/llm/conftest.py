import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "ta", "ve", "so", "ne") for b in ("lan", "dor", "mis", "tek", "run", "pal")]


@pytest.fixture(scope="session")
def prose():
    rng = random.Random(4)

    def make(n):
        return " ".join(rng.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, long, repeated."""
    return [None, "", " \n\t ", "word", "a b c d e " * 4000, "same text here", "same text here"]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """Odd texts with columns that operators might add themselves."""
    rows = [(i, t, "en", "s", 0, 1.5, True, 7) for i, t in enumerate(odd_texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, block int")
