import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, ids string, n double"


def documents(spark, rows):
    """Rows of (doc_id, text) with extra columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t), 7, "x", 0.5) for i, t in rows], SCHEMA)


def odd_rows(seed=5):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "l'été", "it's", "42", "+", "naïve", "mot", "delta-9", "中文", "x"]
    line = lambda: " ".join(rng.choices(words, k=rng.randint(0, 14)))
    common = ["This line is in very many documents.", "  THIS LINE IS IN VERY MANY DOCUMENTS.\t", "another line which is common"]
    rows = [(i, "\n".join(rng.choice([line(), line(), rng.choice(common)]) for _ in range(rng.randint(1, 9)))) for i in range(10, 70)]
    rows += [(1, None), (2, ""), (3, " \t\n "), (4, "\n\n"), (5, "word"), (6, "two words"), (7, "word"), (8, ("long text with words " * 30000) + "end"), (9, "é" * 25)]
    rows += [rows[0], rows[1], (None, "a row without id and This line is in very many documents."), (10**12, common[0]), (-4, common[0])]
    return rows


@pytest.fixture
def make(spark):
    return lambda rows: documents(spark, rows)
