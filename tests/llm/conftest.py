import random

import pytest


def words(rng, n, spread=400):
    return [f"w{rng.randrange(spread)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, shared passages, self-repeats, nulls, empties and odd characters; ids are not in order."""
    rng = random.Random(5)
    passage = " ".join(words(rng, 70))
    rows = []
    for k in range(120):
        text = " ".join(words(rng, rng.randrange(0, 160)))
        if k % 5 == 0:
            text += "\n" + passage + " " + " ".join(words(rng, 5))
        if k % 11 == 0:
            text = "ab" * 90 + " été ß " + text
        if k % 13 == 0:
            text = ("same words again " * 40) + text
        if k % 17 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1] or ""
        rows.append((1000 - 7 * k, text))
    rows += [(5, None), (6, ""), (7, " \n\t "), (8, "x"), (9, "A b"), (9, "A b"), (2000, "é" * 120), (2001, "é" * 120)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    extra = [(d, t, ["en", "fr", None][k % 3], f"s{k % 4}", None if t is None else len(t), k) for k, (d, t) in enumerate(corpus)]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, count long").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
