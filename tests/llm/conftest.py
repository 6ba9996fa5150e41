import random

import pytest

WORDS = "the of and to in der die und le la et de el que alpha beta gamma delta kappa sigma omega".split()


def text(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "x", "yz", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows and ids, near copies, clashing column names."""
    rnd = random.Random(4)
    base = text(rnd, 60)
    near = base.split()
    near[30] = "changed"
    rows = [(i, text(rnd, rnd.randint(1, 80)), "en" if i % 2 else "de") for i in range(40)]
    rows += [(50, base, "en"), (51, base.upper(), "en"), (52, " ".join(near), None), (53, base + " tail", "de")]
    rows += [(60, None, "en"), (61, "", "en"), (62, " \n\t ", "de"), (63, "...", None), (64, "a", "en"), (65, "A b", "en")]
    rows += [(70, text(rnd, 30_000), "en"), (70, "another text of the same id", "en"), (50, base, "en"), (None, base, "en"), (None, None, None)]
    rows += [(71, "w" * 20_000, "en"), (72, "é中🎉 ñ ÀÉ", "fr")]
    cols = "doc_id long, text string, lang string, score double, id long, node string, number string"
    return spark.createDataFrame([(*r, 0.5, 7, "x", "y") for r in rows], cols)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
