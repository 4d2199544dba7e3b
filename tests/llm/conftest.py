import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", "er"]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared passages, nulls, empty, blank and long texts, one row twice."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    passage = prose(rng, 30)
    texts = list(base)
    texts += [base[3], base[3], base[7], base[7] + " tail"]
    long = prose(rng, 200)
    near = long.split()
    near[100] = "changed"
    texts += [long, " ".join(near), long.upper(), long.replace(" ", "\n", 20)]
    texts += [f"{prose(rng, 15)}\n{passage}\n{prose(rng, 10)}" for _ in range(8)]
    texts += [passage + " " + passage, "word " * 50, None, "", " \n\t ", "...", "one", "a b c d", "ü " * 30, prose(rng, 6000), "naïve  double  space\r\nCRLF x"]
    rows = [(k * 3, t, "en" if k % 2 else "fr", f"s{k % 3}" if k % 11 else None, None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id here but some words anyway", None, "s0", 5)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
