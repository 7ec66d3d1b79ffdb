import random

import pytest
from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cls string, key string, ids string"


def words(rng, n, stock=("alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "zeta", "lambda", "rho", "tau")):
    return [rng.choice(stock) + str(rng.randint(0, 400)) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Texts with nulls, empties, a long text, copies, near copies, repeated rows and repeated ids."""
    rng = random.Random(5)
    base = [" ".join(words(rng, rng.randint(1, 150))) for _ in range(40)]
    shared = " ".join(words(rng, 45))
    texts = base + base[:6] + [None, "", "   \n", "x", "one two three", "one two three", "aé漢🙂 ▁ b\t\tc  d\n"]
    for i in range(8):
        w = base[20 + i % 3].split() + words(rng, 120)
        w = (base[30] + " " + base[31] + " " + base[32]).split() if i > 3 else w
        w[rng.randrange(len(w))] = f"changed{i}"
        texts.append(" ".join(w))
    texts += [f"{' '.join(words(rng, 20))} {shared} {' '.join(words(rng, 20))}" for _ in range(12)]
    texts += ["la " * 300, " ".join(words(rng, 6000))]
    return texts


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [Row(i, t, ["en", "fr", None][i % 3], ["b", "a", None, "c"][i % 4], None if i % 7 == 0 else len(t or ""), "cls", "key", "ids") for i, t in enumerate(corpus)]
    rows += [rows[3], rows[3], Row(None, corpus[5], None, None, None, "cls", "key", "ids"), Row(7, corpus[8], "en", "a", 3, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
