import random

import pytest


WORDS = ["alpha", "beta", "Gamma", "delta,", "épsilon", "zeta.", "eta", "theta", "iota", "kappa", "it's", "42", "漢字", "x|y", "lambda", "mu"]
SCHEMA = "doc_id long, text string, lang string, key long, kept string, index string"


@pytest.fixture(scope="session")
def texts():
    """Nulls, empty and long texts, ties, repeated rows, near copies, shared passages."""
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))
    passage, base = prose(30), prose(120)
    near = base.replace(base.split()[60], "changed")
    out = [None, "", " ", "\t\n", "a", "a b", "same text here", "same  text\there", base, near, base, f"{prose(5)} {passage} {prose(9)}", f"{passage}\n{prose(8)}", passage, "z" * 3000, "ab" * 200, " " * 300 + "end"]
    out += [prose(rng.randint(1, 60)) for _ in range(30)] + [prose(4000)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(100 - i, t, "en", 1, "no", "i") for i, t in enumerate(texts)]
    rows += [rows[8], rows[14], (None, "same text here", None, None, None, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
