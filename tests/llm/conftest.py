import random

import pytest
from pyspark.sql import functions as F

from salesmix.llm.common import prepare

EXTRA = {"spans": 1, "copied": "x", "removed": 2.0, "n_near": None, "key": 3, "score": "s", "BEFORE": 4,
         "component": 5, "rank": 6}


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("aehinorstl") for _ in range(rng.randint(1, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def texts(words):
    """Texts with copies, near copies, shared passages, odd and very long ones; some null or empty."""
    rng = random.Random(9)
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 120))) for _ in range(40)]
    passage = " ".join(rng.choice(words) for _ in range(90))
    near = []
    for _ in range(12):
        w = prose[0].split() + passage.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        near.append(" ".join(w))
    odd = [None, None, "", "", " \t\n", "one", "two words", "One\ntwo\x0bthree  four", "a" * 3000, "ab " * 4000,
           "É ß İ Σς ﬁ 汉字 🙂 \x00 <|endoftext|> x", "don't 'S it's 12½ <|startoftext|>", "idiot", "i d i o t"]
    shared = [prose[k] + "\n" + passage + "\n" + prose[k + 1] for k in range(5)]
    return prose + prose[:6] + prose[:3] + near + odd + shared + [" ".join(rng.choice(words) for _ in range(30_000))]


@pytest.fixture(scope="session")
def rows(texts):
    return [(k * 7 % 1009, t) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The texts as a table of several partitions with columns whose names invite clashes."""
    prepare(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df = df.withColumns({c: F.lit(v).cast("string" if v is None else "string") for c, v in EXTRA.items()})
    return df.withColumns({"lang": F.lit("en"), "source": F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b"),
                           "n_chars": F.length("text").cast("long")})


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter("false")
