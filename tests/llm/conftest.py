import random

import pytest
from pyspark.sql import types as T

WORDS = [a + b for a in "ba co di fu ga he ji ko lu ma ne pi".split() for b in "r l n s t m x d".split()]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "a", "o"]) for _ in range(n))


def edited(text, every, seed):
    """The text with one word in ``every`` replaced."""
    rng = random.Random(seed)
    words = text.split(" ")
    for i in range(every // 2, len(words), every):
        words[i] = f"edit{rng.randint(0, 10**6)}"
    return " ".join(words)


DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use for columns of their own
        T.StructField("key", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("n", T.StringType()),
        T.StructField("cid", T.StringType()),
        T.StructField("copies", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, source): originals, exact and near copies, shared passages, nulls, blanks, one long text."""
    rows = []
    add = lambda text, source="s0": rows.append((len(rows), text, source))
    base = [prose(120 + 10 * i, i) for i in range(12)]
    for i, t in enumerate(base):
        add(t, f"s{i % 4}")
    for i in range(6):  # a hot group of exact copies
        add(base[0])
    add(base[0].upper())
    for i in range(5):  # near copies
        add(edited(base[1], 60, i), "s1")
    chain = base[2]
    for i in range(4):  # each like the one before, the ends unlike
        chain = edited(chain, 30, 100 + i)
        add(chain, "s2")
    passage = prose(70, 999)
    for i in range(5):
        add(f"{prose(80 + i, 200 + i)}\n{passage} {prose(40 + i, 300 + i)}", "s3")
    add(prose(20, 5) + " " + prose(60, 6) + " x " + prose(60, 6))  # repeats itself
    add("one two three")
    add("One  two\tthree")
    add("")
    add(" \n\t ")
    add(None, None)
    add("word " * 3000, None)
    add(prose(20000, 77), "é")
    add("ñandú " + prose(90, 12) + " 中文 text\nline\nline\n\n")
    add("### *** a | b " * 40)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, "en", s, len(t or ""), "k", "z", "n", "c", "y") for i, t, s in corpus]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """A null id, a repeated id and a row that comes twice."""
    t = prose(130, 1)
    rows = [(None, t), (7, t), (7, t), (7, prose(130, 2)), (8, None), (8, None), (None, None)]
    return spark.createDataFrame([(i, x, "en", "s0", len(x or ""), "k", "z", "n", "c", "y") for i, x in rows], DOCS)
