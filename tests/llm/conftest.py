import random

import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    r = random.Random(5)
    words = ["alpha", "Beta", "gam-ma", "délta", "x1", "日本", "e.g.", "<|endoftext|>"]
    text = lambda n: r.choice([" ", "\n", "  ", "\t "]).join(r.choice(words) for _ in range(n))
    rows = [(i, text(r.randint(1, 200)), r.choice(["a", "b", None]), 7, i) for i in range(60)]
    rows += [(100, None, "a", 0, 0), (101, "", "b", 0, 0), (102, " \n ", None, 0, 0), (103, text(9000), "c", 0, 0), (None, "no id", "a", 0, 0)]
    rows += [(104, "same same", "a", 0, 0)] * 3 + [(105 + i, "same same", "a", 0, 0) for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, shard int, size long").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
