import random

import pytest

SCHEMA = "doc_id long, text string, source string, k string, t int, f string, shard string, __k string"


def words(seed: int, n: int, size: int = 4000) -> str:
    g = random.Random(seed)
    return " ".join(f"w{int(size * g.random() ** 2)}" for _ in range(n))


@pytest.fixture(scope="session")
def text():
    return words


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every oddity: nulls, empty and long texts, repeats, clashing column names."""
    long = words(1, 30_000)
    rows = [(1, words(2, 80), "a"), (1, words(2, 80), "a"), (2, None, "a"), (3, "", None), (4, "   \n ", "b"), (5, long, "b"), (6, long + " end", None), (None, words(3, 60), "a"), (None, None, None), (7, "one", "b"), (8, "ONE", "b"), (9, "É è ñ — 漢字", "c"), (10, "a" * 300_000, "c")]
    return spark.createDataFrame([(*r, "k", 1, None, "s", None) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
