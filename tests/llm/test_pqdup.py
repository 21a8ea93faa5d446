import numpy as np
import pytest

from sievelake.llm import pqdup


def brute(x: np.ndarray, cosine: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Class and links of each row, all against all."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= cosine - 1e-7
    label = np.arange(len(x))
    while True:
        after = np.array([label[row].min() for row in near])
        if (after == label).all():
            return label, near.sum(1) - 1
        label = after


def run(spark, x, **how):
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in pqdup.similar(table, **how).collect())
    assert [r[0] for r in got] == list(range(len(x)))
    return np.array([r[1] for r in got]), np.array([r[2] for r in got])


def recall(spark, x, **how) -> float:
    label, links = brute(x.astype(np.float32))
    got_label, got = run(spark, x, **how)
    assert links.sum() > 400 and (got <= links).all()
    if (got == links).all():
        assert (got_label == label).all()
    return got.sum() / links.sum()


def planted(g, d: int) -> np.ndarray:
    x = g.normal(size=(600, d))
    return np.concatenate([x, x[:150] + g.normal(size=(150, d)) * 0.05, np.repeat(x[7:8], 30, 0), x[200:260] + g.normal(size=(60, d)) * 0.25])


@pytest.mark.parametrize("d", [16, 64])
def test_all_directions(spark, d):
    """Vectors in all directions: the certain probes lose nothing, the likely ones hardly anything."""
    x = planted(np.random.default_rng(1), d)
    how = {"sample": 640, "list_rows": 20, "part_rows": 64, "ask_rows": 100}
    assert recall(spark, x, **how, sure=100) == 1
    assert recall(spark, x, **how) >= 0.98


def test_few_directions(spark):
    """Vectors of 4 or 5 directions among 64 or 256 columns, at two sizes; and of many such planes: nothing is lost."""
    g = np.random.default_rng(3)
    for n in (500, 1500):
        x = g.normal(size=(n, 5)) @ g.normal(size=(5, 64)) + 0.02 * g.normal(size=(n, 64))
        assert recall(spark, x, sample=n, list_rows=16, part_rows=64, ask_rows=400) == 1
    x = g.normal(size=(1200, 4)) @ g.normal(size=(4, 256))
    assert recall(spark, x, sample=1000, list_rows=16, part_rows=64) == 1
    x = np.concatenate([10 * g.normal(size=64) / 8 + g.normal(size=(150, 4)) @ g.normal(size=(4, 64)) for _ in range(8)])
    assert recall(spark, x, sample=1200, list_rows=16, part_rows=64) >= 0.98


def test_hot_group_of_near_copies(spark):
    """A third of the rows within one group, cut into parts of lists and of queries."""
    g = np.random.default_rng(5)
    x = np.concatenate([g.normal(size=(400, 32)), g.normal(size=(1, 32)) * 3 + 0.05 * g.normal(size=(200, 32))])
    label, links = brute(x.astype(np.float32))
    got_label, got = run(spark, x, list_rows=30, part_rows=32, ask_rows=50)
    assert (got == links).all() and (got_label == label).all() and links.max() == 199


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, 0.0, 0.0]), (8, [None, 1.0]), (9, [inf, 1.0]), (10, [2.0, 0.0, 0.0]), (11, [0.0, 1.0]), (None, [0.0, 1.0]), (None, None)]
    table = spark.createDataFrame([(*r, 3, "x") for r in rows], "vec_id long, embedding array<double>, l int, k string")
    got = sorted(tuple(r) for r in pqdup.similar(table).where("vec_id is not null").collect())
    assert got == [(1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 7, 1), (8, 8, 0), (9, 9, 0), (10, 7, 1), (11, 11, 1)]
    assert sorted(tuple(r) for r in pqdup.similar(table).where("vec_id is null").collect()) == [(None, None, 0), (None, None, 1)]
    assert pqdup.similar(table.limit(0)).count() == 0
