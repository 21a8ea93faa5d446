import random
from collections import defaultdict

from pyspark.sql import functions as F

from sievelake.llm import sharding


def best(sizes, shards):
    """Least possible greatest shard, by trying every capacity."""
    for c in range(max(sizes), sum(sizes) + 1):
        n, at = 1, 0
        for s in sizes:
            if at + s > c:
                n, at = n + 1, 0
            at += s
        if n <= shards:
            return c


def test_capacity_is_the_least(spark):
    g = random.Random(1)
    for shards in (1, 3, 7):
        sizes = [g.randrange(1, 40) for _ in range(120)]
        docs = spark.createDataFrame([(i * 3, "x" * (s if n == 0 else 0)) for i, s in enumerate(sizes) for n in range(1 + i % 2)], "doc_id long, text string").repartition(4)
        by = defaultdict(int)
        order = {}
        for r in sharding.sharded(docs, shards=shards, block_groups=16).collect():
            by[r.shard] += len(r.text)
            assert order.setdefault(r.doc_id, r.shard) == r.shard
        assert max(by.values()) == best(sizes, shards) and len(by) <= shards
        assert [order[k] for k in sorted(order)] == sorted(order.values())


def test_stretches_are_split_as_far_as_needed(spark):
    """Blocks larger than the table, few pieces a job, sizes from 0 to huge: the least capacity and exact cuts still, in few jobs."""
    g = random.Random(2)
    for shards, finer in ((5, 4), (16, 64), (40, 1 << 18)):
        sizes = [g.choice([0, 0, 1, 2, 30, g.randrange(300)]) for _ in range(400)]
        docs = spark.createDataFrame([(i, "x" * s) for i, s in enumerate(sizes)], "doc_id long, text string").repartition(4)
        by = defaultdict(int)
        for r in sharding.sharded(docs, shards=shards, block_groups=1 << 16, finer=finer).collect():
            by[r.shard] += len(r.text)
        assert max(by.values()) == best(sizes, shards) and len(by) <= shards


def test_order_of_an_expression(spark):
    docs = spark.createDataFrame([(i, "x" * (1 + i % 7)) for i in range(200)], "doc_id long, text string")
    got = sorted((-r.doc_id, r.shard) for r in sharding.sharded(docs, shards=6, order=-F.col("doc_id")).collect())
    assert [s for _, s in got] == sorted(s for _, s in got) and {s for _, s in got} == set(range(6))


def test_odd_rows(odd, none):
    out = sharding.sharded(odd, shards=4)
    assert out.columns == [*odd.columns, "shard_"] and out.count() == odd.count()
    assert {r.shard_ for r in out.where("doc_id is null").collect()} == {0}
    assert sharding.sharded(none).count() == 0
    assert {r.shard for r in sharding.sharded(odd.drop("shard"), key="source", shards=2).where("source = 'c'").collect()} == {1}
