"""Sharding: minimax contiguous partition of ordered atomic groups.

Rows with one key form a group that no shard splits; groups are in the order of their keys. The smallest
capacity is found by binary search between the greatest group or the mean shard and their sum; each
capacity is checked greedily. The ordered group sizes lie in the shared folder. The driver knows prefix sums only at some of the
groups' borders, at first every ``BLOCK_GROUPS``: a greedy check that may cut at known borders only tells which capacities
surely do, one that may cut anywhere between them which surely don't, and the two bound where each cut falls. One Spark job then splits
all stretches in which a cut may still fall, into about ``FINER`` pieces in all, and so on until the stretches are single groups:
capacity and cuts are exact, after a number of jobs that is the logarithm of the groups to the base of some hundreds. The driver holds a
number for each block of groups, whatever the number of groups; texts aren't moved at all.

Nulls and edge cases: rows with a null key form one group, the first; null texts have size 0; an empty
table gives no shards; a group greater than the mean shard is a shard's least capacity; where fewer than
``shards`` shards do, fewer are used. Equal keys always share a shard; NaN keys are one group, the last.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SHARDS, BLOCK_GROUPS, FINER = 64, 65_536, 1 << 18


class _Sizes:
    """Ordered group sizes, and the prefix sums at the borders known so far: stretches of rows r0 to r1 of a partition p."""

    def __init__(self, groups: DataFrame, block_groups: int):
        self.spark, self.size = groups.sparkSession, block_groups

        def number(batches):
            n = 0
            for batch in batches:
                at = np.arange(n, n + batch.num_rows)
                n += batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], ["p", "k", "n", "r"])

        ordered = groups.repartitionByRange(F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first())
        kind = groups.schema["k"].dataType.simpleString()
        self.table = C.save(ordered.select(F.spark_partition_id().alias("p"), "k", "n").mapInArrow(number, f"p int, k {kind}, n long, r long"))
        block = F.floor(F.col("r") / block_groups).alias("b")
        # one row for each block of groups
        got = self.table.groupBy("p", block).agg(F.min("r").alias("r0"), (F.max("r") + 1).alias("r1"), F.sum("n").alias("n"), F.max("n").alias("most")).toArrow().to_pandas()
        self.most = int(got.most.max()) if len(got) else 0
        self._hold(got)

    def _hold(self, rows: pd.DataFrame) -> None:
        self.rows = rows.sort_values(["p", "r0"], ignore_index=True)[["p", "r0", "r1", "n"]]
        self.borders = np.concatenate([[0], np.cumsum(self.rows.n.to_numpy(np.int64))]).astype(np.int64)
        self.single = (self.rows.r1 - self.rows.r0).to_numpy() == 1
        self.total = int(self.borders[-1])

    def greedy(self, capacity: int, shards: int, anywhere: bool) -> list[int]:
        """Sums before the cuts, as many at most as ``shards``: cuts at known borders only, or anywhere within unknown stretches."""
        cuts, at = [], 0
        while at + capacity < self.total and len(cuts) < shards:
            i = int(np.searchsorted(self.borders, at + capacity, "right")) - 1
            at = at + capacity if anywhere and not self.single[i] else max(at, int(self.borders[i]))
            cuts.append(at)
        return cuts

    def least(self, lo: int, hi: int, shards: int, anywhere: bool) -> int:
        """The least capacity from lo to hi that does with so many shards; hi, if none is known to."""
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if len(self.greedy(mid, shards, anywhere)) < shards else (mid + 1, hi)
        return hi

    def refine(self, open_: np.ndarray, finer: int) -> None:
        """Split the marked stretches, in one job."""
        of = self.rows[open_].copy()
        of["step"] = -(-(of.r1 - of.r0) // max(2, finer // len(of)))
        of["b"] = of.r0 // self.size
        some = self.spark.createDataFrame(of[["p", "b", "r0", "r1", "step"]], "p int, b long, r0 long, r1 long, step long")
        # stretches lie within blocks, and there are few
        rows = self.table.withColumn("b", F.floor(F.col("r") / self.size)).join(F.broadcast(some), ["p", "b"]).where("r0 <= r and r < r1")
        got = rows.groupBy("p", "r0", F.expr("(r - r0) div step").alias("i")).agg(F.min("r").alias("a"), (F.max("r") + 1).alias("z"), F.sum("n").alias("n")).toArrow().to_pandas()
        self._hold(pd.concat([self.rows[~open_], got.drop(columns="r0").rename(columns={"a": "r0", "z": "r1"})[["p", "r0", "r1", "n"]]]))

    def keys(self, sums: list[int]) -> list:
        """The keys of the groups that begin at these borders, the last of those that do."""
        at = [int(np.searchsorted(self.borders, s, "right")) - 1 for s in sums]
        begin = self.rows.iloc[at]
        some = self.spark.createDataFrame([(int(p), int(r)) for p, r in zip(begin.p, begin.r0)], "p int, r long")
        found = {(r.p, r.r): r.k for r in self.table.join(F.broadcast(some), ["p", "r"]).collect()}  # one for each shard
        return [found[int(p), int(r)] for p, r in zip(begin.p, begin.r0)]


def cuts(docs: DataFrame, key, size, shards: int = SHARDS, block_groups: int = BLOCK_GROUPS, finer: int = FINER) -> tuple[int, list]:
    """The smallest capacity and the keys at which its shards begin."""
    sizes = _Sizes(docs.groupBy(key.alias("k")).agg(F.sum(size).cast("long").alias("n")), block_groups)
    mean = -(-sizes.total // shards)
    lo, hi = max(sizes.most, mean), sizes.most + mean
    while True:
        lo, hi = sizes.least(lo, hi, shards, True), sizes.least(lo, hi, shards, False)
        near, far = sizes.greedy(lo, shards, False), sizes.greedy(hi, shards, True)
        open_ = np.zeros(len(sizes.rows), bool)
        for j in range(max(len(near), len(far))):
            a, b = (x[j] if j < len(x) else sizes.total for x in (near, far))
            a, b = min(a, b), max(a, b)
            if a < b:
                i, k = np.searchsorted(sizes.borders, [a, b], "right") - 1
                open_[max(i, 0) : k + 1] = True
        open_ &= ~sizes.single
        if not open_.any():
            break
        sizes.refine(open_, finer)
    found = sizes.greedy(hi, shards, False)
    keys = sizes.keys(found) if found else []
    C.discard(sizes.table)
    return hi, keys


def sharded(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, name: str = "shard", block_groups: int = BLOCK_GROUPS, order=None, finer: int = FINER) -> DataFrame:
    """The rows, all columns as they were, with the number of their shard (in a column of another name if there is one so called).

    ``order`` is an expression to take instead of the key's column.
    """
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    key = F.col(key) if order is None else order
    _, begins = cuts(docs, key, F.coalesce(F.octet_length(F.col(text)), F.lit(0)), shards, block_groups, finer)
    if not begins:
        return docs.withColumn(name, F.lit(0))
    kind = docs.select(key.alias("k")).schema["k"].dataType
    # as many as shards; an order in which null is the first, as above
    return docs.withColumn(name, F.when(key.isNull(), 0).otherwise(F.size(F.filter(F.array(*(F.lit(b).cast(kind) for b in begins)), lambda b: b <= key))))
