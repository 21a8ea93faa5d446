"""Mixing sources to target weights: temperature, then budgeted block permutations.

Source shares of the tokens are raised to an exponent and normalised; 0 makes them uniform, 1 leaves them as they are. The exponent is
bisected. Where the shares' entropy is at most ``entropy`` times the greatest, it is the least at which the weights' is too and no source
is repeated more than ``epochs`` times; if none from 0 to 1 does, 1. Where the shares are more even than that, it is the greatest, up to
``STEEPEST``, at which the weights' entropy is still that much and no source is repeated more than ``epochs`` (or ``budget``, if that is
more) times: the target is met, or the repetition limit is reached first, or sources are so equal that no exponent tells them apart. Each source then gives its
weight's part of ``budget`` times all tokens: whole permutations of its documents, one after another,
and the beginning of a last one. A source's stream is cut into ``blocks`` equal parts, so that every
block holds the sources in their weights. A permutation is the order of a keyed MD5 of the document's
id (``order``), so a place in it is a range of keys: per source a few cut keys are found by a two-level prefix sum,
and each row then decides for itself how often it is used. No text is shuffled or joined, unless there are so many sources that their
plan is too large to broadcast.

Nulls and edge cases: a null source is a source of its own; texts without tokens (null ones too) are
left out, and so are sources that have nothing else; rows with one doc_id go together; a null doc_id is
a document like others, of key ''. With one source, or equal ones, the weights are equal.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common as C

ENTROPY, EPOCHS, BUDGET, BLOCKS, SEED, STEEPEST = 0.97, 2.0, 1.0, 16, "mix", 64.0
_SHIFT = 48  # keys have 60 bits, buckets of the prefix sum 12


def weights(tokens: list[int], entropy: float = ENTROPY, epochs: float = EPOCHS, budget: float = BUDGET) -> list[float]:
    """Normalised weights of sources with so many tokens; see the module."""
    total = sum(tokens)

    def at(x: float) -> list[float]:
        raised = [(t / total) ** x for t in tokens]
        return [r / sum(raised) for r in raised]

    def even(x: float) -> float:
        """Entropy over its target."""
        return -sum(p * math.log(p) for p in at(x) if p) - entropy * math.log(len(tokens)) if len(tokens) > 1 else 0.0

    def within(x: float, most: float) -> bool:
        return all(p * budget * total <= most * t for p, t in zip(at(x), tokens))

    if even(1.0) > 1e-12:
        lo, hi = 1.0, STEEPEST
        for _ in range(40):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if even(mid) >= 0 and within(mid, max(epochs, budget)) else (lo, mid)
        return at(lo)
    lo, hi = 0.0, 1.0
    if even(lo) <= 0 and within(lo, epochs):
        return at(lo)
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if even(mid) <= 0 and within(mid, epochs) else (mid, hi)
    return at(hi)


def token_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def order(column: str, epoch=None, seed: str = SEED):
    """The key of each document by whose order an epoch's permutation goes; the first's, if none is given."""
    epoch = F.lit(0) if epoch is None else epoch
    text = F.concat(F.lit(f"{seed}|"), epoch.cast("string"), F.lit("|"), F.coalesce(F.col(column).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", entropy: float = ENTROPY, epochs: float = EPOCHS, budget: float = BUDGET, blocks: int = BLOCKS, seed: str = SEED) -> DataFrame:
    """A row for each source: (source, uses), uses an array of (epoch, first block, cut keys, end key)."""
    spark = docs.sparkSession
    narrow = C.save(docs.select(F.col(source).alias("s"), F.col(key).alias("d"), token_count(text).alias("n")).where("n > 0"))
    totals = narrow.groupBy("s").agg(F.sum("n").alias("n")).collect()  # one row for each source
    totals.sort(key=lambda r: (r.s is None, str(r.s)))
    kind = docs.schema[source].dataType
    w = weights([r.n for r in totals], entropy, epochs, budget) if totals else []
    every = sum(r.n for r in totals)
    marks, parts = [], []
    for i, r in enumerate(totals):
        quota = math.floor(w[i] * budget * every)
        if quota < 1:
            continue
        parts.append((i, r.s, math.ceil(quota / r.n)))
        for j in range(1, blocks + 1):
            off = -(-quota * j // blocks)  # a document is of block j - 1 if it starts before this
            epoch = min((off - 1) // r.n, math.ceil(quota / r.n) - 1)
            marks.append((i, epoch, j, off - epoch * r.n))
    names = spark.createDataFrame(parts, T.StructType([T.StructField("i", T.IntegerType()), T.StructField("s", kind), T.StructField("e", T.IntegerType())]))
    rows = narrow.join(_few(names, len(parts)), narrow.s.eqNullSafe(names.s)).select("i", F.explode(F.sequence(F.lit(0), F.col("e") - 1)).alias("e"), "d", "n")
    rows = rows.select("i", "e", order("d", F.col("e"), seed).alias("k"), "n").withColumn("b", F.shiftright("k", _SHIFT))
    sums = rows.groupBy("i", "e", "b").agg(F.sum("n").alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy("i", "e").orderBy("b")) - F.col("n"))
    mark = spark.createDataFrame(marks, "i int, e int, j int, off long")
    at = C.save(sums.join(_few(mark, len(marks)), ["i", "e"]).where("before < off and off <= before + n").select("i", "e", "b", "j", "off", "before"))
    inside = rows.join(_few(at.select("i", "e", "b").distinct(), len(marks)), ["i", "e", "b"]).groupBy("i", "e", "b", "k").agg(F.sum("n").alias("n"))
    inside = inside.withColumn("start", F.sum("n").over(Window.partitionBy("i", "e", "b").orderBy("k")) - F.col("n"))
    # the first key that starts at the mark or after it; else the end of the bucket
    cuts = at.join(inside, ["i", "e", "b"]).groupBy("i", "e", "j", "b").agg(F.min(F.when(F.col("before") + F.col("start") >= F.col("off"), F.col("k"))).alias("cut"))
    found: dict[tuple[int, int], list] = {}
    for r in cuts.collect():
        found.setdefault((r.i, r.e), []).append((r.j, r.cut if r.cut is not None else (r.b + 1) << _SHIFT))
    C.discard(narrow, at)
    table = []
    for i, s, e in parts:
        uses, first = [], 0
        for epoch in range(e):
            own = sorted(found.get((i, epoch), []))
            end = own[-1][1] if epoch == e - 1 else 1 << 62
            uses.append((epoch, first, [cut for j, cut in own if j < blocks], end))
            first += len(own)
        table.append((s, uses))
    use = T.ArrayType(T.StructType([T.StructField("epoch", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("cuts", T.ArrayType(T.LongType())), T.StructField("end", T.LongType())]))
    return spark.createDataFrame(table, T.StructType([T.StructField("source", kind), T.StructField("uses", use)]))


def _few(table: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """Marked for broadcast, if so many rows are small enough; else left to a shuffled join."""
    return F.broadcast(table) if rows * row_bytes <= C.BROADCAST_BYTES else table


def _used(docs: DataFrame, key: str, text: str, source: str, seed: str, how: dict) -> tuple[DataFrame, str, str]:
    s, uses, use, k = C.fresh(docs, "s", "uses", "use", "k")
    table = plan(docs, key, text, source, seed=seed, **how).toDF(s, uses)  # one row for each source
    rows = docs.where(token_count(text) > 0).join(_few(table, table.count(), 1024), F.col(source).eqNullSafe(F.col(s)))
    rows = rows.withColumn(use, F.explode(uses)).withColumn(k, order(key, F.col(use)["epoch"], seed))
    return rows.where(F.col(k) < F.col(use)["end"]), use, k


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **how) -> DataFrame:
    """(doc_id, source, epoch, block): each use of a document."""
    rows, use, k = _used(docs.select(key, text, source), key, text, source, seed, how)
    block = F.col(use)["first"] + F.size(F.filter(F.col(use)["cuts"], lambda c: c <= F.col(k)))
    return rows.select(key, source, F.col(use)["epoch"].alias("epoch"), block.alias("block"))


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **how) -> DataFrame:
    """The documents as often as they are used, all columns as they were."""
    return _used(docs, key, text, source, seed, how)[0].select(docs.columns)
