"""Suffix-array dedup: a logarithmic family of sparse suffix arrays over words.

Suffixes start at anchors: words whose run of ``GRAM`` words has the least hash among ``SPAN`` runs in a
row. Which words of a passage are anchors depends on the passage alone, so of two equal passages of
``LENGTH`` words the same anchor lies among the first SPAN words, and their suffixes there share at least
``PREFIX = LENGTH - SPAN + 1`` words. A suffix array holds (fingerprint of the first PREFIX words, document,
place), sorted by the fingerprint: an order in which equal prefixes are neighbours, which is all that
matching asks of it (a fingerprint index in the place of full suffix arrays: texts aren't compared beyond PREFIX words). Arrays are tables
bucketed by the fingerprint, so scans of two arrays side by side, and merges, go bucket by bucket without an exchange.

Documents come in ``batches``; one scan finds the suffixes of all. Each new batch gets its array, which is scanned against that of every level
for fingerprints in both; then it becomes level 0, and two arrays of one level merge into one of the next, so
each suffix is rewritten once a level. A passage is reported in all documents that hold it.

A suffix match is a candidate. Around candidates alone, the runs of LENGTH words that hold a matched suffix's first
words are compared between documents, so that exactly the passages of LENGTH words or more that two documents share
are reported, to the word. These runs go once to a table bucketed by their fingerprints, of which least and greatest document tell those
that repeat: streamed aggregates and a semi-join, so a passage that a third of all documents hold is never held in memory. Nulls and edge cases: null, empty and
shorter texts have no suffixes; rows with one doc_id (null too) are one document, and a passage that repeats
only inside it isn't reported; repeated rows' spans are given once; texts are read whole.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

LENGTH, SPAN, GRAM, BATCHES = 50, 16, 4, 4
PREFIX = LENGTH - SPAN + 1


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of ``width`` values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = op(x[:-step], x[step:])
        have += step
    return x


def anchors(t: C.Tokens, span: int = SPAN, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray]:
    """Places among the tokens at which suffixes start, and the fingerprints of their first words."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(t.hash) < max(prefix, span + GRAM - 1):
        return none
    g, inside = t.grams(GRAM)
    g = np.where(inside, g, np.uint64(0xFFFFFFFFFFFFFFFF))
    if len(g) < span:
        return none
    least = _slide(g, span, np.minimum)
    # a run is the least of some window of runs if the greatest of those windows' least is its own
    pad = np.zeros(span - 1, np.uint64)
    top = _slide(np.concatenate([pad, least, pad]), span, np.maximum)
    at = np.flatnonzero((top == g) & inside & (t.place + prefix <= np.repeat(t.count, t.count)))
    return at, _prints(t, at, prefix)


class _Array:
    """A table bucketed and sorted by the fingerprint, in the shared folder: a suffix array, or the runs of words around its matches."""

    def __init__(self, rows: DataFrame, buckets: int):
        self.spark, self.name = rows.sparkSession, f"sievelake_{uuid.uuid4().hex}"
        self.path = f"{C.shared(self.spark)}/{self.name}"
        rows.write.bucketBy(buckets, "f").sortBy("f").option("path", self.path).saveAsTable(self.name)
        self.table = self.spark.table(self.name)

    @classmethod
    def of(cls, rows: DataFrame, buckets: int) -> _Array:
        return cls(rows.repartition(buckets, "f"), buckets)

    def merged(self, other: _Array, buckets: int) -> _Array:
        """Both as one array. Rows are distinct as they are; asking for that keeps a union of buckets in buckets, without an exchange."""
        return _Array(self.table.union(other.table).distinct(), buckets)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.table._sievelake_path = self.path
        C.discard(self.table)


def suffixes(docs: DataFrame, key: str, text: str, span: int, prefix: int) -> DataFrame:
    def find(batches):
        for batch in batches:
            for part in C.slices(batch, "t"):
                t = C.Tokens(part.column("t"))
                at, prints = anchors(t, span, prefix)
                yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), part.column("d").take(pa.array(t.row[at])), pa.array(t.place[at].astype(np.int32))], ["f", "d", "p"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("d"), F.lower(F.col(text)).alias("t")).where("t is not null").mapInArrow(find, f"f long, d {kind}, p int")


def _prints(t: C.Tokens, at: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of the runs of ``length`` words at some places of the tokens."""
    up, down = C._tables(len(t.hash))
    total = np.zeros(len(t.hash) + 1, np.uint64)
    np.cumsum(t.hash * up[: len(t.hash)], out=total[1:])
    return C.mix((total[at + length] - total[at]) * down[at])


def _windows(docs: DataFrame, spots: DataFrame, key: str, text: str, length: int, span: int) -> DataFrame:
    """(f, d, p): fingerprint, document and place of each run of ``length`` words that holds a matched suffix's first words."""
    rows = docs.select(F.col(key).alias("d"), F.lower(F.col(text)).alias("t")).where("t is not null")
    size = spots.agg(F.sum(4 * F.size("ps") + 40)).first()[0] or 0
    # places are broadcast while they are small; beyond that the documents are shuffled to them
    held = F.broadcast(spots) if size <= C.BROADCAST_BYTES else spots
    rows = rows.join(held, F.col("d").eqNullSafe(F.col("e"))).select("d", "t", "ps")

    def find(batches):
        for batch in batches:
            for part in C.slices(batch, "t", 1 << 20):
                t = C.Tokens(part.column("t"))
                lists = part.column("ps")
                at = t.first[np.repeat(np.arange(t.rows), lists.value_lengths().to_numpy(zero_copy_only=False))] + lists.flatten().to_numpy()
                mark = np.zeros(len(t.hash) + 1, np.int64)
                owner = np.repeat(np.arange(t.rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                ok = at < t.first[owner + 1]  # another row's places, where rows share an id
                at, owner = at[ok], owner[ok]
                np.add.at(mark, np.maximum(at - span + 1, t.first[owner]), 1)
                np.add.at(mark, at + 1, -1)
                at = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
                at = at[t.place[at] + length <= t.count[t.row[at]]]
                yield pa.RecordBatch.from_arrays([pa.array(_prints(t, at, length).view(np.int64)), part.column("d").take(pa.array(t.row[at])), pa.array(t.place[at].astype(np.int32))], ["f", "d", "p"])

    return rows.mapInArrow(find, f"f long, d {docs.schema[key].dataType.simpleString()}, p int")


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, span: int = SPAN, batches: int = BATCHES, buckets: int | None = None) -> DataFrame:
    """(doc_id, start_word, end_word): each span of a document, end exclusive, that another document repeats."""
    spark, prefix = docs.sparkSession, length - span + 1
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    levels: dict[int, _Array] = {}
    hits: list[DataFrame] = []
    every = C.save(suffixes(docs, key, text, span, prefix).withColumn("b", F.pmod(F.xxhash64("d"), F.lit(batches))), "b")
    for b in range(batches):
        new = _Array.of(every.where(F.col("b") == b).select("f", "d", "p"), buckets)
        own = new.table.groupBy("f").agg(F.min(F.xxhash64("d")).alias("lo"), F.max(F.xxhash64("d")).alias("hi")).where("lo <> hi").select("f")
        for level in levels.values():
            own = own.union(level.table.join(new.table.select("f"), "f", "left_semi").select("f"))
        hits.append(C.save(own.distinct()))
        at = 0
        while at in levels:
            old = levels.pop(at)
            merged = new.merged(old, buckets)
            new.drop()
            old.drop()
            new, at = merged, at + 1
        levels[at] = new
    C.discard(every)
    found = hits[0]
    for more in hits[1:]:
        found = found.union(more)
    found = found.distinct()
    spots = None
    for level in levels.values():
        some = level.table.join(found, "f", "left_semi").select("d", "p")
        spots = some if spots is None else spots.union(some)
    spots = C.save(spots.groupBy(F.col("d").alias("e")).agg(F.collect_set("p").alias("ps")))
    for level in levels.values():
        level.drop()
    C.discard(*hits)
    windows = _Array.of(_windows(docs, spots, key, text, length, span), buckets)
    C.discard(spots)
    counted = windows.table.groupBy("f").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("d").alias("named"), F.count("*").alias("n"))
    exact = C.save(windows.table.join(counted.where("lo <> hi or named > 0 and named < n").select("f"), "f", "left_semi").select("d", "p"))
    windows.drop()
    w = Window.partitionBy("d").orderBy("p")
    rows = exact.withColumn("new", F.coalesce((F.col("p") > F.lag("p").over(w) + length).cast("int"), F.lit(1)))
    rows = rows.withColumn("i", F.sum("new").over(w))
    out = C.save(rows.groupBy("d", "i").agg(F.min("p").alias("start_word"), (F.max("p") + length).alias("end_word")).select(F.col("d").alias(key), "start_word", "end_word"))
    C.discard(exact)
    return out
