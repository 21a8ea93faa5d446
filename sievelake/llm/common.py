"""Shared pieces: vectorised tokens, tables in the shared folder, checked broadcasts, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in estimated bytes, that is broadcast; beyond it the join is shuffled.
BROADCAST_BYTES = 32 << 20
#: Bytes of text that one vectorised step handles at once.
BLOCK = 1 << 18

#: Bytes of an Arrow batch, and what the session has by default.
_BATCH, _BATCH_DEFAULT = 4 << 20, "67108864b"

_WORD = np.zeros(256, bool)
_WORD[0x80:] = True
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_":
    _WORD[_c] = True
_FOLD = np.arange(256, dtype=np.uint64) + np.uint64(1)
for _c in range(ord("A"), ord("Z") + 1):
    _FOLD[_c] = _c + 33
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    size = max(BLOCK + 1, n + 1)
    if size not in _powers:
        _powers.clear()
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Tokens:
    """Words of a column of texts: hash, byte range and row of each, in order.

    A word is a maximal run of letters, digits, underscores and non-ASCII bytes. ASCII is folded
    to lower case here; lower() the column in the JVM first where other letters need folding.
    A null text has no words. ``prefix[k]`` is the hash of the first k bytes of each word.
    """

    def __init__(self, column, prefixes: tuple[int, ...] = ()):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        self.rows = len(column)
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + self.rows + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        base = int(off[0]) if self.rows else 0
        off = off - base
        raw = raw[base : base + int(off[-1])] if self.rows else raw[:0]
        self.raw, self.offsets = raw, off
        hashes, starts, ends, pre = [], [], [], {k: [] for k in prefixes}
        a, n = 0, len(raw)
        while a < n:
            b = min(n, a + BLOCK)
            word = _WORD[raw[a:b]]
            if b < n and word[-1]:
                gaps = np.flatnonzero(~word)
                edge = off[np.searchsorted(off, b, "right") - 1]
                cut = max(int(gaps[-1]) + 1 if len(gaps) else 0, int(edge) - a)
                if cut > 0:
                    b, word = a + cut, word[:cut]
            inner = off[np.searchsorted(off, a, "left") : np.searchsorted(off, b, "left")] - a
            first = word.copy()
            first[1:] &= ~word[:-1]
            first[inner] = word[inner]
            last = word.copy()
            last[:-1] &= ~word[1:]
            inner = inner[inner > 0]
            last[inner - 1] = word[inner - 1]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            if len(s):
                up, down = _tables(b - a)
                total = np.zeros(b - a + 1, np.uint64)
                np.cumsum(_FOLD[raw[a:b]] * up[: b - a], out=total[1:])
                hashes.append(mix((total[e] - total[s]) * down[s]))
                for k in prefixes:
                    pre[k].append(mix((total[np.minimum(s + k, e)] - total[s]) * down[s] + np.uint64(k)))
                starts.append(s + a)
                ends.append(e + a)
            a = b
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.hash, self.start, self.end = cat(hashes, np.uint64), cat(starts, np.int64), cat(ends, np.int64)
        self.prefix = {k: cat(v, np.uint64) for k, v in pre.items()}
        #: words of row i are first[i]:first[i + 1]
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.count)
        #: place of each word in its own text
        self.place = np.arange(len(self.hash)) - np.repeat(self.first[:-1], self.count)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether they lie in one text."""
        size = len(self.hash)
        out = np.zeros(size, np.uint64)
        if size >= n:
            g = np.zeros(size - n + 1, np.uint64)
            for k in range(n):
                g = g * np.uint64(0xD6E8FEB86659FD93) + self.hash[k : size - n + 1 + k]
            out[: size - n + 1] = mix(g)
        return out, self.place + n <= np.repeat(self.count, self.count)


def slices(batch: pa.RecordBatch, name: str, most: int = 4 << 20):
    """Parts of a batch that hold about ``most`` bytes of the named text column, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started."""
    settle(spark)
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def settle(spark: SparkSession) -> None:
    """Keep Arrow batches small, unless the session says how large: by default one holds 10,000 rows, however long their texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "-1", _BATCH_DEFAULT):
        spark.conf.set(name, str(_BATCH))


def shared(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sievelake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def save(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again; this cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared(spark)}/sievelake-{uuid.uuid4().hex}"
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sievelake_path = path  # type: ignore[attr-defined]
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by save() that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._sievelake_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a saved table for broadcast if its counted rows stay under the limit; else leave it to a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names, made from the given ones, that the table doesn't have (case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Forest:
    """Connected groups of places 0 to n, joined by batches of pairs."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        p = self.parent
        while True:
            x, y = p[a], p[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(p, np.maximum(x, y), np.minimum(x, y))
            while (p[p] != p).any():
                p = p[p]
        self.parent = p


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each end of the undirected edges (a, b), saved; component is its smallest node.

    Alternating large-star and small-star steps over saved tables, a logarithmic number of rounds.
    """
    pairs = save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = save(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # every edge now points from the larger node a to the smaller node b
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        after = joined.where("b <> m").select(F.col("m").alias("a"), "b").union(joined.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        after = save(after)
        now = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        discard(pairs, large)
        pairs = after
        if (now.n, now.h) == mark:
            break
        mark = now.n, now.h
    out = save(pairs.select(F.col("b").alias("node"), F.col("a").alias("component")).union(pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()))
    discard(pairs)
    return out
