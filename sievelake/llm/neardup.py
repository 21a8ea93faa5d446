"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

A shingle is a run of ``N`` words (the whole text where it has fewer). Its weight in a text is
(1 + ln tf) * idf. Document frequencies are counted over every row in a table of ``BUCKETS`` hashed
buckets, whose size doesn't depend on the input; a bucket's count errs by a fixed share of the rows,
so idf behaves alike at every size. ``K = BANDS * ROWS`` consistent samples (Ioffe 2010) make the
band keys. Texts that share a band key are candidates, and candidates are verified by their exact
weighted Jaccard similarity. A bucket of n texts first tests its smallest member, the hub, against the others;
then every pair in a bucket that those links left in different groups is tested too. So the groups
are the connected components over all verified candidate pairs, while n copies cost n tests. Where many texts share a
bucket without being similar (a template, say), those pairs are never rows: the bucket is cut into blocks of ``BLOCK`` texts, every two
blocks are a task of their own, which indexes their shingles once, adds up what each two texts share and gives a spanning forest of
the links found; a pair is left to the first bucket that it shares. Texts go to tasks rather than their shingles' weights, which are
larger; a hub's text is repeated for each ``HUB_PAIRS`` of its pairs, so that no task holds all of them.

Nulls and edge cases: a null text is nobody's duplicate; texts without words (empty ones too) are
duplicates only of identical texts; repeated rows and rows that share a doc_id are ordinary
duplicates; a null doc_id sorts last as a keeper. Texts of any length are used whole.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

N, BANDS, ROWS, THRESHOLD = 2, 20, 3, 0.5
BUCKETS = 1 << 18
SMALL, BLOCK, HUB_PAIRS = 8, 256, 1_024
_TABLE = 1 << 13


@lru_cache(2)
def _draws(k: int) -> tuple[np.ndarray, ...]:
    """r, 1/r, ln c - r and beta of the samples, by parts of a shingle's hash (tabulation)."""
    g = np.random.Generator(np.random.PCG64(20100708))
    r = g.gamma(2.0, 1.0, (_TABLE, k)).astype(np.float32).clip(1e-3)
    c = np.log(g.gamma(2.0, 1.0, (_TABLE, k)).clip(1e-30)).astype(np.float32)
    return r, c, g.random((_TABLE, k), np.float32)


def shingles(t: C.Tokens, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each distinct shingle of each text, ordered by row and hash."""
    g, inside = t.grams(n)
    row, h = t.row[inside], g[inside]
    short = np.flatnonzero((t.count > 0) & (t.count < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = t.count[short] > k
            extra[has] = extra[has] * np.uint64(31) + t.hash[t.first[short[has]] + k]
        row, h = np.concatenate([row, short]), np.concatenate([h, C.mix(extra)])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


def frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Document frequency of each bucket over all rows, and the number of rows with a text."""

    def count(batches):
        total, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for part in C.slices(batch, "t"):
                row, h, _ = shingles(C.Tokens(part.column("t")))
                key = np.unique(row * BUCKETS + _bucket(h)) % BUCKETS
                total += np.bincount(key, minlength=BUCKETS)
                rows += part.num_rows - part.column("t").null_count
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], ["b", "n"])

    counts = docs.select(F.lower(F.col(text)).alias("t")).mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    out = np.zeros(BUCKETS + 1, np.int64)  # a fixed number of values, whatever the input
    out[counts.b.to_numpy()] = counts.n.to_numpy()
    return out[:-1], int(out[-1])


def _weights(t: C.Tokens, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, h, tf = shingles(t)
    return row, h, (1 + np.log(tf)).astype(np.float32) * idf[_bucket(h)]


def signatures(t: C.Tokens, idf: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) band keys; 0 where a text has no words."""
    k = bands * rows
    r, c, beta = _draws(k)
    row, h, w = _weights(t, idf)
    out = np.zeros((t.rows, bands), np.uint64)
    edges = np.searchsorted(row, np.arange(t.rows + 1))
    logs = np.log(w)
    mask = np.uint64(_TABLE - 1)
    i1, i2, i3 = ((h >> np.uint64(s) & mask).astype(np.int64) for s in (0, 13, 26))
    salt = C.mix(np.arange(1, bands + 1, dtype=np.uint64))
    for d in np.flatnonzero(np.diff(edges)):
        best, who, step = None, None, None
        for a in range(edges[d], edges[d + 1], 2048):
            s = slice(a, min(a + 2048, edges[d + 1]))
            rr, b = r[i1[s]], beta[i3[s]]
            level = np.floor(logs[s, None] / rr + b)
            score = c[i2[s]] - rr * (level - b + 1)
            at = score.argmin(0)
            low, lev = score[at, np.arange(k)], level[at, np.arange(k)]
            if best is None:
                best, who, step = low, h[a + at], lev
            else:
                better = low < best
                best, who, step = np.where(better, low, best), np.where(better, h[a + at], who), np.where(better, lev, step)
        ids = C.mix(who + step.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(bands, rows)
        key = salt.copy()
        for j in range(rows):
            key = C.mix(key * np.uint64(0xD6E8FEB86659FD93) + ids[:, j])
        out[d] = key
    return out


def jaccard(left, right, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    a, b = C.Tokens(left), C.Tokens(right)
    rows = a.rows
    (ra, ha, wa), (rb, hb, wb) = _weights(a, idf), _weights(b, idf)
    row, h, w = np.concatenate([ra, rb]), np.concatenate([ha, hb]), np.concatenate([wa, wb]).astype(np.float64)
    order = np.lexsort((h, row))
    row, h, w = row[order], h[order], w[order]
    same = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1]))
    both = np.bincount(row[same], np.minimum(w[same], w[same + 1]), rows)
    return both / np.maximum(np.bincount(row, w, rows) - both, 1e-30)


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """The pairs (a, b) of text keys whose texts (k, t) are similar enough, with their similarity."""
    shared = texts.sparkSession.sparkContext.broadcast(idf)

    def test(batches):
        for batch in batches:
            for part in C.slices(batch, "ta", 1 << 20):
                sim = jaccard(part.column("ta"), part.column("tb"), shared.value)
                keep = pa.array(sim >= threshold)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep), pa.array(sim).filter(keep)], ["a", "b", "similarity"])

    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("parts"))
    hubs = texts.select(F.col("k").alias("a"), F.col("t").alias("ta")).join(salts, "a").select("a", "ta", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("s"))
    right = pairs.join(salts, "a").join(texts.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b").withColumn("s", F.pmod(F.xxhash64("b"), "parts").cast("int"))
    return right.join(hubs, ["a", "s"]).select("a", "b", "ta", "tb").mapInArrow(test, "a binary, b binary, similarity double")


def _shared(row: np.ndarray, h: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """(n, n): the sum of the lesser weights of the shingles that each two texts share."""
    order = np.argsort(h, kind="stable")
    row, h, w = row[order], h[order], w[order].astype(np.float64)
    begin = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(h)))
    out = np.zeros((n, n))
    for a, m in zip(begin[size > 1], size[size > 1]):
        r, v = row[a : a + m], w[a : a + m]
        out[r[:, None], r] += np.minimum(v[:, None], v)
    return out


def _within_blocks(rows: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float, block: int) -> DataFrame:
    """(a, b): a spanning forest, task by task, of the similar pairs of rows (key, k, c, first, n) that share a key but not the group c; n is the key's number."""
    shared = rows.sparkSession.sparkContext.broadcast(idf)
    rows = rows.withColumn("parts", F.ceil(F.col("n") / block).cast("int")).withColumn("p", F.pmod(F.xxhash64("k"), "parts").cast("int"))
    rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "p", "k", "c", (F.col("k") == F.col("first")).alias("hub"))
    rows = rows.join(texts, "k").select("key", "i", "j", "p", "c", "hub", "k", "t", "keys").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def links(task: pa.Table):
        t = C.Tokens(task["t"])
        row, h, w = _weights(t, shared.value)
        both = _shared(row, h, w, t.rows)
        total = np.bincount(row, w, t.rows)
        p, c = task["p"].to_numpy(), np.unique(np.array(task["c"].to_pylist(), object), return_inverse=True)[1]
        i, j, key = (task[x][0].as_py() for x in ("i", "j", "key"))
        keys = task["keys"].combine_chunks().flatten().to_numpy().reshape(t.rows, -1)
        band = int((keys[0] == key).argmax())
        earlier = np.zeros((t.rows, t.rows), bool)
        for b in range(band):
            earlier |= keys[:, b, None] == keys[:, b]
        hub = task["hub"].to_numpy(zero_copy_only=False).astype(bool)
        test = (c[:, None] != c) & ~earlier & ~(hub[:, None] | hub)
        if i != j:
            test &= p[:, None] != p
        near = both >= threshold * np.maximum(total[:, None] + total - both, 1e-30)
        a, b = np.nonzero(np.triu(test & near, 1))
        forest = C.Forest(t.rows)
        forest.join(a, b)
        at = np.flatnonzero(forest.parent != np.arange(t.rows))
        k = task["k"].combine_chunks()
        return pa.RecordBatch.from_arrays([k.take(pa.array(forest.parent[at])), k.take(pa.array(at))], ["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch])
            key, i, j = (table[x].to_numpy() for x in ("key", "i", "j"))
            cut = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for a, z in zip([0, *cut], cut):
                yield links(table.slice(a, z - a))
            held = table.slice(int(cut[-1]) if len(cut) else 0).to_batches()  # a task's rows, of which more may come
        if sum(b.num_rows for b in held):
            yield links(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "a binary, b binary")


def band_keys(docs: DataFrame, idf: np.ndarray, text: str, bands: int, rows: int) -> DataFrame:
    """(k, key): key of the text and one row for each band, for each distinct text with words."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def sign(batches):
        for batch in batches:
            for part in C.slices(batch, "t"):
                t = C.Tokens(part.column("t"))
                keys = signatures(t, shared.value, bands, rows)
                has = np.flatnonzero(t.count)
                values = pa.array(keys[has].astype(np.int64, copy=False).view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * bands), values)
                yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(has)), lists], ["k", "keys"])

    rows_ = docs.where(F.col(text).isNotNull()).select(F.unhex(F.md5(F.col(text))).alias("k"), F.lower(F.col(text)).alias("t"))
    return rows_.mapInArrow(sign, "k binary, keys array<long>").dropDuplicates(["k"])


def groups(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(node, component), saved, of each text key that has a near duplicate of another text; a key is the text's MD5."""
    df, n = frequencies(docs, text)
    idf = (np.log((n + 1) / (df + 1)) + 1).astype(np.float32)
    signed = C.save(band_keys(docs, idf, text, bands, rows))
    entries = signed.select("k", F.explode("keys").alias("key"))
    many = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("k").alias("first")).where("n > 1")
    buckets = C.save(entries.join(many, "key"))
    star = C.save(buckets.where("k <> first").select(F.col("first").alias("a"), F.col("k").alias("b")).distinct())
    some = C.save(buckets.select("k").distinct())
    texts = docs.where(F.col(text).isNotNull()).select(F.unhex(F.md5(F.col(text))).alias("k"), F.lower(F.col(text)).alias("t"))
    texts = C.save(texts.join(C.small(some, 48), "k", "left_semi").groupBy("k").agg(F.first("t").alias("t")))
    edges = C.save(verified(star, texts, idf, threshold).select("a", "b"))
    label = C.components(edges)
    # pairs that share a bucket but that no verified link has joined
    named = buckets.join(label, F.col("k") == F.col("node"), "left").select("key", "k", "first", "n", F.coalesce("component", "k").alias("c"))
    open_ = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    left = C.save(named.join(open_, "key"))
    few = left.where(F.col("n") <= small)
    right = few.select("key", F.col("k").alias("b"), F.col("c").alias("d"))
    rest = few.withColumnRenamed("k", "a").join(right, "key").where("a < b and c <> d").select("a", "b").distinct()
    rest = C.save(rest.join(star, ["a", "b"], "left_anti"))
    more = C.save(verified(rest, texts, idf, threshold).select("a", "b").union(_within_blocks(left.where(F.col("n") > small), texts.join(signed, "k"), idf, threshold, block)))
    if more.count():
        before, label = label, C.components(edges.union(more))
        C.discard(before)
    C.discard(signed, buckets, star, some, texts, edges, left, rest, more)
    return label


def _members(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, doc_id, n): how many rows have the text and the id."""
    return C.save(docs.where(F.col(text).isNotNull()).select(F.unhex(F.md5(F.col(text))).alias("k"), F.col(key).alias("id")).groupBy("k", "id").agg(F.count("*").alias("n")))


def _decided(docs: DataFrame, key: str, text: str, **how) -> DataFrame:
    """(k, id, n, group, size, keep), saved, of all rows in groups of two or more; keep is the group's smallest (id, k), struct."""
    ids = _members(docs, key, text)
    label = groups(docs, text, **how)
    every = ids.join(label.withColumnsRenamed({"node": "k"}), "k", "left").select("k", "id", "n", F.coalesce("component", "k").alias("group"))
    best = every.groupBy("group").agg(F.sum("n").alias("size"), F.min(F.struct(F.col("id").isNull().alias("z"), "id", "k")).alias("keep")).where("size > 1")
    out = C.save(every.join(best, "group"))
    C.discard(ids, label)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, keep_id, group_size): each document in a group of duplicates, with the one that stays."""
    return _decided(docs, key, text, **how).select(F.col("id").alias(key), F.col("keep.id").alias("keep_id"), F.col("size").alias("group_size"), F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i")).drop("i")


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents with one of each group, all columns as they were; rows with a null text stay."""
    rows = _decided(docs, key, text, **how)
    k, stay, best, copies = C.fresh(docs, "k", "stay", "best", "copies")
    fate = C.save(rows.groupBy("k").agg(F.first(F.col("keep.k") == F.col("k")).alias(stay), F.first("keep.id").alias(best), F.max(F.when(F.col("id").eqNullSafe(F.col("keep.id")), F.col("n"))).alias(copies)).withColumnRenamed("k", k))
    C.discard(rows)
    joined = docs.withColumn(k, F.unhex(F.md5(F.col(text)))).join(C.small(fate, 80), k, "left")
    kept = joined.where(F.col(stay).isNull() | (F.col(stay) & F.col(key).eqNullSafe(F.col(best))))
    once = kept.where(F.coalesce(F.col(copies), F.lit(1)) == 1).select(docs.columns)
    return once.unionByName(kept.where(F.col(copies) > 1).dropDuplicates([k]).select(docs.columns))
