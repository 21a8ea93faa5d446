"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of the passages they hit.

Seeds are runs of ``SEED`` words of the test items. A seed is rare if at most a share ``RARE`` of all
documents (one document at least) holds it, or if it is among the rarer half of its item's seeds (so an
item that leaked very often is still searched for); the frequencies are counted over the whole corpus. Around
each rare hit a window of the document is aligned to the item word by word (match 2, mismatch -1, gap -1). A document
leaks an item if the best local score is at least ``LEAK`` of the score of the item aligned to itself, 2 n for n words. An alignment that
scores so high has at most 2 n (1 - LEAK) gaps, so the window reaches that many words beyond either end of the item: of a
leak that holds a seed nothing is cut off.

The test items go to the executors in blocks of at most ``BLOCK_BYTES`` (or one item): a benchmark larger than
that takes more passes, never a larger broadcast.

Nulls and edge cases: null and empty texts or items match nothing; an item shorter than the seed is
used as one seed, whole; repeated items and documents each give their own rows; a null doc_id or item_id
is kept as it is. Texts are read whole, whatever their length.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SEED, RARE, LEAK, BLOCK_BYTES = 3, 0.002, 0.5, 12_000_000
MATCH, MISMATCH, GAP = 2, -1, -1


def align(a: np.ndarray, b: np.ndarray) -> int:
    """Best local alignment score of two arrays of word hashes, with linear gaps."""
    best, up = 0, np.zeros(len(b) + 1, np.int64)
    step = GAP * np.arange(len(b) + 1)
    for x in a:
        new = np.zeros(len(b) + 1, np.int64)
        new[1:] = np.maximum(up[:-1] + np.where(b == x, MATCH, MISMATCH), up[1:] + GAP)
        np.maximum(new, 0, out=new)
        # a run of gaps along the row: a running maximum of the score less the gap's cost so far
        new = np.maximum.accumulate(new - step) + step
        best, up = max(best, int(new.max())), new
    return best


class Items:
    """A block of test items: words, seed hashes and where each seed occurs."""

    def __init__(self, texts, seed: int = SEED):
        t = C.Tokens(pa.array(texts, pa.string()))
        self.words = [t.hash[a:b] for a, b in zip(t.first, t.first[1:])]
        grams, inside = t.grams(seed)
        self.seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i in np.flatnonzero(inside):
            self.seeds[int(grams[i])].append((int(t.row[i]), int(t.place[i])))
        #: items too short for a seed, by length
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i in np.flatnonzero((t.count > 0) & (t.count < seed)):
            n = int(t.count[i])
            self.short[n][int(C.Tokens(pa.array([texts[i]])).grams(n)[0][0])].append(int(i))
        self.short = {n: dict(v) for n, v in self.short.items()}
        self.seeds = dict(self.seeds)
        self.keys = np.unique(np.array(list(self.seeds), np.uint64))


def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the values that are among the sorted keys; a table of hash bits drops most others first."""
    if not len(keys):
        return np.zeros(0, np.int64)
    bits = np.zeros(1 << 20, bool)
    bits[(keys >> np.uint64(44)).astype(np.int64)] = True
    at = np.flatnonzero(bits[(values >> np.uint64(44)).astype(np.int64)])
    found = np.searchsorted(keys, values[at]).clip(max=len(keys) - 1)
    return at[keys[found] == values[at]]


def _rare(docs: DataFrame, items, text: str, seed: int, rare: float) -> np.ndarray:
    """The block's seeds that few enough documents hold."""

    def count(batches):
        keys, total, rows = items.value.keys, np.zeros(len(items.value.keys) + 1, np.int64), 0
        for batch in batches:
            for part in C.slices(batch, "t"):
                t = C.Tokens(part.column("t"))
                g, inside = t.grams(seed)
                at = _among(g, keys)
                at = at[inside[at]]
                pair = np.unique(t.row[at] * len(keys) + np.searchsorted(keys, g[at])) % max(1, len(keys))
                total[:-1] += np.bincount(pair, minlength=len(keys))[: len(keys)]
                rows += part.num_rows
        total[-1] = rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["i", "n"])

    got = docs.select(F.lower(F.col(text)).alias("t")).mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    keys = items.value.keys
    total = np.zeros(len(keys) + 1, np.int64)
    total[got.i.to_numpy()] = got.n.to_numpy()
    known = total[:-1] <= max(1, rare * total[-1])
    own: dict[int, list[int]] = defaultdict(list)
    for i, key in enumerate(keys):
        for item in {x for x, _ in items.value.seeds[int(key)]}:
            own[item].append(i)
    for of in own.values():
        known[sorted(of, key=lambda i: total[i])[: (len(of) + 1) // 2]] = True
    return keys[known]


def leaked(t: C.Tokens, items: Items, rare: np.ndarray, seed: int = SEED, leak: float = LEAK) -> list[tuple[int, int, float]]:
    """(text, item, score share) of the texts that leak items."""
    g, inside = t.grams(seed)
    at = _among(g, rare)
    hits: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i in at[inside[at]]:
        for item, place in items.seeds[int(g[i])]:
            hits[int(t.row[i]), item].append(int(t.place[i]) - place)
    out = []
    for (row, item), begins in hits.items():
        words, best = items.words[item], 0.0
        text = t.hash[t.first[row] : t.first[row + 1]]
        n = len(words)
        pad = int(MATCH * n * (1 - leak)) + 1
        begins.sort()
        lo = hi = None
        spans = []
        for b in begins:  # overlapping windows become one
            if hi is not None and b - pad <= hi:
                hi = b + n + pad
            else:
                if hi is not None:
                    spans.append((lo, hi))
                lo, hi = b - pad, b + n + pad
        spans.append((lo, hi))
        for lo, hi in spans:
            best = max(best, align(words, text[max(0, lo) : max(0, hi)]) / (MATCH * n))
        if best >= leak:
            out.append((row, item, best))
    for n, known in items.short.items():
        g, inside = t.grams(n)
        at = _among(g, np.sort(np.array(list(known), np.uint64)))
        out += sorted({(int(t.row[i]), item, 1.0) for i in at[inside[at]] for item in known[int(g[i])]})
    return out


def _blocks(items: DataFrame, text: str, most: int):
    """The items in order, in blocks of at most so many bytes, or of one item; one block is on the driver at a time."""
    rows, size = [], 0
    for r in items.select(F.col(items.columns[0]), F.lower(F.col(text))).toLocalIterator():
        more = len((r[1] or "").encode())
        if rows and size + more > most:
            yield rows
            rows, size = [], 0
        rows.append(tuple(r))
        size += more
    if rows:
        yield rows


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", seed: int = SEED, rare: float = RARE, leak: float = LEAK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score): each leak of an item into a document, scored from ``leak`` to 1."""
    spark, out = docs.sparkSession, None
    id_type, item_type = docs.schema[key].dataType, items.schema[item_key].dataType
    for rows in _blocks(items.select(F.col(item_key), F.col(item_text)), item_text, block_bytes):
        block = spark.sparkContext.broadcast(Items([r[1] for r in rows], seed))
        known = spark.sparkContext.broadcast(_rare(docs, block, text, seed, rare))

        def find(batches, block=block, known=known):
            for batch in batches:
                for part in C.slices(batch, "t"):
                    got = leaked(C.Tokens(part.column("t")), block.value, known.value, seed, leak)
                    rows_, item, score = zip(*got) if got else ((), (), ())
                    yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(rows_, pa.int64())), pa.array(item, pa.int64()), pa.array(score, pa.float64())], ["k", "i", "s"])

        found = docs.select(F.col(key).alias("k"), F.lower(F.col(text)).alias("t")).mapInArrow(find, f"k {id_type.simpleString()}, i long, s double")
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"i long, {item_key} {item_type.simpleString()}")
        found = found.join(names, "i").select(F.col("k").alias(key), item_key, F.round("s", 4).alias("score"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"{key} {id_type.simpleString()}, {item_key} {item_type.simpleString()}, score double")
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", seed: int = SEED, rare: float = RARE, leak: float = LEAK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that leak no item, all columns as they were; null texts stay. Judged row by row, without a join."""
    spark, out = docs.sparkSession, docs
    for rows in _blocks(items.select(F.col(item_text).alias("k"), F.col(item_text)), item_text, block_bytes):
        block = spark.sparkContext.broadcast(Items([r[1] for r in rows], seed))
        known = spark.sparkContext.broadcast(_rare(docs, block, text, seed, rare))
        out = out.where(_clean(block, known, seed, leak)(F.lower(F.col(text))))
    return out


def _clean(block, known, seed: int, leak: float):
    @F.arrow_udf("boolean")
    def clean(t: pa.Array) -> pa.Array:
        ok, at = np.ones(len(t), bool), 0
        for part in C.slices(pa.RecordBatch.from_arrays([t], ["t"]), "t"):
            bad = [r for r, _, _ in leaked(C.Tokens(part.column("t")), block.value, known.value, seed, leak)]
            ok[np.array(bad, np.int64) + at] = False
            at += part.num_rows
        return pa.array(ok)

    return clean
