"""Toxicity: a polarity lexicon induced by random walks over a PPMI word graph.

1. Terms are words and their first 4, 6 and 7 bytes (stems, for longer words). A bounded sample of
   labelled rows (``SAMPLE``, the lowest hashes of doc_id) gives the smoothed log-odds of each term
   for the toxic label; its z-score picks toxic seeds (``SEED_Z``) and candidates (``CANDIDATE_Z``). Of its ``COMMON`` commonest terms
   that tell nothing, the ``NEUTRAL`` that cover the clean rows most evenly (every language, say) are neutral seeds.
2. Over the whole corpus, in runs of ``WINDOW`` words, each term of words without a seed is counted, and in how many runs a
   toxic seed stands too. Of a toxic term's runs, as many hold one as of the seeds' own (another one, there); of any other's, as many as of
   all runs. Terms whose share is ``BESIDE`` of the way from these to those or more, and surely (Wilson, ``SEED_Z``) ``LEAST_BESIDE`` of it (not
   all, since toxic texts may hold none of the seeds), are candidates too, labelled or not, however many. A term that stands beside a seed
   in fewer than 4 runs (as many rows as a labelled term needs) proves nothing and isn't one.
3. Co-occurrences of all seeds and candidates are counted once in each run over the whole corpus, and give the graph's edges: positive
   pointwise mutual information, shifted by ln ``SHIFT`` as what most terms of one language have in common. Terms are looked up in a
   table of 2^24 hash bits, of one size for any number of terms; what it lets through by chance a join drops.
4. Random walks with restart from either set of seeds, ``STEPS`` joins of saved tables, give each term the share of the toxic walk. It is
   the prior, worth ``PRIOR`` rows, of the share of toxic rows among those that hold the term; the sample's rows add to it. What this
   share, less its standard deviation, exceeds one half by, times two, is the term's weight: the walk alone where no labelled row has
   the term. Neutral seeds have none.
5. A text's score is the weight of its words, each taken by its strongest term, over their number. The cut that separates the sample's
   labels best (highest F1, middle of the gap) decides. The lexicon goes to the executors in blocks of about ``BLOCK_TERMS`` terms, words
   and their stems together: a larger lexicon takes more of them, never a larger broadcast.

Bounds: the labelled sample, on which seeds, weights' evidence and cut are fitted. All else covers the whole corpus; candidates, edges
and lexicon grow with it, as tables.

Nulls and edge cases: texts that are null or have no words score 0 and are never toxic; labels that are
null or whose document is missing are left out; a doc_id that is labelled twice is toxic if one says so;
without toxic or without clean labels, or without a seed, nothing is toxic; identical texts count once in the sample.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SAMPLE, NEUTRAL, COMMON, WINDOW = 20_000, 64, 2_000, 128
SEED_Z, CANDIDATE_Z, LEAST_DOCS, RESTART, STEPS = 3.5, 2.0, 3, 0.3, 12
CONFIDENCE, LEAST_SHARE, LEAST_BESIDE, BESIDE, SHIFT, PRIOR, BLOCK_TERMS = 2.0, 0.5, 0.25, 0.4, 2.0, 4.0, 1_000_000
PREFIXES = (4, 6, 7)
_SLICE = 1 << 20


class Terms:
    """Sorted term hashes, with a table of hash bits that drops most others first."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.sort(terms)
        self.bits = packed(np.unique(self.terms >> np.uint64(40)))

    def index(self, values: np.ndarray) -> np.ndarray:
        """Place of each value among the terms, -1 where it isn't there."""
        out = np.full(len(values), -1)
        if len(self.terms):
            at = np.flatnonzero(held(values, self.bits))
            found = np.searchsorted(self.terms, values[at]).clip(max=len(self.terms) - 1)
            out[at] = np.where(self.terms[found] == values[at], found, -1)
        return out


def packed(tops: np.ndarray) -> np.ndarray:
    """A table of 2^24 bits, those of the given numbers set."""
    bits = np.zeros(1 << 24, np.uint8)
    bits[tops.astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def held(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the first 24 bits of each value are set in the table."""
    top = (values >> np.uint64(40)).astype(np.int64)
    return (bits[top >> 3] >> (top & 7).astype(np.uint8)) & 1 != 0


@dataclass(frozen=True)
class Lexicon:
    """Blocks of terms and weights, broadcast; and the score from which a text is toxic."""

    blocks: list
    cut: float

    def score(self, text: str):
        """The score of a text column, as an expression."""
        out = F.lit(0.0)
        for block in self.blocks:
            out = out + _scorer(block)(F.lower(F.col(text)))
        return out


def _terms(t: C.Tokens) -> list[np.ndarray]:
    """Words and stems; the stem of a word that isn't longer is 0."""
    return [t.hash, *(np.where(t.end - t.start > k, t.prefix[k], np.uint64(0)) for k in PREFIXES)]


def scores(t: C.Tokens, terms: Terms, weights: np.ndarray) -> np.ndarray:
    """Weight of each text's words, each taken by its strongest term, over the number of words."""
    weight, padded = np.zeros(len(t.hash)), np.append(weights, 0.0)
    for term in _terms(t):
        np.maximum(weight, padded[terms.index(term)], out=weight)
    return np.bincount(t.row, weight, t.rows) / np.maximum(t.count, 1)


def _scorer(block):
    @F.arrow_udf("double")
    def score(t: pa.Array) -> pa.Array:
        parts = [scores(C.Tokens(p.column("t"), PREFIXES), *block.value) for p in C.slices(pa.RecordBatch.from_arrays([t], ["t"]), "t", _SLICE)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int) -> DataFrame:
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("k"), "k").limit(most)
    rows = docs.select(F.col(key).alias("k"), F.lower(F.col(text)).alias("t")).where("t is not null")
    return C.save(rows.join(F.broadcast(chosen), "k").groupBy(F.md5("t").alias("m")).agg(F.first("t").alias("t"), F.max("y").alias("y")).select("t", F.col("y").cast("long").alias("y")))


def _by_label(batches):
    """Documents of either label that hold each term; the sum of both for term 0."""
    for batch in batches:
        for part in C.slices(batch, "t", _SLICE):
            t = C.Tokens(part.column("t"), PREFIXES)
            y = part.column("y").to_numpy().astype(bool)
            row = np.tile(t.row, 1 + len(PREFIXES))
            term = np.concatenate(_terms(t))
            row, term = row[term != 0], term[term != 0]
            order = np.lexsort((row, term))
            row, term = row[order], term[order]
            new = np.ones(len(term), bool)
            new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
            row, term = row[new], term[new]
            values, at = np.unique(term, return_inverse=True)
            toxic = np.bincount(at, y[row], len(values)).astype(np.int64)
            both = np.bincount(at, minlength=len(values))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(values, np.uint64(0)).view(np.int64)), pa.array(np.append(toxic, y.sum())), pa.array(np.append(both - toxic, (~y).sum()))], ["term", "toxic", "clean"])


def _segments(t: C.Tokens, window: int) -> tuple[np.ndarray, int]:
    """The run of words that each word is in, and how many there are."""
    size = (t.count + window - 1) // window
    return (np.cumsum(size) - size)[t.row] + t.place // window, int(size.sum())


def _pairs(t: C.Tokens, bits: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(a, b, runs, group): terms held by the table that stand in one run, a and b once in some order, and in how many; a = b counts the term, with its group."""
    segment, _ = _segments(t, window)
    found = [(x, np.flatnonzero(held(x, bits) & (x != 0))) for x in _terms(t)]
    seg = np.concatenate([segment[at] for _, at in found])
    keys, first, term = np.unique(np.concatenate([x[at] for x, at in found]), return_index=True, return_inverse=True)
    group = np.concatenate([t.prefix[PREFIXES[0]][at] for _, at in found])[first]
    code = _sorted(seg * len(keys) + term) if len(keys) else np.zeros(0, np.int64)
    seg, term = code // max(1, len(keys)), code % max(1, len(keys))
    out, at, step = [term * len(keys) + term], np.arange(len(seg)), 1
    while len(at := at[at + step < len(seg)]) and len(at := at[seg[at + step] == seg[at]]):
        out.append(term[at] * len(keys) + term[at + step])
        step += 1
    codes, n = np.unique(np.concatenate(out), return_counts=True)
    a, b = codes // max(1, len(keys)), codes % max(1, len(keys))
    return keys[a], keys[b], n, np.where(a == b, group[a], np.uint64(0)) if len(keys) else np.zeros(0, np.uint64)


def _sorted(x: np.ndarray) -> np.ndarray:
    """The distinct values, sorted; for many, faster than unique."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _distinct(term: np.ndarray, seg: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms, sorted; and of each pair of term and segment, once, the term's place and the segment."""
    values = _sorted(term)
    low = np.uint64((1 << max(1, int(segments).bit_length())) - 1)
    cut = values & ~low
    if (cut[1:] != cut[:-1]).all():  # a faster sort, if the high bits tell the terms apart
        code = _sorted((term & ~low) | seg.astype(np.uint64))
        return values, np.cumsum(np.append(0, (code[1:] & ~low) != (code[:-1] & ~low))) if len(code) else np.zeros(0, np.int64), (code & low).astype(np.int64)
    pair = np.unique(np.searchsorted(values, term) * segments + seg)
    return values, pair // segments, pair % segments


def _beside(t: C.Tokens, seeds: Terms, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of words without a seed, their runs, and those with a seed; term 0 has all runs, term 1 the words with a seed and those beside another."""
    segment, segments = _segments(t, window)
    terms = _terms(t)
    own = np.zeros(len(t.hash), bool)
    for x in terms:
        own |= seeds.index(x) >= 0
    with_seed = np.bincount(segment[own], minlength=segments)
    term, seg = np.concatenate([x[~own] for x in terms]), np.tile(segment[~own], len(terms))
    values, at, seg = _distinct(term[term != 0], seg[term != 0], segments)
    both = np.bincount(at[with_seed[seg] > 0], minlength=len(values))
    sums = [segments, own.sum()], [(with_seed > 0).sum(), (with_seed[segment[own]] > 1).sum()]
    return np.append(values, np.array([0, 1], np.uint64)), np.append(np.bincount(at, minlength=len(values)), sums[0]), np.append(both, sums[1])


def _summed(parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    terms, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return terms, *(np.bincount(at, np.concatenate([p[i] for p in parts]), len(terms)).astype(np.int64) for i in (1, 2))


def _induced(docs: DataFrame, text: str, seeds: np.ndarray, window: int, least: int) -> tuple[DataFrame, DataFrame]:
    """The terms that stand beside toxic seeds over the whole corpus, see the module; and the saved table they are from."""
    shared = docs.sparkSession.sparkContext.broadcast(Terms(seeds))  # bounded by the sample

    def count(batches):
        keep, size = [], 0
        for batch in batches:
            for part in C.slices(batch, "t", _SLICE):
                keep.append(_beside(C.Tokens(part.column("t"), PREFIXES), shared.value, window))
                size += len(keep[-1][0])
                if size > 1 << 19:
                    keep = [_summed(keep)]
                    size = len(keep[0][0])
                    if size > 1 << 18:
                        yield record(keep)
                        keep, size = [], 0
        if keep:
            yield record([_summed(keep)])

    def record(keep):
        (terms, n, k), names = keep[0], ["term", "n", "k"]
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n), pa.array(k)], names)

    rows = docs.select(F.lower(F.col(text)).alias("t")).where("t is not null").mapInArrow(count, "term long, n long, k long")
    rows = C.save(rows.groupBy("term").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where(F.col("term").isin(0, 1) | (F.col("k") >= least)))
    sums = {r.term: r.k / max(r.n, 1) for r in rows.where("term in (0, 1)").collect()}
    every, toxic = sums.get(0, 0.0), sums.get(1, 0.0)
    n, p, zz = F.col("n"), F.col("k") / F.col("n"), SEED_Z**2
    low = (p + zz / (2 * n) - SEED_Z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)
    way = lambda x: (x - every) / max(toxic - every, 1e-12)
    beside = (way(low) >= LEAST_BESIDE) & (way(p) >= BESIDE)
    return rows.where("term not in (0, 1)").where(beside if toxic > every else F.lit(False)).select("term"), rows


def graph(docs: DataFrame, text: str, terms: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Nodes (t, n, g: runs with the term, its group) and edges (a, b, w: PPMI, either way) of the given terms' co-occurrences; both saved."""
    tops = terms.select(F.shiftrightunsigned("term", 40).alias("x")).distinct().toArrow()["x"].to_numpy()  # 2^24 numbers at most
    bits = terms.sparkSession.sparkContext.broadcast(packed(tops))

    def count(batches):
        for batch in batches:
            for part in C.slices(batch, "t", _SLICE):
                t = C.Tokens(part.column("t"), PREFIXES)
                a, b, n, g = _pairs(t, bits.value, window)
                zero = np.zeros(1, np.uint64)
                cols = [np.append(a, zero).view(np.int64), np.append(b, zero).view(np.int64), np.append(n, _segments(t, window)[1]), np.append(g, zero).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "n", "g"])

    rows = docs.select(F.lower(F.col(text)).alias("t")).where("t is not null").mapInArrow(count, "a long, b long, n long, g long")
    pairs = C.save(rows.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("g").alias("g")))
    windows = (pairs.where("a = 0 and b = 0").agg(F.sum("n")).first()[0] or 0) if pairs.count() else 0
    nodes = C.save(pairs.where("a = b and a <> 0").select(F.col("a").alias("t"), "n", "g").join(terms.select(F.col("term").alias("t")).distinct(), "t", "left_semi"))
    of = C.small(nodes.select("t", F.col("n").alias("m")), 32)
    w = F.log(F.col("n") * (windows / SHIFT) / (F.col("ma").cast("double") * F.col("mb")))
    edges = pairs.where("a <> b").join(of.select(F.col("t").alias("a"), F.col("m").alias("ma")), "a").join(of.select(F.col("t").alias("b"), F.col("m").alias("mb")), "b").select("a", "b", w.alias("w")).where("w > 0")
    edges = C.save(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    C.discard(pairs)
    return nodes, edges


def walk(edges: DataFrame, home: DataFrame, restart: float = RESTART, steps: int = STEPS) -> DataFrame:
    """(t, p, m): where two random walks over the edges (a, b, w) are that restart at the home's (t, p, m), sums of p and of m being 1."""
    out = edges.groupBy("a").agg(F.sum("w").alias("every"))
    flow = C.save(edges.join(out, "a").select("a", "b", (F.col("w") / F.col("every") * (1 - restart)).alias("f")))
    at, back = C.save(home.select("t", "p", "m")), home.select("t", (F.col("p") * restart).alias("p"), (F.col("m") * restart).alias("m"))
    for _ in range(steps):
        moved = flow.join(C.small(at.withColumnRenamed("t", "a"), 48), "a").select(F.col("b").alias("t"), (F.col("p") * F.col("f")).alias("p"), (F.col("m") * F.col("f")).alias("m"))
        after = C.save(moved.unionAll(back).groupBy("t").agg(F.sum("p").alias("p"), F.sum("m").alias("m")))
        C.discard(at)
        at = after
    C.discard(flow)
    return at


def wilson(hits, misses, z: float = CONFIDENCE):
    """Lower bound of the share of hits, of columns."""
    n = F.greatest(hits + misses, F.lit(1e-12))
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _neutral(rows: DataFrame, terms: np.ndarray) -> np.ndarray:
    """The ``NEUTRAL`` of the terms that cover the sample's clean rows most evenly: each in turn the one that adds most, a row that has n already counting 1 / (1 + n)."""
    hashes = np.sort(terms.astype(np.int64).view(np.uint64))
    shared = rows.sparkSession.sparkContext.broadcast(Terms(hashes))

    def hold(batches):
        for batch in batches:
            for part in C.slices(batch, "t", _SLICE):
                t = C.Tokens(part.column("t"), PREFIXES)
                has = np.zeros((t.rows, len(hashes)), bool)
                for x in _terms(t):
                    at = shared.value.index(x)
                    has[t.row[at >= 0], at[at >= 0]] = True
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in np.packbits(has, axis=1)], pa.binary())], ["h"])

    if not len(hashes):
        return terms
    got = rows.where("y = 0").mapInArrow(hold, "h binary").toArrow()["h"].to_pylist()  # bounded by the sample
    has = np.unpackbits(np.frombuffer(b"".join(got), np.uint8).reshape(len(got), -1), axis=1)[:, : len(hashes)].astype(np.float32)
    times, chosen = np.zeros(len(has), np.float32), []
    for _ in range(min(NEUTRAL, len(hashes))):
        gain = (1 / (1 + times)) @ has
        gain[chosen] = -1
        chosen.append(int(gain.argmax()))
        times += has[:, chosen[-1]]
    return hashes[chosen].view(np.int64)


def induce(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int, window: int) -> tuple[DataFrame, DataFrame | None]:
    """The labelled sample (t, y) and the lexicon (term, g, weight), saved; None if there is no seed."""
    spark = docs.sparkSession
    rows = _sample(docs, labels, key, text, label, sample)
    known = C.save(rows.mapInArrow(_by_label, "term long, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("x"), F.sum("clean").alias("c")))
    sums = known.where("term = 0").first()
    if not sums or not sums.x or not sums.c:
        C.discard(known)
        return rows, None
    odds = F.log((F.col("x") + 0.5) / (F.lit(sums.x) - F.col("x") + 0.5)) - F.log((F.col("c") + 0.5) / (F.lit(sums.c) - F.col("c") + 0.5))
    z = known.where("term <> 0").withColumn("z", odds / F.sqrt(1 / (F.col("x") + 0.5) + 1 / (F.col("c") + 0.5)))
    # the share's lower bound is at most 1 / (1 + z^2 / n) where all n rows are toxic: rarer terms prove nothing
    least = max(LEAST_DOCS, math.ceil(CONFIDENCE**2 * LEAST_SHARE / (1 - LEAST_SHARE)))
    toxic = z.where((F.col("x") >= least) & (F.col("x") >= LEAST_SHARE * (F.col("x") + F.col("c"))) & (F.col("z") >= CANDIDATE_Z))
    toxic = toxic.select("term", (F.col("z") >= SEED_Z).alias("seed")).toArrow().to_pandas()  # bounded by the sample
    neutral = _neutral(rows, z.where("abs(z) < 1").orderBy(F.desc("c"), "term").limit(COMMON).toArrow()["term"].to_numpy())
    seeds = toxic.term[toxic.seed.astype(bool)].to_numpy()
    if not len(seeds):
        C.discard(known)
        return rows, None
    beside, table = _induced(docs, text, seeds.astype(np.int64).view(np.uint64), window, least)
    kinds = [(int(t), bool(s), False) for t, s in zip(toxic.term, toxic.seed)] + [(int(t), False, True) for t in neutral]
    kinds = F.broadcast(spark.createDataFrame(kinds, "term long, plus boolean, minus boolean"))  # bounded by the sample
    terms = C.save(beside.union(kinds.select("term")).distinct())
    nodes, edges = graph(docs, text, terms, window)
    nodes = nodes.join(kinds.withColumnRenamed("term", "t"), "t", "left").fillna(False)
    plus, minus = nodes.agg(F.count_if("plus"), F.count_if("minus")).first()
    home = nodes.where("plus or minus").select("t", (F.col("plus").cast("int") / max(plus, 1)).alias("p"), (F.col("minus").cast("int") / max(minus, 1)).alias("m"))
    at = walk(edges, home)
    share = F.col("p") / F.greatest(F.col("p") + F.col("m"), F.lit(1e-300))
    named = nodes.join(at, "t").join(known.withColumnRenamed("term", "t"), "t", "left").fillna(0, ["x", "c"])
    rate = (F.col("x") + PRIOR * share) / (F.col("x") + F.col("c") + PRIOR)
    weight = 2 * (rate - F.sqrt(rate * (1 - rate) / (F.col("x") + F.col("c") + PRIOR + 1))) - 1
    lexicon = C.save(named.where("not minus").select(F.col("t").alias("term"), "g", F.round(weight, 9).alias("weight")).where("weight > 0"))
    C.discard(known, table, terms, edges, at)
    return rows, lexicon


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, window: int = WINDOW, block_terms: int = BLOCK_TERMS) -> Lexicon:
    """Induce the lexicon and fit the cut; see the module."""
    spark = docs.sparkSession
    rows, table = induce(docs, labels, key, text, label, sample, window)
    blocks, cut = [], float("inf")
    if table is not None:
        count = -(-table.count() // block_terms)
        for b in range(count):
            got = table.where(F.pmod(F.xxhash64("g"), F.lit(count)) == b).toArrow()
            hashes = got["term"].to_numpy().astype(np.int64).view(np.uint64)
            blocks.append(spark.sparkContext.broadcast((Terms(hashes), got["weight"].to_numpy()[np.argsort(hashes)])))
        got = rows.select("y", Lexicon(blocks, cut).score("t").alias("s")).toArrow()  # bounded by the sample
        cut = best_cut(got["s"].to_numpy(), got["y"].to_numpy() > 0)
        C.discard(table)
    C.discard(rows)
    return Lexicon(blocks, cut)


def best_cut(score: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the gap between scores above which F1 is highest; infinite if no text is toxic."""
    if not toxic.any():
        return float("inf")
    order = np.argsort(-score, kind="stable")
    s, y = score[order], toxic[order]
    last = np.append(s[1:] != s[:-1], True) & (s > 0)
    if not last.any():
        return float("inf")
    hit = np.cumsum(y)
    f1 = np.where(last, 2 * hit / (np.arange(1, len(s) + 1) + y.sum()), -1)
    at = int(f1.argmax())
    return float((s[at] + (s[at + 1] if at + 1 < len(s) else 0)) / 2)


def toxic_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, score): the documents that the induced lexicon finds toxic."""
    lexicon = fit(docs, labels, key, text, **how)
    got = docs.select(F.col(key).alias("k"), lexicon.score(text).alias("s"))
    return got.where(F.col("s") >= float(lexicon.cut)).select(F.col("k").alias(key), F.round("s", 6).alias("score"))


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents that aren't toxic, all columns as they were; judged row by row, without a join."""
    lexicon = fit(docs, labels, key, text, **how)
    return docs.where(lexicon.score(text) < float(lexicon.cut)) if lexicon.blocks else docs
