import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sievelake.llm import common as C
from sievelake.llm import toxicity


def corpus(n: int, seed: int, text):
    g, rows = random.Random(seed), []
    for i in range(n):
        bad = i % 5 == 0
        w = text(seed * 10_000 + i, 100, 600).split()
        if bad:
            for _ in range(5):
                w[g.randrange(len(w))] = g.choice(["vile", "nasty", "scumo" + g.choice("abcde"), "scumo" + g.choice("fghij")])
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_held_out_accuracy(spark, text):
    rows = corpus(500, 1, text)
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 250], "doc_id long, toxic int")
    found = {r.doc_id for r in toxicity.toxic_documents(docs, labels).collect()}
    hidden = {i for i, _, y in rows if i >= 250 and y}
    assert len(found & hidden) >= 0.95 * len(hidden)
    assert len({i for i in found if i >= 250} - hidden) <= 0.02 * 250
    assert {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()} == set(range(500)) - found


def brute_graph(texts: list[str], terms: set[int], window: int):
    """Runs with each term and with each two terms, by loops."""
    single, pair, runs = {}, {}, 0
    for s in texts:
        t = C.Tokens(pa.array([s]), toxicity.PREFIXES)
        every = list(zip(*[x.tolist() for x in toxicity._terms(t)]))
        for at in range(0, len(every), window):
            runs += 1
            own = sorted({x for word in every[at : at + window] for x in word if x in terms})
            for i, x in enumerate(own):
                single[x] = single.get(x, 0) + 1
                for y in own[i + 1 :]:
                    pair[x, y] = pair.get((x, y), 0) + 1
    return single, pair, runs


def test_graph_and_walk_of_brute_force(spark, text):
    texts = [text(i, 90, 300) for i in range(30)] + ["", "one", "achlichung achlichkeit w1 w2"]
    hashes = {int(x) for s in texts for x in C.Tokens(pa.array([s])).hash.tolist() if x % 2}
    stems = {int(x) for x in C.Tokens(pa.array(["achlichung"]), (7,)).prefix[7].tolist()}
    terms = hashes | stems
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    docs = spark.createDataFrame([(s,) for s in [*texts, None]], "text string")
    nodes, edges = toxicity.graph(docs, "text", spark.createDataFrame([(signed(x),) for x in terms], "term long"), 16)
    single, pair, runs = brute_graph(texts, terms, 16)
    assert {r.t: r.n for r in nodes.collect()} == {signed(x): n for x, n in single.items()}
    want = {(signed(x), signed(y)): math.log(n * runs / toxicity.SHIFT / (single[x] * single[y])) for (x, y), n in pair.items()}
    want = {k: w for (x, y), w in want.items() if w > 1e-12 for k in ((x, y), (y, x))}
    got = {(r.a, r.b): r.w for r in edges.collect() if r.w > 1e-12}
    assert len(want) > 100 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    names = sorted({k[0] for k in want})
    place = {x: i for i, x in enumerate(names)}
    flow = np.zeros((len(names),) * 2)
    for (x, y), w in want.items():
        flow[place[x], place[y]] = w
    flow /= flow.sum(1, keepdims=True)
    home = np.zeros((2, len(names)))
    home[0, :3], home[1, 3:5] = 1 / 3, 1 / 2
    at = home
    for _ in range(toxicity.STEPS):
        at = toxicity.RESTART * home + (1 - toxicity.RESTART) * at @ flow
    table = spark.createDataFrame([(x, float(home[0, i]), float(home[1, i])) for i, x in enumerate(names[:5])], "t long, p double, m double")
    found = {r.t: (r.p, r.m) for r in toxicity.walk(edges, table).collect()}
    assert all(np.allclose(found.get(x, (0, 0)), at[:, i]) for x, i in place.items()) and np.allclose(at.sum(1), 1)


def test_best_cut_and_bound(spark):
    score, toxic = np.array([0.9, 0.8, 0.2, 0.2, 0.0]), np.array([True, True, False, True, False])
    assert toxicity.best_cut(score, toxic) in (0.5, 0.1)
    assert toxicity.best_cut(score, np.zeros(5, bool)) == float("inf")
    assert spark.range(1).select(toxicity.wilson(F.lit(4.0), F.lit(0.0))).first()[0] == 0.5


def test_blocks_of_the_lexicon(spark, text):
    """A lexicon cut into blocks scores as one that isn't; stems stay with their words."""
    rows = corpus(200, 3, text)
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labels = docs.selectExpr("doc_id", "y AS toxic").where("doc_id < 150")
    one, many = (toxicity.fit(docs, labels, block_terms=n) for n in (1_000_000, 4))
    assert len(one.blocks) == 1 < len(many.blocks)
    both = docs.select(one.score("text").alias("a"), many.score("text").alias("b")).collect()
    assert max(r.a for r in both) > 0 and all(abs(r.a - r.b) < 1e-9 for r in both) and abs(one.cut - many.cut) < 1e-9


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (7, None), (99, 1), (1, 0)], "doc_id long, toxic int")
    assert toxicity.without_toxic(odd, labels).count() == odd.count()
    assert toxicity.toxic_documents(odd, labels).count() == 0
    assert toxicity.toxic_documents(none, labels).count() == 0 and toxicity.without_toxic(odd, labels.limit(0)).count() == odd.count()


def test_odd_rows_under_a_fitted_lexicon(spark, odd, text):
    rows = corpus(200, 4, text)
    docs = spark.createDataFrame([(i + 100, t, "s", "k", 1, None, "s", None) for i, t, _ in rows], odd.schema).union(odd)
    labels = spark.createDataFrame([(i + 100, y) for i, _, y in rows] + [(5, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    found = {r.doc_id for r in toxicity.toxic_documents(docs, labels).collect()}
    assert 35 <= len(found) <= 45 and min(found) >= 100  # null, empty, blank and long texts are clean
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len(found) and kept.where("doc_id is null").count() == 2


def test_terms_without_labels_are_induced(spark, text):
    """Words that no labelled row holds, but that stand beside the seeds elsewhere, find the documents that hold only them."""
    g, rows, known, new = random.Random(5), [], ["vile", "nasty"], ["grotz", "blarfing"]
    for i in range(900):
        kind = ("known", "both", "new", "both")[i % 12 // 3] if i % 3 == 0 else "clean"
        if i < 300 and kind in ("both", "new"):
            kind = "known"
        w = text(70_000 + i, 100, 600).split()
        for at in g.sample(range(len(w)), 6 if kind != "clean" else 0):
            w[at] = g.choice({"known": known, "both": known + new, "new": new}[kind])
        rows.append((i, " ".join(w), kind))
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    labels = spark.createDataFrame([(i, int(k != "clean")) for i, _, k in rows if i < 300], "doc_id long, toxic int")
    found = {r.doc_id for r in toxicity.toxic_documents(docs, labels).collect()}
    hidden, clean = {i for i, _, k in rows if k == "new"}, {i for i, _, k in rows if k == "clean"}
    assert len(hidden) == 50 and len(found & hidden) >= 48 and len(found & clean) <= 0.02 * len(clean)


def test_pairs_of_terms_and_segments():
    g = np.random.default_rng(1)
    for term in (g.integers(0, 1 << 63, 50).astype(np.uint64)[g.integers(0, 50, 999)], g.integers(1, 40, 999).astype(np.uint64)):
        seg = g.integers(0, 30, 999)
        values, at, found = toxicity._distinct(term, seg, 30)
        assert sorted(zip(values[at].tolist(), found.tolist())) == sorted(set(zip(term.tolist(), seg.tolist())))
