import random

import numpy as np
import pyarrow as pa

from sievelake.llm import common as C
from sievelake.llm import decontam


def plain_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_align_matches_the_plain_recurrence():
    g = random.Random(3)
    for _ in range(60):
        a, b = ([g.randrange(4) for _ in range(g.randrange(1, 14))] for _ in "ab")
        assert decontam.align(np.array(a), np.array(b)) == plain_alignment(a, b)


def test_leaks_match_brute_force(spark, text):
    items = [text(900 + i, 30) for i in range(12)]
    g, docs = random.Random(5), [text(i, 150) for i in range(60)]
    for i in range(30):
        item = items[i % 12].split()
        for _ in range(i % 6):
            item[g.randrange(30)] = f"edit{g.randrange(99)}"
        w = docs[i].split()
        docs[i] = " ".join(w[:50] + item + w[50:])
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    hashes = lambda s: C.Tokens(pa.array([s])).hash
    want = {(i, j) for i, d in enumerate(docs) for j, b in enumerate(items) if decontam.align(hashes(b), hashes(d)) >= decontam.LEAK * 60}
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(table, bench).collect()}
    assert got == want and len(want) >= 30
    # a benchmark in several blocks gives the same
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(table, bench, block_bytes=700).collect()} == want
    assert {r.doc_id for r in decontam.without_contaminated(table, bench).collect()} == set(range(60)) - {i for i, _ in want}


def test_windows_lose_nothing_of_whole_texts():
    """Items copied with words inserted, dropped and changed: the same scores as of alignments with whole texts, if a seed is left."""
    g = random.Random(11)
    for n in range(150):
        item = [f"i{n}_{k}" for k in range(g.randrange(4, 60))]
        copy = []
        for k, w in enumerate(item):
            copy += [] if g.random() < 0.1 else [w if g.random() > 0.1 else "x"]
            copy += [f"y{g.random()}" for _ in range(g.choice([0, 0, 2]) if n % 3 else 2 * (k % 2))]
        doc = [f"z{g.random()}" for _ in range(g.randrange(200))] + copy + [f"z{g.random()}" for _ in range(g.randrange(200))]
        items = decontam.Items([" ".join(item)], 2)
        t = C.Tokens(pa.array([" ".join(doc)]))
        share = decontam.align(items.words[0], t.hash) / (2 * len(item))
        seeded = bool(set(zip(item, item[1:])) & set(zip(doc, doc[1:])))
        got = decontam.leaked(t, items, items.keys, 2)
        assert got == ([(0, 0, share)] if seeded and share >= decontam.LEAK else [])
    words = [f"a{k}" for k in range(40)]
    broken = " ".join(w + (" u v" if k % 2 else "") for k, w in enumerate(words))
    items = decontam.Items([" ".join(words)], 2)
    assert decontam.leaked(C.Tokens(pa.array([broken])), items, items.keys, 2) == [(0, 0, 0.525)]


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (None, "漢字 zz yy xx"), (3, "one")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontam.contaminated(odd, bench).collect())
    assert got == [(7, 3), (7, 3), (8, 3), (8, 3)]
    assert decontam.without_contaminated(odd, bench).count() == odd.count() - 2
    assert decontam.contaminated(none, bench).count() == 0 and decontam.contaminated(odd, bench.limit(0)).count() == 0
