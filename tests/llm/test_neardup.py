import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sievelake.llm import neardup


def edited(s: str, seed: int, share: float) -> str:
    g = random.Random(seed)
    return " ".join(f"z{g.randrange(9999)}" if g.random() < share else w for w in s.split())


def test_groups_match_brute_force(spark, text):
    texts = [text(i, 120) for i in range(40)]
    texts += [edited(texts[i], i, 0.04) for i in range(12)] + [edited(texts[0], 100 + i, 0.03) for i in range(25)] + [texts[5]] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bags = [Counter(zip(t.split(), t.split()[1:])) for t in texts]
    df = Counter(s for b in bags for s in b)
    weights = [{s: (1 + math.log(n)) * (math.log((len(bags) + 1) / (df[s] + 1)) + 1) for s, n in b.items()} for b in bags]
    pairs = set()
    for i in range(len(texts)):
        for j in range(i):
            both = sum(min(w, weights[j][s]) for s, w in weights[i].items() if s in weights[j])
            if both / (sum(weights[i].values()) + sum(weights[j].values()) - both) >= neardup.THRESHOLD:
                pairs.add((j, i))
    keep = {r.doc_id: r.keep_id for r in neardup.near_duplicates(docs).collect()}
    found = {(a, b) for a, b in pairs if a in keep and keep[a] == keep.get(b)}
    assert len(pairs) > 300 and len(found) >= 0.97 * len(pairs)
    assert set(keep) <= {x for p in pairs for x in p}
    kept = {r.doc_id for r in neardup.without_near_duplicates(docs).collect()}
    assert kept == {i for i in range(len(texts)) if keep.get(i, i) == i}


def test_odd_rows(spark, odd, none):
    kept = neardup.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0, r.text is None) for r in kept.collect())
    # the long near copy, the repeated row and the same word in other letters go; null texts stay
    assert ids == sorted([(False, 1, False), (False, 2, True), (False, 3, False), (False, 4, False), (False, 5, False), (True, 0, False), (True, 0, True), (False, 7, False), (False, 9, False), (False, 10, False)])
    assert neardup.without_near_duplicates(none).count() == 0 and neardup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("small, block", [(0, 16), (0, 1 << 20), (1 << 20, 16)])
def test_texts_of_one_template(spark, text, small, block):
    """Many texts that share buckets without being similar, a few of which are: what is found doesn't depend on blocks, and holds all verified links."""
    frame = text(77, 60, 5000)
    rows = [(i, frame + " " + text(500 + i, 70, 5000)) for i in range(120)]
    rows += [(200 + i, rows[7 * i][1].replace("w1", "w9", 3) + " end") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    df, n = neardup.frequencies(docs)
    idf = (np.log((n + 1) / (df + 1)) + 1).astype(np.float32)
    signed = {bytes(r.k): set(r.keys) for r in neardup.band_keys(docs, idf, "text", 20, 1).collect()}
    key = {hashlib.md5(t.encode()).digest(): t for _, t in rows}
    names = sorted(key)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if signed[a] & signed[b]]
    sim = neardup.jaccard(pa.array([key[a] for a, _ in pairs]), pa.array([key[b] for _, b in pairs]), idf)
    group = {a: a for a in names}
    for (a, b), x in zip(pairs, sim):
        if x >= 0.5 and group[a] != group[b]:
            lo, hi = sorted((group[a], group[b]))
            group = {k: lo if v == hi else v for k, v in group.items()}
    want = {k: v for k, v in group.items() if sum(v == x for x in group.values()) > 1}
    got = {bytes(r.node): bytes(r.component) for r in neardup.groups(docs, rows=1, small=small, block=block).collect()}
    assert got == want and len(pairs) > 2000 and 20 <= len(want) < 60
