import hashlib
import math
from collections import defaultdict

from sievelake.llm import mixing


def test_weights_meet_their_targets():
    w = mixing.weights([900, 50, 50], entropy=0.8, epochs=100)
    assert abs(-sum(p * math.log(p) for p in w) - 0.8 * math.log(3)) < 1e-6
    w = mixing.weights([900, 50, 50], entropy=1.0, epochs=2)
    assert abs(max(p * 1000 / t for p, t in zip(w, [900, 50, 50])) - 2) < 1e-6
    assert mixing.weights([5]) == [1.0] and mixing.weights([7, 7]) == [0.5, 0.5]


def test_sources_more_even_than_the_target():
    entropy = lambda w: -sum(p * math.log(p) for p in w if p) / math.log(len(w))
    w = mixing.weights([520, 480], entropy=0.97)
    assert abs(entropy(w) - 0.97) < 1e-6 and w[0] > w[1]
    tokens = [100, 101, 102, 130]
    w = mixing.weights(tokens, entropy=0.5, epochs=2)  # the repetition limit comes first
    assert entropy(w) > 0.5 and abs(max(p * sum(tokens) / t for p, t in zip(w, tokens)) - 2) < 1e-6
    assert mixing.weights([7, 7, 7], entropy=0.5) == [1 / 3] * 3  # no exponent tells them apart


def test_uses_match_brute_force(spark, text):
    rows = [(i, text(i, 5 + i % 40), "abc"[min(2, i // 100)] if i % 50 else None) for i in range(230)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.source or "", r.epoch, r.block) for r in mixing.mixed(docs, blocks=4, entropy=0.99, epochs=5.0).collect())
    by = defaultdict(list)
    for i, t, s in rows:
        by[s or ""].append((i, len(t.split())))
    names = sorted(by, key=lambda s: (s == "", s))
    totals = [sum(n for _, n in by[s]) for s in names]
    w, want = mixing.weights(totals, 0.99, 5.0), []
    for s, total, p in zip(names, totals, w):
        quota = math.floor(p * sum(totals))
        for epoch in range(math.ceil(quota / total)):
            at = epoch * total
            for _, i, n in sorted((int(hashlib.md5(f"mix|{epoch}|{i}".encode()).hexdigest()[:15], 16), i, n) for i, n in by[s]):
                if at < quota:
                    want.append((i, s, epoch, at * 4 // quota))
                at += n
    assert got == sorted(want) and max(e for _, _, e, _ in want) > 0


def test_many_sources_without_broadcast(spark, text, monkeypatch):
    docs = spark.createDataFrame([(i, text(i, 5 + i % 40), f"s{i % 7}" if i % 9 else None) for i in range(120)], "doc_id long, text string, source string")
    want = sorted(map(str, mixing.mixed(docs).collect()))
    monkeypatch.setattr(mixing.C, "BROADCAST_BYTES", 0)
    assert sorted(map(str, mixing.mixed(docs).collect())) == want and len(want) > 100


def test_odd_rows(odd, none):
    out = mixing.mixture(odd)
    assert out.columns == odd.columns
    used = {(r.doc_id, r.source) for r in out.collect()}
    assert (2, "a") not in used and (3, None) not in used and (4, "b") not in used and (6, None) in used and (None, "a") in used
    assert mixing.mixture(none).count() == 0
