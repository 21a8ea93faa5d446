from collections import defaultdict

import pyarrow as pa

from sievelake.llm import common as C
from sievelake.llm import suffixdedup


def test_every_long_repeat_is_found(spark, text):
    passages = [text(500 + i, n) for i, n in enumerate((50, 51, 64, 90, 200))]
    docs = [text(i, 60 + i) for i in range(30)]
    for i in range(20):
        w = docs[i].split()
        docs[i] = " ".join(w[:20] + passages[i % 5].split() + w[20:])
    docs += [text(900, 60) + " " + text(901, 30) + " " + text(900, 60), docs[25]]
    docs[28] += " " + " ".join(docs[26].split()[:49])
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = defaultdict(list)
    for r in suffixdedup.repeated(table, buckets=3).collect():
        got[r.doc_id].append((r.start_word, r.end_word))
    grams = defaultdict(set)
    for i, d in enumerate(docs):
        w = d.split()
        for p in range(len(w) - 49):
            grams[tuple(w[p : p + 50])].add((i, p))
    want = defaultdict(set)
    for spots in grams.values():
        if len({i for i, _ in spots}) > 1:
            for i, p in spots:
                want[i] |= set(range(p, p + 50))
    assert set(got) == set(want) and 30 not in got
    for i, spans in got.items():
        found = {x for a, b in spans for x in range(a, b)}
        assert found == want[i]


def test_anchors_depend_on_the_passage_alone(text):
    inner = text(1, 70)
    spots = []
    for before, after in (("a b c", "d"), (text(2, 40), text(3, 40)), ("", "")):
        t = C.Tokens(pa.array([f"{before} {inner} {after}"]))
        at, prints = suffixdedup.anchors(t)
        n = len(before.split())
        spots.append({(p - n, int(f)) for p, f in zip(t.place[at], prints) if 0 <= p - n <= 70 - suffixdedup.PREFIX})
    assert set.intersection(*spots) and min(p for p, _ in set.intersection(*spots)) < suffixdedup.SPAN


def test_odd_rows(spark, odd, none):
    got = {r.doc_id for r in suffixdedup.repeated(odd).collect()}
    assert got == {5, 6}
    assert suffixdedup.repeated(none).count() == 0
    assert spark.catalog.listTables() == [] or not [t for t in spark.catalog.listTables() if t.name.startswith("sievelake_")]
