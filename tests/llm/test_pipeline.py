import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from sievelake.llm import common as C
from sievelake.llm import decontam, mixing, neardup, queries, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "benchmark decontamination", "mixing", "sharding"]
    assert [int(k[2:].split("_")[0]) for k in queries.QUERIES] == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)


def test_pipeline_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "shard"]
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    toxic = {r.doc_id for r in toxicity.toxic_documents(docs, labels).collect()}
    clean = docs.where(~docs.doc_id.isin(list(toxic) or [-1]))
    dropped = {r.doc_id for r in neardup.near_duplicates(clean).collect() if r.doc_id != r.keep_id}
    leaks = {r.doc_id for r in decontam.contaminated(clean, bench).collect()}
    left = {r.doc_id for r in docs.select("doc_id").collect()} - toxic - dropped - leaks
    used = {r.doc_id for r in mixing.mixed(docs.where(docs.doc_id.isin(list(left)))).collect()}
    assert ids <= left and len(ids & used) >= 0.95 * len(used)


def test_run_matches_brute_force(spark, text, tmp_path):
    """Every row of run(), by loops over all documents: planted toxic words, all pairs, whole-text alignments, sorted permutations, every capacity."""
    g, rows, labels = random.Random(9), [], []
    items = [text(5000 + i, 40) for i in range(3)]
    for i in range(260):
        w = text(3000 + i, 90).split()
        if i % 6 == 0:
            for at in g.sample(range(90), 6):
                w[at] = g.choice(["vile", "nasty", "rotten", "foul"])
        elif i % 20 == 7:
            w[30:30] = items[i % 3].split()
        rows.append((i, " ".join(w), "en", ("a", "a", "a", "b", "c", None)[i % 12 // 2], len(" ".join(w))))
        if i < 200:
            labels.append((i, 1, int(i % 6 == 0)))
    for i in range(40):
        _, t, lang, source, n = rows[6 * i + 1]
        w = t.split()
        w[i % 80] = "edited" if i % 2 else w[i % 80]
        rows.append((1000 + i, " ".join(w), lang, "c", n))
    rows += [(2000, None, "en", "a", None), (2001, "", "en", "b", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter((r.doc_id, r.shard) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    left = {r[0]: r for r in rows if not (r[0] < 260 and r[0] % 6 == 0)}
    # near duplicates: all pairs, idf from counts over what is left
    texts = {i: r[1] for i, r in left.items() if r[1]}
    grams = {i: Counter(zip(t.split(), t.split()[1:])) for i, t in texts.items()}
    held = Counter(x for c in grams.values() for x in c)
    n = sum(r[1] is not None for r in left.values())
    weigh = {i: {x: (1 + math.log(k)) * (math.log((n + 1) / (held[x] + 1)) + 1) for x, k in c.items()} for i, c in grams.items()}
    keep = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and keep[i] != keep[j]:
                a, b = weigh[i], weigh[j]
                both = sum(min(v, b[x]) for x, v in a.items() if x in b)
                if both >= 0.5 * (sum(a.values()) + sum(b.values()) - both):
                    lo, hi = sorted((keep[i], keep[j]))
                    keep = {k: lo if v == hi else v for k, v in keep.items()}
    assert len(set(keep.values())) == len(texts) - 40
    left = {i: r for i, r in left.items() if keep.get(i, i) == i}
    # leaks: alignments with whole texts
    hashes = lambda t: C.Tokens(pa.array([t.lower()])).hash
    leaks = {i for i, r in left.items() if r[1] and any(decontam.align(hashes(b), hashes(r[1])) >= decontam.LEAK * 80 for b in items)}
    assert 5 < len(leaks) < 20
    left = {i: r for i, r in left.items() if i not in leaks}
    # mixing: each source's permutations in order, until its quota
    by: dict = {}
    for i, r in left.items():
        if r[1]:
            by.setdefault(r[3] or "", []).append((i, len(r[1].split())))
    names = sorted(by, key=lambda s: (s == "", s))
    totals = [sum(n for _, n in by[s]) for s in names]
    md5 = lambda epoch, i: int(hashlib.md5(f"mix|{epoch}|{i}".encode()).hexdigest()[:15], 16)
    used: Counter = Counter()
    for s, total, w in zip(names, totals, mixing.weights(totals)):
        quota = math.floor(w * sum(totals))
        for epoch in range(math.ceil(quota / total)):
            at = epoch * total
            for _, i, n in sorted((md5(epoch, i), i, n) for i, n in by[s]):
                used[i] += at < quota
                at += n
    used = +used
    assert max(used.values()) > 1 and len(used) < sum(map(len, by.values()))
    # sharding: the least capacity over groups in the permutation's order
    groups = [(i, len(left[i][1].encode()) * used[i]) for i in sorted(used, key=lambda i: md5(0, i))]

    def cut(capacity):
        shard, at, out = 0, 0, {}
        for i, size in groups:
            if at + size > capacity:
                shard, at = shard + 1, 0
            at += size
            out[i] = shard
        return out

    lo, hi = max(n for _, n in groups), sum(n for _, n in groups)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if max(cut(mid).values()) < 64 else (mid + 1, hi)
    want = cut(lo)
    assert got == Counter({(i, want[i]): k for i, k in used.items()})
    assert np.unique([s for _, s in got]).size > 30


@pytest.mark.parametrize("n", range(5))
def test_stages_take_odd_rows(spark, odd, none, n):
    name, stage = corpus_pipeline.STAGES[n]
    for docs in (odd, none):
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns
        got, had = (Counter(map(str, d.select(docs.columns).collect())) for d in (out, docs))
        # filters keep rows as they are, mixing only repeats them, sharding keeps all
        assert set(got) <= set(had) and (n == 3 or all(got[r] <= had[r] for r in got)) and (n != 4 or got == had)
        assert n == 3 or not any("doc_id=2" in r and "None" in r for r in had) or any("doc_id=2" in r for r in got)
