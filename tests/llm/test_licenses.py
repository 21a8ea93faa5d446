import random

from sievelake.llm import licenses


def lcs(a, b):
    h = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, h[j] = h[j], prev + 1 if x == y else max(h[j], h[j - 1])
    return h[-1]


def test_patience_is_a_common_subsequence():
    g = random.Random(2)
    for _ in range(200):
        a, b = ([g.randrange(9) for _ in range(g.randrange(12))] for _ in "ab")
        got = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        assert len(got) <= lcs(a, b)
        if len(set(a)) == len(a) and len(set(b)) == len(b):
            assert len(got) == lcs(a, b)


def test_notices_match_brute_force(spark, text):
    g, rows, want = random.Random(4), [], set()
    names = list(licenses.TEMPLATES)
    for i in range(80):
        w = text(i, 120).split()
        if i % 2:
            name = names[i % len(names)]
            notice = licenses.TEMPLATES[name].split()
            for _ in range(int(len(notice) * (0, 0.1, 0.5)[i % 3])):
                notice[g.randrange(len(notice))] = "other"
            w[40:40] = notice
        rows.append((i, " ".join(w)))
        for name, t in licenses.TEMPLATES.items():
            import re

            a, b = (re.findall(r"[0-9a-z_]+", x.lower()) for x in (rows[-1][1], t))
            if lcs(a, b) >= licenses.COVER * len(b):
                # the window must hold it too
                if any(lcs(a[p : p + len(b) + 2], b) >= licenses.COVER * len(b) for p in range(len(a))):
                    want.add((i, name))
    got = {(r.doc_id, r.license): r for r in licenses.license_notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) <= want and len(want) > 25
    assert {i for i, _ in got} == {i for i, _ in want}  # what is missing lies within another
    assert all(r.start_word >= 38 for r in got.values())
    whole = {(i, names[i % len(names)]) for i in range(80) if i % 2 and i % 3 == 0}
    assert whole <= set(got) and all(got[k].coverage == 1 for k in whole)


def test_odd_rows(spark, odd, none):
    notice = "x Released under the MIT License. Released under the MIT License."
    docs = spark.createDataFrame([(1, notice, "a"), (1, notice, "a"), (None, "released UNDER the mit license", "b"), (2, None, "c"), (3, "", "d"), (4, "mit license " * 50_000, "e")], "doc_id long, text string, license string")
    got = sorted((r.doc_id or 0, r.license, r.coverage, r.start_word) for r in licenses.license_notices(docs).collect())
    assert got == [(0, "MIT/notice", 1.0, 0), (1, "MIT/notice", 1.0, 1), (1, "MIT/notice", 1.0, 1)]
    assert licenses.license_notices(odd).count() == 0 and licenses.license_notices(none).count() == 0


def test_spread_matches_brute_force():
    g = random.Random(3)
    for _ in range(300):
        a, b = ([g.randrange(6) for _ in range(g.randrange(14))] for _ in "ab")
        most, first, last = licenses.spread(a, b)
        assert most == lcs(a, b) and (not most or lcs(a[first : last + 1], b) == most and lcs(a[first + 1 : last + 1], b) < most and lcs(a[:last], b) < most)


def test_notices_with_insertions_match_whole_texts(spark, text):
    import re

    rows, want = [], set()
    words = {k: re.findall(r"[0-9a-z_]+", t.lower()) for k, t in licenses.TEMPLATES.items()}
    for name, notice in words.items():
        for case in range(5):
            w, half = text(len(rows), 60).split(), len(notice) // 2
            more = text(900 + len(rows), (30, 60, 400, 0, 120)[case]).split()
            if case == 3:  # a token after every word
                w[20:20] = [x for y in notice for x in (y, "br")]
            elif case == 4:  # every other word
                w[20:20] = notice[:half:2] + more + notice[half::2]
            else:
                w[20:20] = notice[:half] + more + notice[half:]
            rows.append((len(rows), " ".join(w)))
            if lcs(w, notice) >= licenses.COVER * len(notice):
                want.add((rows[-1][0], name))
    got = {(r.doc_id, r.license) for r in licenses.license_notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, _ in want} <= {i for i, _ in got} and len(want) >= 60
    assert all((n * 5, name) in got for n, name in enumerate(words) if len(words[name]) > 40)  # broken in the middle
    assert all(lcs(rows[i][1].split(), words[k]) >= licenses.COVER * len(words[k]) for i, k in got)


def test_licences_that_hold_each_other(spark):
    """The whole text wins over its beginning, the licence with the clause over the one without, and parts without their beginning are found."""
    t = licenses.TEMPLATES
    rows = ["a b " + t["MIT/full"], t["BSD-2-Clause/full"], "x " + t["BSD-3-Clause/full"] + " y", t["MIT/conditions"], t["ISC/full"], t["BSD/grant"], t["MIT/notice"] + " w " * 50 + t["Apache-2.0/full-header"], "(c) 2020 Someone. All rights reserved."]
    got = sorted((r.doc_id, r.license) for r in licenses.license_notices(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect())
    assert got == [(0, "MIT/full"), (1, "BSD-2-Clause/full"), (2, "BSD-3-Clause/full"), (3, "MIT/conditions"), (4, "ISC/full"), (5, "BSD/grant"), (6, "Apache-2.0/full-header"), (6, "MIT/notice"), (7, "reserved/notice")]
