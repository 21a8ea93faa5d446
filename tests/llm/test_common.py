import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sievelake.llm import common as C


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("abAB _é,.\n9", max_size=40)), max_size=8))
def test_tokens_are_those_of_a_plain_reading(texts):
    t = C.Tokens(pa.array(texts, pa.string()), (2,))
    plain = [re.findall(rb"[0-9a-zA-Z_\x80-\xff]+", (x or "").encode()) for x in texts]
    flat = [(i, w.translate(bytes.maketrans(b"AB", b"ab"))) for i, ws in enumerate(plain) for w in ws]
    assert t.count.tolist() == [len(w) for w in plain]
    assert t.row.tolist() == [i for i, _ in flat]
    known = {}
    for h, (_, w) in zip(t.hash.tolist(), flat):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_blocks_do_not_change_hashes(text, monkeypatch):
    column = pa.array([text(1, 500), "", "x" * 900, text(2, 50)])
    whole = C.Tokens(column)
    monkeypatch.setattr(C, "BLOCK", 97)
    C._powers.clear()
    assert (C.Tokens(column.slice(0, 2)).hash == whole.hash[:500]).all() and C.Tokens(column).count.tolist()[3] == 50
    C._powers.clear()


def test_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("x", "y"), ("d", "c"), ("y", "x"), ("q", "q")], "a string, b string")
    got = {r.node: r.component for r in C.components(edges).distinct().collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in C.components(chain).collect()} == {0}
