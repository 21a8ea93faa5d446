from hypothesis import given, settings
from hypothesis import strategies as st

from sievelake.llm import chatformat

MARKS = st.lists(st.sampled_from(["<|turn|>", "<|end|>", "<|null|>", "<|n|>", "<\\|end|>", "<\\\\|turn|>", "\n", "\r", "a", "<", "|", "\\", ">", "<|end|>\n<|turn|>user\n"]), max_size=6).map("".join)
TURN = st.tuples(st.one_of(st.none(), st.sampled_from(["user", "assistant", ""]), MARKS), st.one_of(st.none(), MARKS))


@settings(max_examples=400, deadline=None)
@given(st.lists(TURN, max_size=5))
def test_any_conversation_comes_back(turns):
    rendered, _ = chatformat.round_trip(turns)
    assert chatformat.parse(rendered) == turns


@settings(max_examples=200, deadline=None)
@given(MARKS)
def test_escapes_are_undone(s):
    assert chatformat.unescape(chatformat.escape(s)) == s


def test_plain_turns_are_not_escaped():
    assert chatformat.round_trip([("user", "hi\nyou"), (None, None)]) == ("<|turn|>user\nhi\nyou<|end|>\n<|turn|><|null|>\n<|null|><|end|>\n", 0)
    assert chatformat.parse("<|turn|>user\nno end") is None and chatformat.round_trip([]) == ("", 0)


def test_odd_rows(spark):
    rows = [(1, 2, "b", "x"), (1, 1, "a", "<|end|>\n"), (None, 1, None, None), (None, None, "r", ""), (2, 1, "a", "y"), (2, 1, "a", "y"), (3, 1, "a", "z" * 200_000)]
    table = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    got = {r.conv_id: r for r in chatformat.formatted(table).collect()}
    assert {k: (r.turns, r.escaped_turns) for k, r in got.items()} == {1: (2, 1), None: (2, 0), 2: (2, 0), 3: (1, 0)}
    assert chatformat.parse(got[1].rendered) == [("a", "<|end|>\n"), ("b", "x")]
    assert chatformat.formatted(table.limit(0)).count() == 0
