import pytest

from sievelake.operators.parse_yaml import scalars


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a: b", [("a", "b", 1)]),
        ("a:\n  b: 'c d'\r\n", [("b", "c d", 2)]),
        ('"a": "x # y" # z', [("a", "x # y", 1)]),
        ("- - k: v\n-\n- x", [("k", "v", 1)]),
        ("url: https://x/#y", [("url", "https://x/#y", 1)]),
        ("a: |2-\n   b: c\n\n   d: e\nf: g", [("f", "g", 5)]),
        ("a: >\n b: c\n", []),
        ("two words: v\n: v\n# k: v\n", []),
        ("https://x:80\nk:v\n", []),
        ("k: 'a: b'\nl: \"\"", [("k", "a: b", 1), ("l", "", 2)]),
    ],
)
def test_scalars(text, want):
    assert [(s["key"], s["value"], s["line"]) for s in scalars(text)] == want
