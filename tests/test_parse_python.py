import ast

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievelake.operators.parse_python import analyze, hopeless


def bound(source):
    a = analyze(source)
    assert not a["has_error"]
    return [(b["key"], b["raw_value"], b["line"], b["source"]) for b in a["bindings"]]


def test_five_forms():
    assert bound('p: str = "a1"\nd = {"k": "b2", **d}\nf(q="c3")\nif (w := "d4"): pass\nself.x . y = "e5"\ndef g(z="f6", *, u: str = \'g7\'): pass\n') == [
        ("p", "a1", 1, "assignment"), ("k", "b2", 2, "dict_entry"), ("q", "c3", 3, "keyword_argument"), ("w", "d4", 4, "walrus"), ("self.x.y", "e5", 5, "assignment"), ("z", "f6", 6, "parameter_default"), ("u", "g7", 6, "parameter_default")]


def test_sequences_pair_if_they_line_up():
    assert bound('host, password = "h", "p"\n') == [("host", "h", 1, "assignment"), ("password", "p", 1, "assignment")]
    assert bound('(a, b) = ("x", "y")') == [("a", "x", 1, "assignment"), ("b", "y", 1, "assignment")]
    assert bound('a, b = f("x,y")\n') == [] and bound('a, *b = "x", "y"') == [("a", "x", 1, "assignment")]
    assert bound('[a, b] = "x", "y"') == [] and bound('a = b = "v"') == [("b", "v", 1, "assignment")]


@pytest.mark.parametrize("source", ['x = ("v")', 'x = "a" "b"', 'x = "a" + y', 'x["k"] = "v"', 'if x == "v": pass', "x += 'v'", 'x = f"a" "b"', 'x = (\n  "v"  # why\n)'])
def test_not_bound(source):
    assert bound(source) == []


def test_literals():
    found = analyze('a = f"x{y["q"]}z"\nb = r"\\""\nc = b\'é\'\nd = """t\nu"""\nf("v")(k="w")\ng(("v"))\nh = f"none"\n'.replace("b'é'", "b'e'"))["bindings"]
    assert [(b["key"], b["raw_value"], b["has_interpolation"]) for b in found] == [("a", 'x{y["q"]}z', True), ("b", '\\"', False), ("c", "e", False), ("d", "t\nu", False), ("k", "w", False), ("h", "none", False)]
    source = 'é = "ü"; key = "v"\n'
    b = analyze(source)["bindings"][1]
    assert source.encode()[b["span_start"] : b["span_end"]] == b'"v"' and b["line_text"] == source[:-1]


def test_signatures():
    f = analyze("def f(a, /, b, *, c, d=lambda x, y: x): pass")["functions"][0]
    assert [p["kind"][0] for p in f["params"]] == list("nmnmnn") and [p["name"] for p in f["params"]] == ["a", "", "b", "", "c", "d"]
    source = "@task(\n  retries=3,\n)\n@a . b\nasync def g(x: int = (1), *args: int, y=f(')'), **kw: str,  # )\n):\n    def inner(): ...\n"
    g, inner = analyze(source)["functions"]
    assert (g["decorators"], g["line"], inner["line"], inner["params"]) == (["task", "a.b"], 5, 7, [])
    assert [(p["kind"], p["name"], p["has_default"]) for p in g["params"]] == [("normal", "x", True), ("star", "args", False), ("normal", "y", True), ("double_star", "kw", False)]
    assert [source[p["span_start"] : p["span_end"]] for p in g["params"]] == ["x: int = (1)", "*args: int", "y=f(')')", "**kw: str"]
    assert source[g["paren_open"]] == "(" and source[g["paren_close"] :].startswith("):\n    def inner")
    typed = analyze("def h[T: (int, str)](x: T): pass")["functions"][0]
    assert typed["paren_open"] == 20


def test_imports():
    source = '#!x\n"""doc"""\nfrom __future__ import annotations\n# c\nimport os.path, a.b as c\nfrom .r import s\nfrom a import t\ndef f():\n    import late\n'
    a = analyze(source)
    assert a["modules"] == ["__future__", "os", "a"] and a["binds_os"] and source[a["first_import"] :].startswith("import os")
    assert source[a["after_prelude"] :].startswith("import os")
    assert not analyze("import os as o\nfrom os import environ")["binds_os"] and analyze("x = 1")["after_prelude"] == 0
    assert analyze("# only\n")["after_prelude"] == 7


def test_broken():
    for source in ("def broken(:", "\0", "(" * 500):
        assert analyze(source)["has_error"] and analyze(source)["bindings"] == []
    assert analyze("") == {"has_error": False, "functions": [], "bindings": [], "modules": [], "binds_os": False, "first_import": None, "after_prelude": 0}


@settings(max_examples=150, deadline=None)
@given(st.text("abé \n'\"\\{}#(),", max_size=12), st.sampled_from(["", "r", "b", "f", "rb"]), st.sampled_from(['"', "'", '"""', "'''"]))
def test_content_is_what_lies_between_the_quotes(content, prefix, quote):
    source = f"k = {prefix}{quote}{content}{quote}\n"
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return
    found = analyze(source)["bindings"]
    if found and len(tree.body) == 1 and found[0]["key"] == "k":
        start, end = found[0]["span_start"], found[0]["span_end"]
        assert source.encode()[start:end].decode() == source[4:].rstrip() or "#" in content or "\n" in content


def test_nothing_in_a_source_makes_it_fail():
    one = lambda s: (lambda r: (r["has_error"], [(f["name"], f["line"]) for f in r["functions"]], [(b["key"], b["raw_value"], b["line"]) for b in r["bindings"]]))(analyze(s))
    assert one("x = 1\rdef deploy(a):\n    pass\n") == (False, [("deploy", 1)], [])
    assert one("\ufefftoken = 'abcd'\ndef f(a): ...\n") == (False, [("f", 2)], [("token", "abcd", 1)])
    f = analyze("\ufeffdef f(a): ...\n")["functions"][0]
    assert (f["paren_open"], f["paren_close"]) == (8, 10)
    assert one("# coding: latin-1\ntoken = 'é1é2'\n") == (False, [], [("token", "é1é2", 2)])
    for s in ("a = '\0'", "\ud800", "(" * 3000, "x = " + "-" * 5000 + "1", "def", "\f\x1a"):
        assert analyze(s)["has_error"] in (True, False)


def test_statements_of_broken_sources():
    one = lambda s: (lambda r: (r["has_error"], [(f["name"], f["line"]) for f in r["functions"]], [(b["key"], b["line"]) for b in r["bindings"]]))(analyze(s))
    assert one('print "x"\ntoken = "abcd"\n@task\ndef deploy():\n    pass\n') == (True, [("deploy", 4)], [("token", 2)])
    assert one('class A:\n    def f(:\n        pass\n    token = "abcd"\n    def g(self):\n        key = "zz"\n') == (True, [("g", 5)], [("token", 4), ("key", 6)])
    assert one('x = """\nabc def\n"""\nprint "é"\ntoken = "é"\nif x:\n    y = 1\nelse:\n    print "z"\n    key = "qq"\n') == (True, [], [("x", 1), ("token", 5), ("key", 10)])
    assert one('call(\n"a",\n)\nexec "x"\ntoken = (\n"abcd")\n') == (True, [], [])
    assert one('def broken(:\n    token = "abcd"\n') == (True, [], []) and one('token = "abcd') == (True, [], [])


PROSE = "The cat sat. In the end, it\nwas “so” — of course!\nTitle.\nIt was $5 for\n    the two of them.\n\n"
TABLE = "anhely | eran. | reen\nof_it | sto.\n"


@pytest.mark.parametrize("text", [PROSE * 40, TABLE * 80, (PROSE + TABLE) * 40])
def test_prose_is_told_from_code_without_trying_every_join(text, monkeypatch):
    tried = []
    real = ast.parse
    with monkeypatch.context() as m:
        m.setattr(ast, "parse", lambda s: tried.append(len(s)) or real(s))
        found = analyze(text + 'token = "abcd"\n' + text)
    assert found["has_error"] and [(b["key"], b["line"]) for b in found["bindings"]] == [("token", text.count("\n") + 1)]
    assert len(tried) <= 2 * 2 * text.count("\n") + 9 and sum(tried) < 6 * 2 * len(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["foo", "bar in", "match", "type", "_", "is not", "x·", "3rd", " ", "\n", "\n    ", "(", ")", ":", ".", "|", ",", "!", "!=", "$", "—", "?", "'", '"', '"""', "#", "\\\n", "f'", "é", "= 1\n", 'k = "v"\n', "if x:\n    y = 2\n", "def f(a):\n", "lambda", "\ufeff"]), max_size=14))
def test_what_is_told_from_a_part_holds_for_the_whole(parts):
    text = "".join(parts)
    if hopeless(text):
        with pytest.raises((SyntaxError, ValueError)):
            ast.parse(text.removeprefix("\ufeff"))
    lines, want = text.split("\n"), []
    for n in range(1, len(lines)):
        try:
            ast.parse("\n".join(lines[:n]) + "\n")
            want.append(n)
        except (SyntaxError, ValueError):
            pass
        if hopeless("\n".join(lines[:n]) + "\n"):
            assert not [w for w in want if w >= n]
            with pytest.raises((SyntaxError, ValueError)):
                ast.parse(text)


def test_characters_that_begin_no_token():
    for at in range(161, 0x10000):
        assert not (hopeless(f"a = b{chr(at)}c\n") and f"a{chr(at)}".isidentifier())
    assert [hopeless(s) for s in ("match x y", "foo in bar", "x != y", "'it' is so", "foo # bar baz", "foo bar # '", "a b", "type X")] == [True, False, False, None, None, True, True, False]
