"""One Python source to functions, bindings and imports; pure Python, run inside the parse stage.

Offsets are UTF-8 bytes, lines count from 1 and end at a line feed. Of a source that doesn't parse, the statements that do are kept
(``recovered``); has_error says so. Nothing in a source can make the parser fail: at worst it has an error and nothing else.
"""

from __future__ import annotations

import ast
import io
import keyword
import re
import tokenize
from bisect import bisect_right

_OPEN = re.compile(rb"(?i)[a-z]{0,3}?(\"\"\"|'''|\"|')")
#: lines as the parser of Python counts them
_LINE = re.compile(rb"\r\n|\r|\n")
_GOES_ON = re.compile(r"[)\]}]|(?:else|elif|except|finally)\b")
#: statements that are tried as one, where one alone doesn't parse: open brackets, strings of many lines
_JOINED = 8
_COMMENT_OR_SPACE = re.compile(rb"(?:\s|\\\n|#[^\n]*)*")
_WORD = rf"(?!(?:{'|'.join([*keyword.kwlist, *keyword.softkwlist])})\b)[^\W\d]\w*"
#: what no source has outside of strings and comments: two names without anything between them, characters that begin no token
_NEVER = re.compile(rf"(?<!\w){_WORD}[ \t]+{_WORD}|[$?`\u2010-\u2027\u2030-\u203e\u3001-\u3003\u3008-\u3011\uff01\uff0c\uff1a\uff1b\uff1f]|!(?!=)")
_MAY_HIDE = re.compile(r"['\"#\\]")


class Source:
    def __init__(self, text: str):
        self.raw = text.encode("utf-8", "surrogatepass")
        self.starts = [0, *(m.end() for m in re.finditer(b"\n", self.raw))]
        self.rows = [3 if text.startswith("\ufeff") else 0, *(m.end() for m in _LINE.finditer(self.raw))]

    def at(self, line: int, column: int) -> int:
        """A place that the parser gives."""
        return self.rows[min(line, len(self.rows)) - 1] + column

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)

    def line(self, offset: int) -> int:
        return bisect_right(self.starts, offset)

    def line_text(self, line: int) -> str:
        end = self.starts[line] - 1 if line < len(self.starts) else len(self.raw)
        return self.text(self.starts[line - 1], end)

    def text(self, start: int, end: int) -> str:
        return self.raw[start:end].decode("utf-8", "replace")

    def bare(self, start: int, end: int) -> bool:
        """Not the whole of a pair of brackets, which hide a literal."""
        before = self.raw[:start].rstrip(b" \t\r\n\\")
        after = _COMMENT_OR_SPACE.match(self.raw, end).end()
        return not (before.endswith(b"(") and self.raw[after : after + 1] == b")" and not re.search(rb"[\w\])]\s*\($", before[-80:]))


def _literal(src: Source, node: ast.AST) -> dict | None:
    """Extents of a node that is exactly one string literal."""
    if isinstance(node, ast.JoinedStr):
        formatted = any(isinstance(v, ast.FormattedValue) for v in node.values)
    elif isinstance(node, ast.Constant) and isinstance(node.value, (str, bytes)):
        formatted = False
    else:
        return None
    start, end = src.span(node)
    m = _OPEN.match(src.raw, start, end)
    if not m or not src.bare(start, end):
        return None
    quote = m[1]
    if isinstance(node, ast.JoinedStr):
        depth, whole = 0, src.text(start, end)
        try:
            for n, t in enumerate(tokenize.generate_tokens(io.StringIO(f"({whole})").readline)):
                if n == 0 or t.type in (tokenize.NL, tokenize.COMMENT):
                    continue
                if tokenize.tok_name[t.type] == "FSTRING_START":
                    depth += 1
                elif tokenize.tok_name[t.type] == "FSTRING_END":
                    depth -= 1
                    continue
                if depth == 0:
                    if t.string != ")":
                        return None  # another literal follows
                    break
        except (tokenize.TokenError, SyntaxError):
            return None
    else:
        at = m.end()
        while (at := src.raw.find(quote, at)) >= 0:
            run = len(src.raw[m.end() : at]) - len(src.raw[m.end() : at].rstrip(b"\\"))
            if run % 2 == 0:
                break
            at += 1
        if at < 0 or at + len(quote) != end:
            return None  # adjacent literals
    return {"span_start": start, "span_end": end, "content_start": m.end(), "content_end": max(m.end(), end - len(quote)), "has_interpolation": formatted}


def _key(src: Source, node: ast.AST) -> str | None:
    if isinstance(node, (ast.Name, ast.Attribute)):
        return "".join(src.text(*src.span(node)).split())
    found = _literal(src, node)
    return src.text(found["content_start"], found["content_end"]) if found else None


def _pairs(node: ast.AST):
    """(name node or name, value node, source) that a node binds."""
    if isinstance(node, ast.Assign):
        target, value = node.targets[-1], node.value
        if isinstance(target, ast.Tuple) and isinstance(value, ast.Tuple):
            if len(target.elts) == len(value.elts):
                yield from ((t, v, "assignment") for t, v in zip(target.elts, value.elts))
        else:
            yield target, value, "assignment"
    elif isinstance(node, ast.AnnAssign) and node.value:
        yield node.target, node.value, "assignment"
    elif isinstance(node, ast.Dict):
        yield from ((k, v, "dict_entry") for k, v in zip(node.keys, node.values) if k)
    elif isinstance(node, ast.DictComp):
        yield node.key, node.value, "dict_entry"
    elif isinstance(node, (ast.Call, ast.ClassDef)):
        yield from ((k.arg, k.value, "keyword_argument") for k in node.keywords if k.arg)
    elif isinstance(node, ast.NamedExpr):
        yield node.target, node.value, "walrus"
    elif isinstance(node, ast.arguments):
        plain = node.posonlyargs + node.args
        yield from ((a.arg, d, "parameter_default") for a, d in zip(plain[len(plain) - len(node.defaults) :], node.defaults))
        yield from ((a.arg, d, "parameter_default") for a, d in zip(node.kwonlyargs, node.kw_defaults) if d)


def _function(src: Source, node) -> dict:
    start = src.span(node)[0]
    a = node.args
    after = max([src.span(t)[1] for t in getattr(node, "type_params", [])], default=start)
    opens = src.raw.index(b"(", src.raw.index(node.name.encode(), start) if after == start else after)
    plain, params, at = a.posonlyargs + a.args, [], opens + 1
    defaults = dict(zip(map(id, plain[len(plain) - len(a.defaults) :]), a.defaults)) | {id(x): d for x, d in zip(a.kwonlyargs, a.kw_defaults) if d}

    def add(kind: str, arg=None, mark: bytes = b"") -> None:
        nonlocal at
        if arg is None:
            begin = src.raw.index(mark, at)
            end = begin + 1
        else:
            begin, end = src.span(arg)
            if kind != "normal":
                begin = src.raw.rindex(b"*" if kind == "star" else b"**", at, begin)
            if d := defaults.get(id(arg)):
                low, high = src.span(d)
                for _ in range(src.raw[end:low].count(b"(")):
                    high = src.raw.index(b")", high) + 1
                end = high
        params.append({"name": arg.arg if arg else "", "kind": kind, "has_default": id(arg) in defaults, "span_start": begin, "span_end": end})
        at = end

    for n, x in enumerate(plain):
        add("normal", x)
        if n + 1 == len(a.posonlyargs):
            add("marker", mark=b"/")
    if a.vararg:
        add("star", a.vararg)
    elif a.kwonlyargs:
        add("marker", mark=b"*")
    for x in a.kwonlyargs:
        add("normal", x)
    if a.kwarg:
        add("double_star", a.kwarg)
    closes = re.compile(rb"(?:[\s,\\]|#[^\n]*)*\)").match(src.raw, at)
    decorators = []
    for d in node.decorator_list:
        d = d.func if isinstance(d, ast.Call) else d
        decorators.append("".join(src.text(*src.span(d)).split()))
    return {"name": node.name, "line": src.line(start), "start": start, "paren_open": opens, "paren_close": closes.end() - 1 if closes else at, "params": params, "decorators": decorators}


def _imports(src: Source, body: list[ast.stmt]) -> dict:
    modules: list[str] = []
    binds_os, first, prelude_end, opening, docstring = False, None, 0, True, False
    stop = len(src.raw)
    for node in body:
        future = isinstance(node, ast.ImportFrom) and node.module == "__future__"
        names = []
        if isinstance(node, ast.Import):
            names = [n.name for n in node.names]
            binds_os |= any(not n.asname and n.name.split(".")[0] == "os" for n in node.names)
        elif isinstance(node, ast.ImportFrom) and not node.level:
            names = [node.module]
        modules += [m for m in dict.fromkeys(n.split(".")[0] for n in names) if m not in modules]
        if isinstance(node, (ast.Import, ast.ImportFrom)) and not future and first is None:
            first = src.span(node)[0]
        if opening:
            doc = not docstring and isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, (str, bytes))
            if future or doc:
                docstring |= doc
                prelude_end = src.line(src.span(node)[1])
            else:
                opening = False
                stop = src.at(min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]), 0)
    # comments between the prelude and the first other statement belong to it
    for n in range(prelude_end, len(src.starts)):
        if src.starts[n] >= stop:
            break
        if src.line_text(n + 1).lstrip().startswith("#"):
            prelude_end = n + 1
    after = src.starts[prelude_end] if prelude_end < len(src.starts) else len(src.raw)
    return {"modules": modules, "binds_os": binds_os, "first_import": first, "after_prelude": after}


def hopeless(text: str) -> bool | None:
    """Whether lines can't parse, whatever lines follow, told without parsing; None if a string, a comment or a backslash stands first, which may hide anything."""
    m = _NEVER.search(text)
    return None if _MAY_HIDE.search(text, 0, m.start() if m else len(text)) else m is not None


def parsed(text: str) -> ast.Module | None:
    """The tree of a text, which is taken as it is (no byte order mark, no coding declaration); None if it doesn't parse."""
    try:
        return ast.parse(text.removeprefix("\ufeff"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def recovered(text: str) -> ast.Module | None:
    """The statements of a broken text that parse, at their places.

    Statements are told apart by their indentation; one that doesn't parse, alone or with the next few, is blanked, or, if it has a body of
    its own and its head is good, what doesn't parse of that.
    """
    lines = re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z", text.removeprefix("\ufeff"))
    indent = lambda s: len(s) - len(s.lstrip(" \t"))
    idle = lambda s: not s.strip() or s.lstrip().startswith("#")
    tells = [hopeless(s) for s in lines]

    def good(lo: int, hi: int) -> bool | None:
        """Whether lines parse; None if they can't, whatever lines follow."""
        body = "".join(lines[lo:hi])
        within = body[:1] in " \t"
        try:
            ast.parse(f"if 1:\n{body}" if within else body.removeprefix("\ufeff"))
        except SyntaxError as e:
            # this one is at the last token that was read: no rule takes what is read so far
            if e.msg == "invalid syntax" and e.lineno and e.offset and (lo <= (n := lo + e.lineno - 1 - within) < hi) and (n < hi - 1 or e.offset < len(lines[n].rstrip())):
                return None
            return False
        except (ValueError, RecursionError, MemoryError):
            return False
        return True

    def blank(lo: int, hi: int) -> None:
        for n in range(lo, hi):
            s = lines[n].rstrip("\r\n")
            lines[n] = " " * len(s.encode("utf-8", "surrogatepass")) + lines[n][len(s) :]
            tells[n] = False

    def whole(n: int, begins: list[int], ends: list[int]) -> int | None:
        """The last of the fewest statements from one on that parse as one."""
        hides = False
        for m in range(n, min(n + _JOINED, len(ends))):
            for told in tells[ends[m - 1] if m > n else begins[n] : ends[m]] if not hides else ():
                if told:
                    return None
                hides |= told is None
                if hides:
                    break
            parses = good(begins[n], ends[m])
            if parses or parses is None:
                return m if parses else None
        return None

    def keep(lo: int, hi: int, depth: int) -> None:
        begins, decorated = [], False
        for n in range(lo, hi):
            if not idle(lines[n]) and indent(lines[n]) <= depth and not _GOES_ON.match(lines[n].lstrip()):
                if not decorated:
                    begins.append(n)
                decorated = lines[n].lstrip().startswith("@")
        ends, n = [*begins[1:], hi], 0
        if begins and depth == 0 and all(tells[a] for a in begins):  # as in prose
            blank(begins[0], hi)
            return
        while n < len(begins):
            a = begins[n]
            last = whole(n, begins, ends)
            if last is not None:
                n = last + 1
                continue
            z = ends[n]
            n += 1
            inner = next((m for m in range(a + 1, z) if not idle(lines[m]) and indent(lines[m]) > depth), None)
            head = "".join(s[depth:] for s in lines[a:inner]) + " " * (indent(lines[inner]) - depth) + "pass\n" if inner else "?"
            if not hopeless(head) and parsed(head):
                deeper = indent(lines[inner])
                keep(inner, z, deeper)
                if not good(a, z):  # nothing may be left of the body
                    empty = next((m for m in range(inner, z) if not lines[m].strip() and len(lines[m].rstrip("\r\n")) >= deeper + 4), None)
                    if empty is not None:
                        lines[empty] = " " * deeper + "pass" + lines[empty][deeper + 4 :]
                if good(a, z):
                    continue
            blank(a, z)

    keep(0, len(lines), 0)
    left = "".join(lines)
    return parsed(left) if left.strip(" \t\r\n") else ast.Module([], [])


_NOTHING = {"has_error": True, "functions": [], "bindings": [], "modules": [], "binds_os": False, "first_import": None, "after_prelude": 0}


def analyze(text: str) -> dict:
    """functions (by start), bindings (by literal), modules, binds_os, first_import, after_prelude and has_error."""
    try:
        tree = None if hopeless(text) else parsed(text)
        whole = tree is not None
        if not whole:
            tree = recovered(text)
        return _NOTHING if tree is None else _analyzed(Source(text), tree) | {"has_error": not whole}
    except Exception:  # of one file of many; whatever is wrong with it, it's reported as an error
        return _NOTHING


def _analyzed(src: Source, tree: ast.Module) -> dict:
    functions, bindings = [], []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            functions.append(_function(src, node))
        for name, value, source in _pairs(node):
            found = _literal(src, value)
            key = (name if isinstance(name, str) else _key(src, name)) if found else None
            if found and key is not None:
                line = src.line(found["span_start"])
                bindings.append({"key": key, "raw_value": src.text(found.pop("content_start"), found.pop("content_end")), "line": line, "line_text": src.line_text(line), "source": source, **found})
    functions.sort(key=lambda f: f["start"])
    bindings.sort(key=lambda b: b["span_start"])
    return {"functions": functions, "bindings": bindings, **_imports(src, tree.body)}
