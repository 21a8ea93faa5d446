"""A line scanner for the ``key: value`` scalars of YAML; no YAML parser, so broken or templated files work too."""

from __future__ import annotations

import re

_BLOCK = re.compile(r"[|>][0-9+-]*\Z")
_SPACE = " \t\n\r\x0b\x0c"


def _plain(line: str, stop) -> int | None:
    """Where, outside quotes, a place first satisfies stop(place)."""
    quote = None
    for i, c in enumerate(line):
        if quote:
            quote = None if c == quote else quote
        elif c in "\"'":
            quote = c
        elif stop(i):
            return i
    return None


def uncommented(line: str) -> str:
    at = _plain(line, lambda i: line[i] == "#" and (i == 0 or line[i - 1] in _SPACE))
    return line if at is None else line[:at]


def unquoted(value: str) -> str:
    v = value.strip()
    return v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v


def scalars(text: str) -> list[dict]:
    """key, value, line and raw line of each scalar, in order."""
    out, block = [], None
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    for number, raw in enumerate(lines, 1):
        raw = raw[:-1] if raw.endswith("\r") else raw
        indent = len(raw.encode()) - len(raw.lstrip().encode())
        if block is not None:
            if not raw.strip() or indent > block:
                continue
            block = None
        rest = uncommented(raw).lstrip()
        while rest == "-" or rest.startswith("- "):
            rest = rest[1:].lstrip()
        if not rest or rest.startswith("#"):
            continue
        at = _plain(rest, lambda i: rest[i] == ":" and (i + 1 == len(rest) or rest[i + 1] in _SPACE))
        if at is None:
            continue
        key, value = unquoted(rest[:at]), rest[at + 1 :]
        if not key or re.search(r"\s", key):
            continue
        if _BLOCK.match(value.strip()):
            block = indent
        elif value.strip():
            out.append({"key": key, "value": unquoted(value), "line": number, "raw": raw})
    return out
