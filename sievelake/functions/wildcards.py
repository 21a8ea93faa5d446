"""Wildcards as Spark expressions: * and ** match any run, ? one character, all of the text must match."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def wildcard(text: Column, pattern: str) -> Column:
    """Whether the pattern matches; compiled to the cheapest expression that decides it."""
    p = re.sub(r"\*+", "*", pattern)
    body = p.strip("*")
    if p == "*":
        return text.isNotNull()
    if "*" not in body and "?" not in p:
        if p.startswith("*") and p.endswith("*"):
            return text.contains(body)
        if p.startswith("*"):
            return text.endswith(body)
        if p.endswith("*"):
            return text.startswith(body)
        return text == F.lit(p)
    return text.like(re.sub(r"([\\%_])", r"\\\1", p).replace("*", "%").replace("?", "_"))


def any_of(text: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, (wildcard(text, p) for p in patterns), F.lit(False))


def path_match(path: Column, pattern: str) -> Column:
    """A wildcard over paths, in which leading ``**/`` may also match nothing; * crosses folders."""
    out = wildcard(path, pattern)
    return out | path_match(path, pattern[3:]) if pattern.startswith("**/") else out


def matches(text: str, pattern: str) -> bool:
    """The same on the driver."""
    return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern), text, re.S) is not None


def matches_path(path: str, pattern: str) -> bool:
    return matches(path, pattern) or pattern.startswith("**/") and matches_path(path, pattern[3:])
