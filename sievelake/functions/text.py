"""Scalar functions of findings as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def trimmed(c: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fingerprint(path: Column, code: Column, symbol: Column, subject: Column) -> Column:
    """First 16 hex digits of a SHA-256; the line is no part of it, so findings keep their identity as code moves."""
    return F.substring(F.sha2(F.concat_ws("\0", path, code, symbol, subject), 256), 1, 16)


def redact(c: Column) -> Column:
    v = trimmed(c)
    n = F.char_length(v).cast("string")
    return F.when(F.char_length(v) <= 4, F.concat(F.lit("<redacted:"), n, F.lit(" chars>"))).otherwise(F.concat(F.lit('"'), F.substring(v, 1, 2), F.lit('…" (<redacted>, '), n, F.lit(" chars)")))


def truncate(c: Column) -> Column:
    v = trimmed(c)
    return F.when(F.char_length(v) > 48, F.concat(F.substring(v, 1, 45), F.lit("..."))).otherwise(v)


def render_param(name: Column, annotation: Column, default: Column) -> Column:
    equals = F.when(annotation.isNull(), "=").otherwise(" = ")
    return F.concat(name, F.coalesce(F.concat(F.lit(": "), annotation), F.lit("")), F.coalesce(F.concat(equals, default), F.lit("")))


def env_var_name(key: Column, prefix: str = "") -> Column:
    core = F.regexp_replace(F.upper(F.regexp_replace(key, "[^0-9A-Za-z]", "_")), "^_+|_+$", "")
    return F.concat(F.lit(prefix), F.when(core == "", "SECRET").otherwise(core))


def last_segment(dotted: Column) -> Column:
    return F.substring_index(dotted, ".", -1)


def root_module(dotted: Column) -> Column:
    """First segment of a module; null for relative imports."""
    return F.nullif(F.substring_index(dotted, ".", 1), F.lit(""))


def rfc3339(ts: Column) -> Column:
    """UTC to the second; the session's time zone is taken as UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
