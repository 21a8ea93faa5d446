"""Schemas of the relations that audits read and write."""

from __future__ import annotations

SOURCES = "path string, kind string, content string, read_error string"
PARAM = "struct<name: string, kind: string, has_default: boolean, span_start: int, span_end: int>"
FUNCTION = f"struct<name: string, line: int, start: int, paren_open: int, paren_close: int, params: array<{PARAM}>, decorators: array<string>>"
BINDING = "struct<key: string, raw_value: string, line: int, line_text: string, source: string, has_interpolation: boolean, span_start: int, span_end: int>"
SCALAR = "struct<key: string, value: string, line: int, raw: string>"
HIT = "struct<detector: string, framework: string, line: int, found: string, line_text: string>"
ANALYSIS = f"path string, kind string, content string, read_error string, has_error boolean, functions array<{FUNCTION}>, bindings array<{BINDING}>, modules array<string>, binds_os boolean, first_import int, after_prelude int, scalars array<{SCALAR}>"
