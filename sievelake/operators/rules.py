"""The rules, as expressions over an analysed row: no rule joins, shuffles or leaves the JVM.

Every file is a row, so first hits per line and suppression by earlier findings are array operations inside it.
A value pattern that could match a line feed can't be tested line by line; such patterns are matched over
the whole text by a batched UDF, and only if a contract has any.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import Contract, compiled, portable
from ..functions.text import ascii_lower, fingerprint, redact, render_param, trimmed, truncate
from ..functions.wildcards import any_of
from ..profiles import PROFILES
from ..schemas import HIT
from . import scope

KV001, KV002, KV003 = "KV001", "KV002", "KV003"
_FINDING = "struct<line: int, code: string, ord: int, severity: string, symbol: string, subject: string, message: string, detail: string, framework: string, kind: string, function: string, parameter: string, detector: string, key: string>"


def _text(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _finding(line: Column, code: str, severity, symbol: Column, subject, message: Column, detail: Column, framework: Column, kind: str, **own) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    fields = {"line": line, "code": F.lit(code), "ord": F.lit(0), "severity": as_column(severity), "symbol": symbol, "subject": as_column(subject), "message": message, "detail": detail, "framework": framework, "kind": F.lit(kind)}
    fields |= {n: as_column(own.get(n)).cast("string") for n in ("function", "parameter", "detector", "key")}
    return F.struct(*(c.alias(n) for n, c in fields.items())).cast(_FINDING)


def _none() -> Column:
    return F.array().cast(f"array<{_FINDING}>")


def _key_match(key: Column, patterns, of_profile, active: Column) -> tuple[Column, Column]:
    """Whether a key matches, and the profile that says so (null if the contract does)."""
    low = ascii_lower(key)
    own = any_of(low, [p.lower() for p in patterns])
    by = scope.first_active(active, lambda p: any_of(low, of_profile(p)) if of_profile(p) else None)
    return own | by.isNotNull(), F.when(~own, by)


def _passes(b: Column, section) -> Column:
    """Long enough, not allowed, not computed, not marked."""
    out = (F.char_length(b["raw_value"]) >= section.min_value_length) & ~b["has_interpolation"]
    if section.ignore_marker:
        out &= ~b["line_text"].contains(section.ignore_marker)
    return out & ~ascii_lower(trimmed(b["raw_value"])).isin(*(v.lower() for v in section.allow_values)) if section.allow_values else out


def is_secret(contract: Contract, b: Column, active: Column) -> Column:
    if not contract.secrets.enabled:
        return F.lit(False)
    return _passes(b, contract.secrets) & _key_match(b["key"], contract.secrets.key_patterns, lambda p: p.secret_keys, active)[0]


def is_infra(contract: Contract, b: Column, active: Column) -> Column:
    section = contract.infrastructure
    return _passes(b, section) & _key_match(b["key"], section.key_patterns, lambda p: p.infra_keys, active)[0] & ~is_secret(contract, b, active)


def may_cross_lines(regex: str) -> bool:
    """Whether a pattern could match a line feed, or tell a line's ends from the text's; told by Python's parser of patterns."""
    import re._constants as k
    import re._parser as parser

    def has(node, flags: int) -> bool:
        op, av = node
        if op is k.LITERAL:
            return av == 10
        if op is k.NOT_LITERAL:
            return av != 10
        if op is k.ANY:
            return bool(flags & re.DOTALL)
        if op is k.AT:
            return av in (k.AT_BEGINNING_STRING, k.AT_END_STRING) or av in (k.AT_BEGINNING, k.AT_END) and not flags & re.MULTILINE
        if op is k.IN:
            negated = av and av[0][0] is k.NEGATE
            holds = False
            for o, v in av:
                holds |= o is k.LITERAL and v == 10 or o is k.RANGE and v[0] <= 10 <= v[1] or o is k.CATEGORY and v in (k.CATEGORY_SPACE, k.CATEGORY_NOT_DIGIT, k.CATEGORY_NOT_WORD)
            return holds != bool(negated)
        if op is k.CATEGORY:
            return av in (k.CATEGORY_SPACE, k.CATEGORY_NOT_DIGIT, k.CATEGORY_NOT_WORD)
        if op is k.SUBPATTERN:
            flags = flags & ~av[2] | av[1]
        parts = av if isinstance(av, (list, tuple)) else [av]
        for p in parts:
            for q in p if isinstance(p, list) else [p]:
                if isinstance(q, parser.SubPattern) and any(has(n, flags) for n in q):
                    return True
                if isinstance(q, tuple) and len(q) == 2 and type(q[0]) is type(op) and has(q, flags):
                    return True
        return False

    try:
        tree = parser.parse(portable(regex))
    except re.error:
        return True  # a pattern for another module, which gets the whole text
    return any(has(n, tree.state.flags) for n in tree)


def needed(regex: str) -> str:
    """The longest run of plain characters that every match of a pattern holds; empty if none is certain."""
    import re._constants as k
    import re._parser as parser

    runs = [""]

    def walk(nodes) -> None:
        for op, av in nodes:
            if op is k.LITERAL and 32 <= av < 127:
                runs[-1] += chr(av)
            elif op is k.SUBPATTERN and not av[1] and not av[2]:
                walk(av[3])
            elif op is not k.AT:
                runs.append("")

    try:
        tree = parser.parse(portable(regex))
    except re.error:
        return ""
    if not tree.state.flags & (re.IGNORECASE | re.VERBOSE):
        walk(tree)
    return max(runs, key=len)


def _patterns(section, of_profile) -> list[tuple[str | None, str, str]]:
    """(framework, name, pattern) in order: the contract's, then each profile's."""
    return [(None, p.name, p.regex) for p in section.value_patterns] + [(p.name, n, r) for p in PROFILES for n, r in of_profile(p)]


def java(regex: str) -> str:
    """A pattern for Java: only line feeds end lines, and classes and boundaries are those of Unicode; without any, the plain pattern is faster."""
    return f"(?dU){regex}" if re.search(r"\\[bBdDpPsSwW]", regex) else f"(?d){regex}"


def value_hits(content: Column, active: Column, patterns, marker: str) -> Column:
    """Hits of value patterns, by pattern and line: the first on each line that isn't marked."""
    if not patterns:
        return F.array().cast(f"array<{HIT}>")
    if any(may_cross_lines(r) for _, _, r in patterns):
        return _whole_text_hits(patterns, marker)(content, active)
    lines = F.split(content, "\n")

    def on_line(line: Column, i: Column) -> Column:
        cases = []
        for framework, name, regex in patterns:
            hit = line.rlike(java(regex)) if framework is None else F.array_contains(active, framework) & line.rlike(java(regex))
            value = F.struct(F.lit(name).alias("detector"), F.lit(framework).cast("string").alias("framework"), (i + 1).cast("int").alias("line"), F.regexp_extract(line, java(regex), 0).alias("found"), line.alias("line_text"))
            cases.append(F.when(hit, value))
        first = F.coalesce(*cases)
        return F.when(~line.contains(marker), first) if marker else first

    # most texts hold nothing at all: testing them whole spares splitting those, and looking for what a match must hold spares most patterns
    some = F.lit(False)
    for framework, _, regex in patterns:
        hit = content.rlike(java(regex))
        if part := needed(regex):
            hit = content.contains(part) & hit
        some |= hit if framework is None else F.array_contains(active, framework) & hit
    found = F.filter(F.transform(lines, on_line), lambda h: h.isNotNull())
    return F.when(some, found).otherwise(F.array().cast(f"array<{HIT}>"))


def _whole_text_hits(patterns, marker: str):
    @F.arrow_udf(f"array<{HIT}>")
    def find(content: pa.Array, active: pa.Array) -> pa.Array:
        patterns_, out = [(f, n, compiled(r)) for f, n, r in patterns], []
        for text, on in zip(content.to_pylist(), active.to_pylist()):
            seen: dict[int, dict] = {}
            for framework, name, regex in patterns_ if text else ():
                if framework and framework not in (on or ()):
                    continue
                for m in regex.finditer(text):
                    line = text.count("\n", 0, m.start()) + 1
                    end = text.find("\n", m.start())
                    whole = text[text.rfind("\n", 0, m.start()) + 1 : end if end >= 0 else len(text)]
                    if line not in seen and not (marker and marker in whole):
                        seen[line] = {"detector": name, "framework": framework, "line": line, "found": m[0], "line_text": whole}
            out.append([seen[k] for k in sorted(seen)])
        kind = pa.struct([("detector", pa.string()), ("framework", pa.string()), ("line", pa.int32()), ("found", pa.string()), ("line_text", pa.string())])
        return pa.array(out, pa.list_(kind))

    return find


def missing_parameters(contract: Contract) -> Column:
    """KV001: parameters that governed functions lack."""
    wanted = [(p.name, p.annotation, p.default, p.severity) for p in contract.parameters]
    if not wanted:
        return _none()
    required = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(a).cast("string").alias("annotation"), F.lit(d).cast("string").alias("default"), F.lit(s).alias("severity")) for n, a, d, s in wanted))

    def of(f: Column) -> Column:
        lacks = F.filter(required, lambda r: ~F.exists(f["params"], lambda p: (p["kind"] != "marker") & (p["name"] == r["name"])))
        return F.transform(lacks, lambda r: _finding(f["line"], KV001, r["severity"], f["name"], r["name"], _text("`", f["name"], "` lacks the contract's parameter `", r["name"], "`"), _text("declare `", render_param(r["name"], r["annotation"], r["default"]), "`"), f["governed_by"], "missing_parameter", function=f["name"], parameter=r["name"]))

    return F.flatten(F.transform(F.filter("functions", lambda f: f["decision"].isin(scope.GOVERNED, scope.REPORT_ONLY)), of))


def _bound(section, code: str, severity: str, flagged: Column, of_profile, message, detail, kind: str) -> Column:
    active = F.col("active")
    return F.transform(flagged, lambda b: _finding(b["line"], code, severity, b["key"], "key_pattern", message(b), detail(b), _key_match(b["key"], section.key_patterns, of_profile, active)[1], kind, detector="key_pattern", key=b["key"]))


def _by_value(section, code: str, severity: str, taken: Column, of_profile, message, detail, kind: str) -> Column:
    hits = F.filter(value_hits(F.col("content"), F.col("active"), _patterns(section, of_profile), section.ignore_marker), lambda h: ~F.array_contains(taken, h["line"]))
    return F.transform(hits, lambda h: _finding(h["line"], code, severity, F.lit(""), h["detector"], message(h), detail(h), h["framework"], kind, detector=h["detector"]))


def _lines(findings: Column) -> Column:
    return F.transform(findings, lambda f: f["line"])


@lru_cache(32)
def _columns(contract: Contract, application: str) -> tuple[Column, Column, dict[str, Column]]:
    """The active profiles, the classified functions and each rule; building them takes longer than planning, so they are kept."""
    active, secrets, infra = F.col("active"), contract.secrets, contract.infrastructure
    functions = F.transform("functions", lambda f: f.withField("decision", scope.decision(contract, active, f)).withField("governed_by", scope.governing(active, f)).withField("no_auto_fix", scope.no_auto_fix(active, f)))
    text = (F.col("kind") == "python") & F.col("content").isNotNull()
    out = {"f1": missing_parameters(contract)} | {f"f{n}": _none() for n in range(2, 6)} | {"f6": _yaml(contract)}
    if secrets.enabled:
        flagged = F.filter("bindings", lambda b: is_secret(contract, b, active))
        out["f2"] = _bound(secrets, KV002, "error", flagged, lambda p: p.secret_keys, lambda b: _text("`", b["key"], "` is given a hardcoded literal"), lambda b: _text("value ", redact(b["raw_value"]), "; take it from the environment or a secret store"), "hardcoded_secret")
        values = _by_value(secrets, KV002, "error", _lines(F.col("f2")), lambda p: p.secret_values, lambda h: _text("a credential is written here (", h["detector"], ")"), lambda h: _text("found ", redact(h["found"])), "hardcoded_secret")
        out["f3"] = F.when(text, values).otherwise(_none())
    if infra.enabled:
        flagged = F.filter("bindings", lambda b: is_infra(contract, b, active))
        out["f4"] = _bound(infra, KV003, infra.severity, flagged, lambda p: p.infra_keys, lambda b: _text("`", b["key"], "` is pinned to `", truncate(b["raw_value"]), "`"), lambda b: F.lit("derive it from target_environment"), "hardcoded_infrastructure")
        taken = _lines(F.concat("f1", "f2", "f3", "f4"))
        values = _by_value(infra, KV003, infra.severity, taken, lambda p: p.infra_values, lambda h: _text("an identifier of one environment (", h["detector"], ")"), lambda h: _text("`", truncate(h["found"]), "` should vary by environment"), "hardcoded_infrastructure")
        out["f5"] = F.when(text, values).otherwise(_none())
    every = F.transform(F.concat(*sorted(out)), lambda f, i: f.withField("ord", i))
    return scope.active_profiles(contract), functions, out | {"findings": F.sort_array(every)}


def _kept(rows: DataFrame, contract: Contract):
    return _columns(contract, rows.sparkSession.sparkContext.applicationId)


def analysed(parsed: DataFrame, contract: Contract) -> DataFrame:
    """Parsed sources with their active profiles and, in each function, its decision and governing framework."""
    active, functions, _ = _kept(parsed, contract)
    return parsed.withColumn("active", active).withColumn("functions", functions)


def audited(parsed: DataFrame, contract: Contract) -> DataFrame:
    """Analysed rows with all their findings, sorted by line, code and rule, in one array."""
    rows, found = analysed(parsed, contract), _kept(parsed, contract)[2]
    for names in (("f1", "f2", "f4", "f6"), ("f3",), ("f5",), ("findings",)):
        rows = rows.withColumns({n: found[n] for n in names})
    return rows.drop("f1", "f2", "f3", "f4", "f5", "f6")


def templated(value: Column) -> Column:
    v = trimmed(value)
    return v.contains("{{") | v.contains("${") | v.rlike("^(?:[!*&]|<<)")


def _yaml(contract: Contract) -> Column:
    """KV002 of YAML scalars: keys only, never infrastructure."""
    s, active = contract.secrets, F.col("active")
    if not s.enabled:
        return _none()

    def holds(x: Column) -> Column:
        out = ~templated(x["value"]) & (x["value"] != "") & (F.char_length(x["value"]) >= s.min_value_length)
        if s.allow_values:
            out &= ~ascii_lower(trimmed(x["value"])).isin(*(v.lower() for v in s.allow_values))
        if s.ignore_marker:
            out &= ~x["raw"].contains(s.ignore_marker)
        return out & _key_match(x["key"], s.key_patterns, lambda p: p.secret_keys, active)[0]

    return F.transform(F.filter("scalars", holds), lambda x: _finding(x["line"], KV002, "error", x["key"], "key_pattern", _text("`", x["key"], "` holds a credential in plain text"), _text("value ", redact(x["value"]), "; use `{{ env_var('...') }}` or a secret store"), _key_match(x["key"], s.key_patterns, lambda p: p.secret_keys, active)[1], "hardcoded_secret", detector="key_pattern", key=x["key"]))


def findings(rows: DataFrame) -> DataFrame:
    """One row for each finding of audited rows."""
    # an outer explode: for an inner one the optimizer tests the array first, by computing all rules once more
    flat = rows.select("path", F.explode_outer("findings").alias("f")).where("f is not null").select("path", "f.*")
    return flat.select(fingerprint(F.col("path"), F.col("code"), F.col("symbol"), F.col("subject")).alias("fingerprint"), "path", "line", "code", "severity", "symbol", "subject", "message", "detail", "framework", "kind", "function", "parameter", "detector", "key", "ord")


def skipped(rows: DataFrame) -> DataFrame:
    """(path, reason, severity, detail) of sources that couldn't be read or parsed."""
    reason = F.when(F.col("content").isNull(), "unreadable").when(F.col("has_error"), "syntax_error")
    severity = F.when(reason == "unreadable", "error").otherwise("warning")
    detail = F.when(reason == "unreadable", F.coalesce("read_error", F.lit("there is no content"))).otherwise("only what parses was audited; findings may be hidden")
    return rows.select("path", reason.alias("reason"), severity.alias("severity"), detail.alias("detail")).where("reason is not null")
