"""Rewrites: what to change is decided by the same expressions that audits use; splicing bytes is Python, a file at a time.

A rewritten source is parsed again. If it doesn't parse, nothing of it is kept and the file is left to a person.
Pinned infrastructure is never rewritten, and neither is anything but Python.
"""

from __future__ import annotations

import os
import shutil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..contract import Contract
from ..functions.text import env_var_name, render_param
from . import rules, scope
from .parse_python import parsed as parsed_python

FIXED = "path string, changed boolean, new_source string, params_added array<struct<function: string, parameter: string>>, secrets_externalized array<struct<key: string, env: string>>, manual array<struct<line: int, reason: string>>"


def _indent(raw: bytes, at: int) -> str:
    line = raw[raw.rfind(b"\n", 0, at) + 1 :]
    return line[: len(line) - len(line.lstrip(b" \t"))].decode()


def insertion(raw: bytes, f: dict, rendered: list[str]) -> tuple[int, int, str]:
    """Where parameters go: before **kwargs, else after the last, in the signature's layout."""
    tall = b"\n" in raw[f["paren_open"] : f["paren_close"] + 1]
    joined = ", ".join(rendered)
    rest = next((p for p in f["params"] if p["kind"] == "double_star"), None)
    if rest:
        at = rest["span_start"]
        begins_line = not raw[raw.rfind(b"\n", 0, at) + 1 : at].strip()
        return at, at, "".join(f"{r},\n{_indent(raw, at)}" for r in rendered) if tall and begins_line else f"{joined}, "
    if not f["params"]:
        return f["paren_open"] + 1, f["paren_open"] + 1, joined
    last = f["params"][-1]
    if tall:
        return last["span_end"], last["span_end"], "".join(f",\n{_indent(raw, last['span_start'])}{r}" for r in rendered)
    return last["span_end"], last["span_end"], f", {joined}"


def fix_source(row: dict) -> dict:
    """A row of the plan to its result."""
    out = {"path": row["path"], "changed": False, "new_source": None, "params_added": [], "secrets_externalized": [], "manual": []}
    say = lambda line, reason: out["manual"].append({"line": line, "reason": reason})
    if row["content"] is None:
        say(None, "the file can't be read")
    elif row["kind"] != "python":
        if row["flagged"]:
            say(None, "only Python is rewritten")
    elif row["has_error"]:
        say(None, "the file has syntax errors and isn't rewritten")
    if out["manual"] or row["content"] is None or row["kind"] != "python":
        return out
    raw, edits = row["content"].encode("utf-8", "surrogatepass"), []
    for f in row["lacking"] or ():
        if f["no_auto_fix"]:
            say(f["line"], f"`{f['name']}` is governed through {f['no_auto_fix']}, but your own code calls it: add the parameter and pass it on by hand")
            continue
        starred = any(p["kind"] in ("star", "marker") for p in f["params"])
        defaults = any(p["has_default"] for p in f["params"])
        add = []
        for p in sorted(f["missing"], key=lambda p: not p["required"]):
            if p["required"] and defaults and not starred:
                say(f["line"], f"`{f['name']}` needs `{p['name']}`, which can't follow parameters with defaults: add it by hand")
            else:
                add.append(p)
        if add:
            edits.append(insertion(raw, f, [p["rendered"] for p in add]))
            out["params_added"] += [{"function": f["name"], "parameter": p["name"]} for p in add]
    for b in row["flagged"] or ():
        if b["source"] == "parameter_default":
            say(b["line"], f"`{b['key']}` has a hardcoded default: look it up in the body, when the function is called")
            continue
        edits.append((b["span_start"], b["span_end"], f'os.environ["{b["env"]}"]'))
        out["secrets_externalized"].append({"key": b["key"], "env": b["env"]})
    for line in row["loose"] or ():
        say(line, "a credential is written here without a name: remove it by hand")
    if not edits:
        return out
    if out["secrets_externalized"] and not row["binds_os"]:
        at = row["after_prelude"] if row["first_import"] is None else max(row["first_import"], row["after_prelude"])
        before = b"" if at == 0 or raw[at - 1 : at] == b"\n" else b"\n"
        edits.append((at, at, f"{before.decode()}import os\n"))
    new, last = raw, len(raw) + 1
    for start, end, text in sorted(edits, key=lambda e: (-e[0], -e[1])):
        if end > last:
            say(None, "edits overlap and weren't all made")
            continue
        new, last = new[:start] + text.encode() + new[end:], start
    if parsed_python(new.decode("utf-8", "surrogatepass")) is None:
        say(None, "the rewritten file wouldn't parse; change it by hand")
        return out | {"params_added": [], "secrets_externalized": []}
    return out | {"changed": True, "new_source": new.decode("utf-8", "surrogatepass")}


def fixed(parsed: DataFrame, contract: Contract) -> DataFrame:
    """Schema FIXED: a row for each source that needs a change or a person. Narrow: no shuffle."""
    rows = rules.audited(parsed, contract)
    active = F.col("active")
    required = F.array(*(F.struct(F.lit(p.name).alias("name"), render_param(F.lit(p.name), F.lit(p.annotation).cast("string"), F.lit(p.default).cast("string")).alias("rendered"), F.lit(p.default is None).alias("required")) for p in contract.parameters))

    def lack(f):
        return F.filter(required, lambda r: ~F.exists(f["params"], lambda p: (p["kind"] != "marker") & (p["name"] == r["name"])))

    none = F.array()
    lacking = F.transform(F.filter("functions", lambda f: f["decision"].isin(scope.GOVERNED, scope.REPORT_ONLY)), lambda f: F.struct(f["name"].alias("name"), f["line"].alias("line"), f["paren_open"].alias("paren_open"), f["paren_close"].alias("paren_close"), f["params"].alias("params"), f["no_auto_fix"].alias("no_auto_fix"), lack(f).alias("missing")))
    flagged = F.transform(F.filter("bindings", lambda b: rules.is_secret(contract, b, active)), lambda b: F.struct(b["key"].alias("key"), b["line"].alias("line"), b["source"].alias("source"), b["span_start"].alias("span_start"), b["span_end"].alias("span_end"), env_var_name(b["key"], contract.fix.env_var_prefix).alias("env")))
    loose = F.transform(F.filter("findings", lambda f: (f["kind"] == "hardcoded_secret") & f["key"].isNull()), lambda f: f["line"])
    plan = rows.select("path", "kind", "content", "has_error", "binds_os", "first_import", "after_prelude", (F.filter(lacking, lambda f: F.size(f["missing"]) > 0) if contract.fix.insert_missing_parameters and contract.parameters else none.cast("array<string>")).alias("lacking"), (flagged if contract.fix.externalize_secrets else none.cast("array<struct<key: string>>")).alias("flagged"), (loose if contract.fix.externalize_secrets else none.cast("array<int>")).alias("loose"))
    schema = _parse_datatype_string(FIXED)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                done = [fix_source(r) for r in batch.slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_pylist([d for d in done if d["changed"] or d["manual"]], schema=arrow)

    return plan.mapInArrow(run, schema)


def write_back(results: DataFrame, base: str, contract: Contract) -> int:
    """Write changed files under a folder on the driver, with backups; returns how many."""
    n = 0
    for r in results.where("changed").select("path", "new_source").toLocalIterator():
        path = r.path if os.path.isabs(r.path) else os.path.join(base, r.path)
        if contract.fix.backup_suffix:
            shutil.copyfile(path, path + contract.fix.backup_suffix)
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(r.new_source)
        n += 1
    return n
