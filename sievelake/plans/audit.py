"""Whole audits: sources to findings, aggregates, a verdict, and the ways to write them down."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType, MapType, StructType

from .. import __version__
from ..contract import Contract
from ..operators import fix as fixes
from ..operators import rules, scope
from ..operators.parse import parse
from ..profiles import PROFILES

SCHEMA_VERSION = 1
_OWN = {"missing_parameter": ("function", "parameter"), "hardcoded_secret": ("detector", "key"), "hardcoded_infrastructure": ("detector", "key")}
_VARIABLES = {
    "repo": ("GITHUB_REPOSITORY", "CI_PROJECT_PATH", "BUILDKITE_REPO"),
    "commit": ("GITHUB_SHA", "CI_COMMIT_SHA", "BUILDKITE_COMMIT"),
    "branch": ("GITHUB_REF_NAME", "CI_COMMIT_REF_NAME", "BUILDKITE_BRANCH"),
}


def identity(flags: Mapping[str, str | None] | None = None, env: Mapping[str, str] | None = None) -> dict:
    """repo, commit and branch, each with where it came from: a flag, else the first variable that isn't blank."""
    env = os.environ if env is None else env
    out: dict = {"identity_source": {}}
    for name, variables in _VARIABLES.items():
        given = [("flag", (flags or {}).get(name)), *((f"env:{v}", env.get(v)) for v in variables)]
        source, value = next(((s, v.strip()) for s, v in given if v and v.strip()), (None, None))
        out[name] = value
        out["identity_source"][name] = source
    return out


def timestamp(seconds: float | None = None) -> str:
    at = datetime.now(timezone.utc) if seconds is None else datetime.fromtimestamp(seconds, timezone.utc)
    return at.strftime("%Y-%m-%dT%H:%M:%SZ")


class Audit:
    """An audit of sources under a contract. Everything is lazy; rows is one row for each source."""

    def __init__(self, sources: DataFrame, contract: Contract | None = None):
        self.contract = contract or Contract()
        self.parsed = parse(sources)
        self.rows = rules.audited(self.parsed, self.contract)

    def findings(self) -> DataFrame:
        return rules.findings(self.rows)

    def ordered_findings(self) -> DataFrame:
        """Findings by path components, line, code and rule."""
        return self.findings().orderBy(F.split("path", "/"), "line", "code", "ord")

    def skipped(self) -> DataFrame:
        return rules.skipped(self.rows)

    def decisions(self) -> DataFrame:
        """(path, function, line, decision, governed_by) of each function."""
        return self.rows.select("path", F.explode_outer("functions").alias("f")).where("f is not null").select("path", F.col("f.name").alias("function"), F.col("f.line").alias("line"), F.col("f.decision").alias("decision"), F.col("f.governed_by").alias("governed_by"))

    def distinct_issues(self) -> DataFrame:
        """Findings counted by their identity."""
        return self.findings().groupBy("fingerprint", "path", "code", "symbol", "subject").agg(F.count("*").alias("occurrences"), F.min("line").alias("first_line"))

    def fixed(self) -> DataFrame:
        return fixes.fixed(self.parsed, self.contract)

    def fix_totals(self) -> DataFrame:
        """One row: files that change, what is added to them and taken out of them, and what is left to a person."""
        size = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long")
        return self.fixed().agg(F.count_if("changed").alias("files_changed"), size("params_added").alias("params_added"), size("secrets_externalized").alias("secrets_externalized"), size("manual").alias("manual"), F.count_if(F.size("manual") > 0).alias("files_manual"))

    def summary(self, strict: bool = False, expected: str | None = None) -> DataFrame:
        """One row of aggregates and the verdict. One partial and one final aggregation, nothing exploded."""
        count = lambda name, test: F.coalesce(F.sum(F.size(F.filter(name, test))), F.lit(0)).cast("long")
        decided = lambda *d: count("functions", lambda f: f["decision"].isin(*d))
        skip = F.col("content").isNull() | F.col("has_error")
        bad = F.col("content").isNull()
        drift = expected is not None and expected != self.contract.fingerprint()
        seen = [F.struct(F.lit(p.name).alias("key"), F.count_if((F.col("kind") == "python") & F.array_contains("active", p.name)).alias("value")) for p in sorted(PROFILES, key=lambda p: p.name)]
        counted = self.rows.agg(
            F.count("*").alias("files_scanned"),
            count("findings", lambda f: f["severity"] == "error").alias("errors"),
            count("findings", lambda f: f["severity"] == "warning").alias("warnings"),
            F.count_if(skip).alias("skipped"),
            F.count_if(bad).alias("unreadable"),
            F.map_from_entries(F.filter(F.array(*seen), lambda e: e["value"] > 0)).alias("frameworks_detected"),
            F.struct(
                F.coalesce(F.sum(F.size("functions")), F.lit(0)).cast("long").alias("functions_total"),
                decided(scope.GOVERNED, scope.REPORT_ONLY).alias("functions_in_scope"),
                decided(scope.REPORT_ONLY).alias("functions_report_only"),
                decided(scope.FRAMEWORK).alias("functions_exempt_framework"),
                decided(scope.USER).alias("functions_exempt_user"),
                decided(scope.OUT).alias("functions_out_of_scope"),
            ).alias("scope"),
        )
        gating = F.col("errors") + F.col("warnings") + F.col("skipped") if strict else F.col("errors") + F.col("unreadable")
        verdict = F.when(F.lit(drift), 3).when(F.col("gating") > 0, 1).otherwise(0)
        return counted.withColumn("gating", gating).withColumn("contract_sha256", F.lit(self.contract.fingerprint())).withColumn("contract_drift", F.lit(drift)).withColumn("verdict", verdict)

    def findings_json(self) -> DataFrame:
        """(path, line, json): each finding as a JSON object, made on the executors."""
        flat = self.findings()
        out = None
        common = [c for c in flat.columns if c not in ("function", "parameter", "detector", "key", "framework", "ord")]
        for kind, own in _OWN.items():
            parts = [F.to_json(F.struct(*common, *own), {"ignoreNullFields": "false"})]
            body = F.when(F.col("framework").isNull(), parts[0]).otherwise(F.to_json(F.struct(*common, "framework", *own), {"ignoreNullFields": "false"}))
            out = F.when(F.col("kind") == kind, body) if out is None else out.when(F.col("kind") == kind, body)
        return flat.select("path", "line", out.alias("json"))

    def payload(self, strict: bool = False, expected: str | None = None, contract_path: str | None = None, flags: Mapping[str, str | None] | None = None, env: Mapping[str, str] | None = None, at: float | None = None) -> dict:
        """The run and its findings as one object, for runs whose findings a driver can hold."""
        s = self.summary(strict, expected).first().asDict(recursive=True)
        who = identity(flags, env)
        run = {
            "schema_version": SCHEMA_VERSION, "tool_version": __version__, "repo": who["repo"], "commit": who["commit"], "branch": who["branch"], "timestamp": timestamp(at), "identity_source": who["identity_source"],
            "strict": strict, "contract_sha256": s["contract_sha256"], "contract_path": contract_path, "contract_expected": expected, "contract_drift": s["contract_drift"], "files_scanned": s["files_scanned"], "errors": s["errors"], "warnings": s["warnings"],
            "skipped": [r.asDict() for r in self.skipped().orderBy(F.split("path", "/")).collect()], "frameworks_detected": s["frameworks_detected"], "scope": s["scope"],
        }
        found = []
        for r in self.ordered_findings().collect():
            keep = ("fingerprint", "path", "line", "code", "severity", "symbol", "subject", "message", "detail", *(("framework",) if r.framework else ()), "kind", *_OWN[r.kind])
            found.append({k: r[k] for k in keep})
        return {"run": run, "findings": found, "_verdict": s["verdict"], "_gating": s["gating"]}


def to_json(payload: dict) -> str:
    return json.dumps({k: v for k, v in payload.items() if not k.startswith("_")}, indent=2, ensure_ascii=False)


def to_text(payload: dict) -> str:
    """The report for people, grouped by path."""
    run, n = payload["run"], payload["run"]["files_scanned"]
    s = run["scope"]
    plural = lambda k, word: f"{k} {word}{'' if k == 1 else 's'}"
    out = [f"audit  {run['contract_path'] or 'built-in contract'}  {plural(n, 'file')}", f"  contract {run['contract_sha256']}"]
    if run["frameworks_detected"]:
        out.append("  frameworks: " + ", ".join(f"{k} ({v})" for k, v in run["frameworks_detected"].items()))
    if s["functions_total"]:
        out.append(f"  functions: {s['functions_in_scope']} in scope, {s['functions_exempt_framework']} framework-exempt, {s['functions_exempt_user']} user-exempt, {s['functions_out_of_scope']} out of scope")
    for k in run["skipped"]:
        out += [f"  skipped: {k['path']}  {k['reason']} ({k['severity']})", f"        {k['detail']}"]
    path = None
    for f in payload["findings"]:
        if f["path"] != path:
            path = f["path"]
            out += ["", path]
        out.append(f"  {f['line']:>4}  {'error' if run['strict'] else f['severity']}  {f['code']}  {f['message']}" + (f"  [{f['framework']}]" if "framework" in f else ""))
        if f["detail"]:
            out.append(f"        {f['detail']}")
    out.append("")
    if run["contract_drift"]:
        return "\n".join([*out, "CONTRACT DRIFT: another contract is pinned", f"  expected  {run['contract_expected']}", f"  local     {run['contract_sha256']}"])
    counts = ", ".join([plural(run["errors"], "error"), plural(run["warnings"], "warning"), *([f"{len(run['skipped'])} skipped"] if run["skipped"] else [])])
    if not payload["findings"] and not run["skipped"]:
        return "\n".join([*out, f"PASS {plural(n, 'file')} compliant"])
    return "\n".join([*out, f"{'FAIL' if payload['_gating'] else 'PASS'} {counts}" + (f" ({payload['_gating']} gate)" if payload["_gating"] else "")])


def json_schema(kind: DataType) -> dict:
    """JSON Schema of a Spark type."""
    if isinstance(kind, StructType):
        return {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind}, "required": [f.name for f in kind if not f.nullable]}
    if isinstance(kind, ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    if isinstance(kind, MapType):
        return {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    if isinstance(kind, (IntegerType, LongType)):
        return {"type": ["integer", "null"]}
    return {"type": ["boolean", "null"] if isinstance(kind, BooleanType) else ["string", "null"]}
