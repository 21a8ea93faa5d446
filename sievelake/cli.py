"""Commands: init, audit, schema, frameworks, fix. Exit codes: 0 good, 1 findings gate, 2 tool error, 3 contract drift."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import contract as contracts
from .operators import fix as fixes
from .plans.audit import Audit, json_schema, to_json, to_text
from .profiles import PROFILES
from .sources import files


def frameworks() -> list[dict]:
    return [{"name": p.name, "about": p.about, "imports": list(p.imports), "owns": len(p.owns) + len(p.signatures), "governs": list(p.governs), "auto_fix": p.auto_fix, "secret_rules": len(p.secret_keys) + len(p.secret_values), "infra_rules": len(p.infra_keys) + len(p.infra_values)} for p in PROFILES]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser("sievelake")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("init")
    p.add_argument("folder", nargs="?", default=".")
    p.add_argument("--force", action="store_true")
    for name in ("audit", "fix"):
        p = sub.add_parser(name)
        p.add_argument("paths", nargs="*", default=["."])
        p.add_argument("--contract")
        p.add_argument("--write" if name == "fix" else "--strict", action="store_true")
        if name == "audit":
            p.add_argument("--format", choices=("text", "json"), default="text")
            p.add_argument("--expect-contract")
            for flag in ("repo", "commit", "branch"):
                p.add_argument(f"--{flag}")
    sub.add_parser("schema")
    sub.add_parser("frameworks").add_argument("--json", action="store_true")
    a = parser.parse_args(argv)
    try:
        return _run(a, spark)
    except contracts.ContractError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def _run(a: argparse.Namespace, spark: SparkSession | None) -> int:
    if a.command == "init":
        print(contracts.init(a.folder, a.force))
        return 0
    if a.command == "frameworks":
        rows = frameworks()
        print(json.dumps(rows, indent=2) if a.json else "\n".join(f"{r['name']:<11} {r['about']} (imports: {', '.join(r['imports'])})" for r in rows))
        return 0
    spark = spark or SparkSession.builder.appName("sievelake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "schema":
        empty = Audit(spark.createDataFrame([], "path string, kind string, content string, read_error string"))
        print(json.dumps({"run": json_schema(empty.summary().schema), "findings": {"type": "array", "items": json_schema(empty.findings().drop("ord").schema)}}, indent=2))
        return 0
    root = files.scan_root(a.paths)
    path = a.contract or contracts.discover(root)
    contract = contracts.load(path) if path else contracts.Contract()
    expected = contracts.expected(a.expect_contract) if getattr(a, "expect_contract", None) is not None else None
    base = (path.rpartition("/")[0] or ".") if path else root
    found = files.resolve_targets(a.paths, contract)
    audit = Audit(files.read_files(spark, found, base), contract)
    if a.command == "fix":
        results = audit.fixed()
        for r in results.orderBy("path").collect():
            print(f"{r.path}: {len(r.params_added)} parameters, {len(r.secrets_externalized)} secrets" if r.changed else r.path)
            for m in r.manual:
                print(f"  by hand{f', line {m.line}' if m.line else ''}: {m.reason}")
        if a.write:
            print(f"{fixes.write_back(results, base, contract)} files written")
        return 0
    payload = audit.payload(a.strict, expected, path, {"repo": a.repo, "commit": a.commit, "branch": a.branch})
    print(to_json(payload) if a.format == "json" else to_text(payload))
    return payload["_verdict"]


if __name__ == "__main__":
    sys.exit(main())
