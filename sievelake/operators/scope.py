"""Which frameworks are at work in a file, and which of its functions are governed; expressions over an analysed row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contract import Contract
from ..functions.text import last_segment
from ..functions.wildcards import any_of
from ..profiles import PROFILES, Profile

GOVERNED, REPORT_ONLY, FRAMEWORK, USER, OUT = "governed", "governed_report_only", "exempt_framework", "exempt_user", "out_of_scope"
DBT_FILES = ("dbt_project.yaml", "dbt_project.yml", "profiles.yaml", "profiles.yml")


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def decorated(f: Column, names) -> Column:
    """A decorator is one of the names, by its whole path or its last segment."""
    if not names:
        return F.lit(False)
    return F.exists(f["decorators"], lambda d: d.isin(*names) | last_segment(d).isin(*names))


def owns(p: Profile, f: Column) -> Column:
    def signed(name: str, leading: tuple[str, ...]) -> Column:
        first = F.slice(F.transform(f["params"], lambda x: x["name"]), 1, len(leading))
        return (f["name"] == name) & (first == F.array(*map(F.lit, leading)))

    return _any([decorated(f, p.owns), *(signed(*s) for s in p.signatures)])


def detected(p: Profile) -> Column:
    """Imported, or any function's signature is the framework's (decorators count, imported or not)."""
    return F.arrays_overlap("modules", F.array(*map(F.lit, p.imports))) | F.exists("functions", lambda f: owns(p, f))


def active_profiles(contract: Contract) -> Column:
    """Names of the profiles at work, in evaluation order: disabling wins, then enabling, then detection."""
    on, off = contract.frameworks.enable, contract.frameworks.disable
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    out = []
    for p in PROFILES:
        if p.name in off:
            continue
        if p.name in on:
            use = F.lit(True)
        elif "auto" in on:
            use = F.when(F.col("kind") == "yaml", name.isin(*DBT_FILES) if p.name == "dbt" else F.lit(False)).otherwise(detected(p))
        else:
            continue
        out.append(F.when(use, F.lit(p.name)))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def first_active(active: Column, holds) -> Column:
    """The first active profile for which holds(profile); null if there is none."""
    out = [F.when(F.array_contains(active, p.name) & c, F.lit(p.name)) for p in PROFILES if (c := holds(p)) is not None]
    return F.coalesce(*out) if out else F.lit(None).cast("string")


def governing(active: Column, f: Column) -> Column:
    return first_active(active, lambda p: decorated(f, p.governs) if p.governs else None)


def no_auto_fix(active: Column, f: Column) -> Column:
    return first_active(active, lambda p: decorated(f, p.governs) if p.governs and not p.auto_fix else None)


def owning(active: Column, f: Column) -> Column:
    return first_active(active, lambda p: owns(p, f) if p.owns or p.signatures else None)


def decision(contract: Contract, active: Column, f: Column) -> Column:
    rules = contract.applies_to
    selected = F.lit(rules.all_functions) | any_of(f["name"], rules.name_patterns) | F.exists(f["decorators"], lambda d: any_of(d, rules.decorators) | any_of(last_segment(d), rules.decorators)) | governing(active, f).isNotNull()
    return F.when(owning(active, f).isNotNull(), FRAMEWORK).when(any_of(f["name"], rules.exempt_name_patterns), USER).when(~selected, OUT).when(no_auto_fix(active, f).isNotNull(), REPORT_ONLY).otherwise(GOVERNED)
