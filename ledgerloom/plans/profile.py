"""Check plans: JSON profiles with inheritance, lint, and the pass/fail policy.

A profile is metadata of a few kilobytes, so this is plain Python on the driver; the checks that it names are Spark plans.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import generic_checks

SEVERITIES = ("advisory", "retry")


@dataclass
class Pass:
    name: str
    prompt: str = ""
    checks: list[dict] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)
    severity: dict[str, str] = field(default_factory=dict)


@dataclass
class Profile:
    name: str
    passes: list[Pass] = field(default_factory=list)
    output: dict = field(default_factory=dict)
    questions: list[dict] = field(default_factory=list)


def merged(folder: str | Path, name: str, seen: tuple[str, ...] = ()) -> dict:
    """A profile's JSON over that of the profile it extends; its keys replace those below."""
    if name in seen:
        raise ValueError("profiles extend each other: " + " -> ".join([*seen, name]))
    data = json.loads((Path(folder) / f"{name}.json").read_text(encoding="utf-8"))
    base = data.pop("extends", None)
    return (merged(folder, base, (*seen, name)) if base else {}) | data


def load(folder: str | Path, name: str) -> Profile:
    data = merged(folder, name)
    passes = [Pass(**{k: v for k, v in p.items() if k in Pass.__dataclass_fields__}) for p in data.get("passes", [])]
    names = [p.name for p in passes]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"profile {name} has passes twice: {', '.join(twice)}")
    return Profile(name, passes, data.get("output", {}), data.get("questions", []))


def load_all(folder: str | Path) -> tuple[list[Profile], dict[str, str]]:
    """All profiles of a folder, and what is wrong with those that do not load."""
    good, bad = [], {}
    for path in sorted(Path(folder).glob("*.json")):
        try:
            good.append(load(folder, path.stem))
        except (ValueError, TypeError, KeyError, FileNotFoundError) as e:
            bad[path.stem] = str(e)
    return good, bad


def lint(profile: Profile) -> list[str]:
    """Checks that are unknown, judge a field that the prompt never mentions, or have an unknown severity."""
    out = []
    for p in profile.passes:
        for check in p.checks:
            name = check.get("check")
            if name not in generic_checks.CHECKS:
                out.append(f"{p.name}: no check {name!r}")
            judged = [check["field"]] if "field" in check else list(check.get("fields", []))
            out += [f"{p.name}: {name} judges {f}, which the prompt does not ask for" for f in judged if p.prompt and f not in p.prompt]
        out += [f"{p.name}: severity {s!r} of {c}" for c, s in p.severity.items() if s not in SEVERITIES]
    return out


def announced(p: Pass) -> list[str]:
    """Names under which the checks of a pass will report, to tell them before it runs."""
    return [generic_checks.name_for(c["check"], c) for c in p.checks]


def visible(p: Pass, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables that a pass may see: all, or those it names; unknown names mean nothing."""
    return {k: v for k, v in tables.items() if not p.tables or k in p.tables}


def judged(p: Pass, checks: DataFrame) -> DataFrame:
    """Checks with ``outcome``: ``broken`` if failed, ``thin`` if open and promoted to ``retry``, else ``fine``."""
    retry = [c for c, s in p.severity.items() if s == "retry"]
    thin = (F.col("status") == "UNRESOLVED") & (F.col("name").isin(*retry) if retry else F.lit(False))
    return checks.withColumn("outcome", F.when(F.col("status") == "FAIL", "broken").when(thin, "thin").otherwise("fine"))


def accepted(p: Pass, checks: DataFrame, last_attempt: bool = False) -> DataFrame:
    """One row: is a pass accepted?  Thin checks stop it except on the last attempt."""
    out = judged(p, checks).agg(F.count_if(F.col("outcome") == "broken").alias("broken"), F.count_if(F.col("outcome") == "thin").alias("thin"))
    return out.withColumn("accepted", (F.col("broken") == 0) & (F.lit(last_attempt) | (F.col("thin") == 0)))


def run(profile: Profile, name: str, rows: DataFrame, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """All checks of a pass over its rows."""
    p = next(x for x in profile.passes if x.name == name)
    return generic_checks.run(rows, p.checks, tables or {})


def summaries(folder: str | Path) -> list[dict]:
    good, bad = load_all(folder)
    rows = [{"name": p.name, "passes": [x.name for x in p.passes], "checks": sum(len(x.checks) for x in p.passes), "problem": None} for p in good]
    return rows + [{"name": n, "passes": [], "checks": 0, "problem": why} for n, why in bad.items()]
