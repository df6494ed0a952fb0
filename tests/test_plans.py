"""Whole check plans in one pass: scans in the plan, hot scopes, evidence over many tasks, announced names."""

import random
import re
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import generic_checks, statement_checks, verdicts
from ledgerloom.operators.generic_checks import name_for
from ledgerloom.plans import profile

LINE = "struct<batch:string,amount:string,is_debit:boolean,transaction_type:string>"
SCHEMA = f"scope string, row_index int, narrative string, who_raw string, who_match string, label string, amount string, journal_lines array<{LINE}>"
PLAN = [
    {"check": "provenance", "field": "who_raw"}, {"check": "membership", "field": "who_match", "tables": ["t:n"]}, {"check": "vocabulary", "field": "label", "allowed": ["a", "b"]}, {"check": "label_rate", "field": "label", "label": "b"},
    {"check": "completeness", "fields": ["who_match"]}, {"check": "posting", "chart": ["t:n"]}, {"check": "double_entry"}, {"check": "stage_tie"}, {"check": "resolution_rate", "field": "who_match"}, {"check": "pairing", "field": "who_match"},
]


def data(n=3000):
    rnd = random.Random(9)
    out = []
    for k in range(n):
        batch = rnd.choice([f"b{k}", "shared", "none", f"b{k}"])
        lines = [(batch, "5.00", True, rnd.choice(["x", "Y", "odd", ""])), (batch, rnd.choice(["5.00", "5", "6", "ten"]), False, "x")]
        lines = rnd.choice([lines, lines, lines[:1], None])
        out.append(("hot" if rnd.random() < 0.7 else rnd.choice("cd"), k // 2 if k % 5 else 7, "Paid To Someone", rnd.choice(["to", "nobody", ""]), rnd.choice(["match", "CANNOT_VERIFY", "UNRESOLVED", "odd"]), rnd.choice(["A", "b", "c", None]), "5.00", lines))
    return out


def plain(rows, scope):
    """Problems of some checks by plain loops: (row, order, text) sorted."""
    mine = [r for r in rows if r[0] == scope]
    found = {"who_raw_provenance": [], "label_vocabulary": [], "posting": [], "double_entry": []}
    batches = {}
    for _, i, text, raw, _, label, _, lines in mine:
        if raw and raw not in text.lower():
            found["who_raw_provenance"].append((i, 0, f"row {i}: '{raw}' is not in narrative"))
        if (label or "").lower() not in ("a", "b"):
            found["label_vocabulary"].append((i, 0, f"row {i}: '{label}' is no label" if label else f"row {i}: no label"))
        for pos, (batch, amount, debit, kind) in enumerate(lines or []):
            if kind not in ("x", "Y"):
                found["posting"].append((i, pos, f"row {i}: '{kind}' is not in the chart" if kind else f"row {i}: a line has no transaction_type"))
            batches.setdefault(f"(row {i})" if batch == "none" else batch, []).append((i, batch == "none", None if amount == "ten" else D(amount) * (1 if debit else -1)))
    for name, lines in batches.items():
        row, none = min(x[0] for x in lines), sum(x[1] for x in lines)
        bad = [f"row {row}: a line has no batch id"] * none
        holders = sum(any((f"(row {r[1]})" if b == "none" else b) == name for b, *_ in r[7] or []) for r in mine)
        if holders > 1:
            bad.append(f"batch {name} spans {holders} rows")
        if any(x[2] is None for x in lines):
            bad.append(f"batch {name}: an amount is no number")
        elif len(lines) < 2:
            bad.append(f"batch {name} has one line")
        elif abs(sum(x[2] for x in lines)) > D("0.01"):
            bad.append(f"batch {name} nets to {sum(x[2] for x in lines):.6f}")
        found["double_entry"] += [(row, k, x) for k, x in enumerate(bad)]
    return {k: sorted(v) for k, v in found.items()}


def shown(problems):
    return "\n".join(x for *_, x in problems[:5]) + (f"\n... and {len(problems) - 5} more" if len(problems) > 5 else "")


@pytest.mark.parametrize("block", [4096, 16])
def test_a_plan_in_one_pass_equals_plain_loops(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(verdicts, "BLOCK", block)
    rows = data()
    spark.createDataFrame(rows, SCHEMA).repartition(7).write.parquet(f"{tmp_path}/rows")
    tables = {"t": spark.createDataFrame([("X",), ("y ",), ("",)], "n string")}
    got = generic_checks.run(spark.read.parquet(f"{tmp_path}/rows"), PLAN, tables)
    by = {(r["scope"], r["name"]): r for r in got.collect()}
    assert {n for _, n in by} == {name_for(s["check"], s) for s in PLAN} and len(by) == 3 * len(PLAN)
    for scope in ("hot", "c", "d"):
        for name, problems in plain(rows, scope).items():
            assert by[scope, name].evidence == shown(problems), (scope, name)
            assert by[scope, name].status == ("FAIL" if problems else "PASS")
    text = got.select("*")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet[^\n]*/rows", text)) == 1, "the rows are read once"


def test_statement_checks_read_the_rows_once(spark, tmp_path):
    from tests.test_checks import rows, statements

    rows(spark).write.parquet(f"{tmp_path}/rows")
    statements(spark).write.parquet(f"{tmp_path}/statements")
    got = statement_checks.run_statement_checks(spark.read.parquet(f"{tmp_path}/statements"), spark.read.parquet(f"{tmp_path}/rows"))
    text = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet[^\n]*/rows", text)) == 1
    assert "NestedLoop" not in text and "Cartesian" not in text and got.count() == 6


def test_statement_texts_are_not_joined_to_rows(spark):
    from tests.test_checks import rows, statements

    s = statements(spark)
    assert "page_text" in s.columns
    plan = statement_checks.run_statement_checks(s, rows(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan, "a statement's text would be carried by each of its rows"
    refs = [("a", i, f"ref {i}") for i in range(9)] + [("b", 0, "here"), (None, 0, "x")]
    r = spark.createDataFrame([(c, i, D(1), None, D(1), "1 Mar 2026", x) for c, i, x in refs], "scope string, row_index int, credit decimal(38,2), debit decimal(38,2), balance decimal(38,2), value_date string, bank_reference string")
    s = spark.createDataFrame([("a", ["REF 0 REF2", "ref 3"]), ("b", ["or", "here"]), ("c", None), (None, ["x"])], "scope string, page_text array<string>")
    got = {x.scope: x for x in statement_checks.run_statement_checks(s, r, ("reference_provenance",)).collect()}
    assert set(got) == {"a", "b", "c"} and [got[k].detail for k in "abc"] == ["1/9 references are in the text", "1/1 references are in the text", "0/0 references are in the text"]
    assert got["a"].evidence.split("\n") == [f"row {i}: 'ref {i}' is not in the text" + {0: " (it is with other spaces or case)", 2: " (it is with other spaces or case)"}.get(i, "") for i in (0, 1, 2, 4, 5)] + ["... and 3 more"]


def test_openings_by_sweep_equal_a_range_join(spark):
    rnd = random.Random(2)
    day = lambda d: f"{d} Mar 2026" if d else "no day"
    rows = [(s, i, D(rnd.randint(1, 50)), None, D(rnd.randint(0, 900)), day(rnd.randint(0, 28))) for s in "abc" for i in range(60)]
    marks = [(s, {day(d): D(rnd.randint(0, 500)) for d in rnd.sample(range(0, 30), 6)}) for s in "abcz"]
    r = spark.createDataFrame(rows, "scope string, row_index int, credit decimal(38,2), debit decimal(38,2), balance decimal(38,2), value_date string")
    s = spark.createDataFrame(marks, "scope string, printed_openings map<string,decimal(38,2)>")
    want = {}
    for scope, m in marks:
        mine = [x for x in rows if x[0] == scope]
        for text, printed in m.items():
            d = int(text.split()[0]) if text[0].isdigit() else None
            moved = sum(x[2] for x in mine if d and x[5][0].isdigit() and int(x[5].split()[0]) >= d)
            newest = mine[0][4] if mine else None
            want[scope, text] = (moved, newest, d is None or (newest is not None and newest - moved == printed))
    got = statement_checks.opening_markers(s, r)
    assert {(x.scope, x.marker): (x.movements, x.newest, x.holds) for x in got.collect()} == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_an_empty_table_has_no_scopes(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert generic_checks.run(empty, PLAN, {}).count() == 0
    assert generic_checks.run(spark.createDataFrame([(None, None, None, None, None, None, None, None)], SCHEMA), PLAN, {}).count() == len(PLAN)


@pytest.mark.parametrize("r,t,want", [
    ("T T   A B", "see TT AB", "JOINED"), ("T T      A B", "see TT  AB", "JOINED"), ("T T      A B", "see TT AB", "SPACING"), ("A B", "x ab", "SPACING"), ("A B", "A\nB", ""), ("A B", "A \n B", ""), ("AB", "ab", "SPACING"), ("A\tB", "AB", "JOINED"), (" ", "x", ""),
])
def test_hints_of_near_misses(spark, r, t, want):
    from ledgerloom.functions.text import near_miss

    assert spark.range(1).select(near_miss(F.lit(r), F.lit(t)).alias("x")).first().x == want


def test_names_to_announce():
    assert profile.announced(profile.Pass("p", checks=[{"check": "vocabulary", "field": "a", "allowed": []}, {"check": "double_entry"}])) == ["a_vocabulary", "double_entry"]
    assert name_for("provenance", {"field": "a"}) == "a_provenance" and name_for("completeness", {"fields": []}) == "resolution_completeness" and name_for("agreement", {}) == "sample_agreement"
    assert name_for("label_rate", {"field": "a", "label": " Flag  IT "}) == "a_flag it_rate" and name_for("stage_tie", {"field": "x"}) == "stage_tie" and name_for("posting", {}) == "posting"
