"""Checks on hand-made rows: one behaviour each, and faults that must trip the right check."""

from decimal import Decimal as D

import pytest

from ledgerloom.operators import corpus_checks, generic_checks, statement_checks

ROW = "scope string, row_index int, credit decimal(38,2), debit decimal(38,2), balance decimal(38,2), value_date string, bank_reference string, provenance struct<page:int,x0:double,top:double,x1:double,bottom:double>"
STATEMENT = "scope string, closing_balance decimal(38,2), printed_openings map<string,decimal(38,2)>, page_text array<string>"


def rows(spark, data=None):
    box = (1, 1.0, 2.5, 3.0, 4.0)
    data = data or [("a", 0, D("5"), None, D("15"), "3 Mar 2026", "R1", box), ("a", 1, None, D("-2"), D("10"), "2 Mar 2026", "R2", box), ("a", 2, D("12"), None, D("12"), "1 Mar 2026", "", box)]
    return spark.createDataFrame(data, ROW)


def statements(spark, data=None):
    return spark.createDataFrame(data or [("a", D("15"), {"3 Mar 2026": D("10"), "2 Mar 2026": D("12"), "junk": D("1")}, ["07:01 R1 1", "R2 07:02 08:00"])], STATEMENT)


def by_name(df):
    return {r.name: r for r in df.collect()}


def test_a_clean_statement_passes(spark):
    got = by_name(statement_checks.run_statement_checks(statements(spark), rows(spark)))
    assert {n: r.status for n, r in got.items()} == {n: "PASS" for n in ("balance_chain", "closing_balance", "printed_openings", "row_count", "one_amount_per_row", "reference_provenance")}
    assert got["balance_chain"].detail == "2/2 links hold"


def test_a_changed_amount_breaks_chain_and_openings(spark):
    got = by_name(statement_checks.run_statement_checks(statements(spark), statement_checks.corrupted(rows(spark), "a", 0)))
    assert got["balance_chain"].status == "FAIL" and got["printed_openings"].status == "FAIL" and got["closing_balance"].status == "PASS"
    assert "row 0" in got["balance_chain"].evidence


def test_a_dropped_row_breaks_count_and_openings(spark):
    left = rows(spark).where("row_index <> 1")
    got = by_name(statement_checks.run_statement_checks(statements(spark), left))
    assert got["row_count"].status == "FAIL" and got["printed_openings"].status == "FAIL"


def test_missing_figures(spark):
    none = statements(spark, [("a", None, {}, None), ("b", D("1"), {"1 Mar 2026": D("1")}, [])])
    got = {(r.scope, r.name): r.status for r in statement_checks.run_statement_checks(none, rows(spark)).collect()}
    assert got["a", "closing_balance"] == "UNRESOLVED" and got["a", "printed_openings"] == "CANNOT_VERIFY"
    assert got["b", "closing_balance"] == "FAIL" and got["b", "printed_openings"] == "FAIL" and got["b", "balance_chain"] == "PASS" and got["b", "row_count"] == "PASS"


def test_null_balance_is_a_break(spark):
    data = [("a", 0, D("5"), None, None, "x", "R", None), ("a", 1, D("1"), D("1"), D("2"), "x", "r 1", None), ("a", 2, None, None, D("1"), "x", "Q", None)]
    got = by_name(statement_checks.run_statement_checks(statements(spark), rows(spark, data)))
    assert got["balance_chain"].detail == "1/2 links hold" and got["one_amount_per_row"].detail == "1/3 rows have one amount"
    assert "other spaces or case" in got["reference_provenance"].evidence


def test_evidence_is_capped(spark):
    data = [("a", i, None, None, D("1"), "x", "", None) for i in range(9)]
    got = by_name(statement_checks.one_amount_per_row(statements(spark), rows(spark, data)))["one_amount_per_row"]
    assert got.evidence.count("\n") == 5 and got.evidence.endswith("... and 4 more") and got.evidence.startswith("row 0")


LINES = "scope string, row_index int, amount string, journal_lines array<struct<batch:string,amount:string,is_debit:boolean,transaction_type:string>>"


def entry(spark, *lines_of_rows, amount="10.00"):
    return spark.createDataFrame([("a", i, amount, lines) for i, lines in enumerate(lines_of_rows)], LINES)


GOOD = [("b1", "10.00", True, "Cash"), ("b1", "10.00", False, "Fees")]


@pytest.mark.parametrize("lines,options,status,problems", [
    ([GOOD], {}, "PASS", 0), ([None], {}, "CANNOT_VERIFY", 0), ([[("b", "10", True, "x"), ("b", "10.02", False, "x")]], {}, "FAIL", 1), ([[("b", "10", True, "x"), ("b", "10.005", False, "x")]], {}, "PASS", 0),
    ([[("b", "10", True, "x")]], {}, "FAIL", 1), ([[("", "10", True, "x"), (None, "10", False, "x")]], {}, "FAIL", 2), ([[("None", "10", True, "x"), ("null", "10", False, "x")]], {}, "FAIL", 2),
    ([GOOD, GOOD], {}, "FAIL", 1), ([[*GOOD, ("b1", "0", True, "x")]], {}, "PASS", 0), ([[*GOOD, ("b1", "0", True, "x")]], {"lines_per_batch": 2}, "FAIL", 1), ([[("b", "ten", True, "x"), ("b", "10", False, "x")]], {}, "FAIL", 1),
    ([[("b", "1,000.00", True, "x"), ("b", "1000", False, "x")]], {}, "PASS", 0),
])
def test_double_entry(spark, lines, options, status, problems):
    got = generic_checks.double_entry(entry(spark, *lines), options).first()
    assert got.status == status
    if status != "CANNOT_VERIFY":
        assert got.detail.endswith(f"{problems} problems")


def test_stage_tie_and_posting(spark):
    assert generic_checks.stage_tie(entry(spark, GOOD), {}).first().status == "PASS"
    assert generic_checks.stage_tie(entry(spark, GOOD, amount="100.00"), {}).first().status == "FAIL"
    assert generic_checks.stage_tie(entry(spark, None), {}).first().status == "CANNOT_VERIFY"
    zero = spark.createDataFrame([("a", 0, "0", "-10.00", GOOD)], "scope string, row_index int, credit string, debit string, " + LINES.split(", ", 3)[3])
    assert generic_checks.stage_tie(zero, {}).first().status == "PASS"
    chart = {"coa": spark.createDataFrame([("CASH",), ("other",)], "`Trans Type` string")}
    got = generic_checks.posting(entry(spark, GOOD), {"chart": ["coa:Trans Type"]}, chart).first()
    assert got.status == "FAIL" and "'Fees'" in got.evidence
    assert generic_checks.posting(entry(spark, GOOD), {"chart": ["gone:x"]}, chart).first().status == "PASS"
    assert generic_checks.posting(entry(spark, [("b", "1", True, " ")]), {}, {}).first().status == "FAIL"
    assert generic_checks.batches_balance(entry(spark, GOOD, [("c", "1", True, "x")])).first().balanced == 1


RES = "scope string, row_index int, narrative string, who_raw string, who_match struct<status:string,matched_name:string,table:string,confidence:double,why:string>, flat_match string, label string"


def resolved(spark):
    return spark.createDataFrame([
        ("a", 0, "PAID Café Coöp  ltd", "café", ("match", "CAFE coop Ltd", "vendors", None, None), "MATCH", "Vendor"),
        ("a", 1, "x", "", ("CANNOT_VERIFY", None, None, None, None), " unresolved ", "vendor"),
        ("a", 2, "x", "zed", ("PROBABLE", "Cafe Coop Ltd", None, 1.0, " "), None, "odd"),
        ("a", 3, "x", None, ("MATCH", "Nobody", "vendors", None, None), "", None),
        ("a", 4, "x", "x", ("MATCH", "Cafe Coop Ltd", "other", None, None), "?", "Review"),
        ("a", 5, "x", "x", None, "FAIL", "review"),
    ], RES)


def test_resolution_checks(spark):
    lists = {"vendors": spark.createDataFrame([("Café  Coöp Ltd",), ("",)], "Name string"), "other": spark.createDataFrame([("Z",)], "Name string")}
    plan = [
        {"check": "provenance", "field": "who_raw"}, {"check": "membership", "field": "who_match", "tables": ["vendors:Name", "other:Name", "gone:Name"]}, {"check": "proposals", "field": "who_match"},
        {"check": "pairing", "field": "who_match"}, {"check": "completeness", "fields": ["who_match", "flat_match", "none_match"]}, {"check": "vocabulary", "field": "label", "allowed": ["VENDOR", "Review"]},
        {"check": "label_rate", "field": "label", "label": "Review"}, {"check": "resolution_rate", "field": "flat_match"}, {"check": "agreement", "fields": ["label"]},
    ]
    got = by_name(generic_checks.run(resolved(spark), plan, lists))
    assert got["who_raw_provenance"].detail == "3/4 values are in narrative"
    assert got["who_match_membership"].evidence.count("\n") == 2 and got["who_match_membership"].detail == "3 MATCH, 1 PROBABLE, 1 CANNOT_VERIFY"
    assert got["who_match_proposals"].detail == "-1/1 proposals have a reason and a confidence"
    assert got["who_match_pairing"].detail == "5/6 rows agree with who_raw"
    assert got["resolution_completeness"].detail == "8/18 resolutions have a status"
    assert got["label_vocabulary"].detail == "4/6 rows have a known label"
    assert got["label_review_rate"].status == "PASS" and got["label_review_rate"].evidence == "rows 4, 5"
    assert got["flat_match_resolution_rate"].detail == "3/4 resolved, 1 not (25%)"
    assert got["sample_agreement"].status == "CANNOT_VERIFY"
    with pytest.raises(ValueError, match="no check"):
        generic_checks.run(resolved(spark), [{"check": "gone"}])


def test_agreement_and_explanation(spark):
    s = spark.createDataFrame([("a", 0, "X", "p", [("x", "p"), ("x", "q")]), ("a", 1, "X", "p", [("Y", "q")]), ("a", 2, "X", "p", None)], "scope string, row_index int, label string, other string, _samples array<struct<label:string,other:string>>")
    got = generic_checks.agreement(s, {"fields": ["label", "other"]}).first()
    assert (got.status, got.detail) == ("UNRESOLVED", "0/2 rows agree") and got.evidence.count("\n") == 2
    q = spark.createDataFrame([("a", 0, "yes", None, None, (["s"], ["i"])), ("a", 1, "yes", None, None, (["s"], [])), ("a", 2, "cannot_verify", "", [], None), ("a", 3, "cannot_verify", "why", ["t"], None), ("a", 4, " ", None, None, None), ("a", 5, "no", None, None, None)],
        "scope string, row_index int, verdict string, because string, missing array<string>, explanation struct<steps:array<string>,inputs:array<string>>")
    got = generic_checks.explanation(q, {}).first()
    assert got.detail == "1/6 answers explain themselves" and got.evidence.count("\n") == 4


def side(spark, *pairs):
    return spark.createDataFrame([(D(a), None if b is None else D(b)) for a, b in pairs], "amount decimal(38,2), balance decimal(38,2)")


def source(spark, *pairs):
    return side(spark, *pairs).selectExpr("amount AS credit", "cast(null AS decimal(38,2)) AS debit", "balance")


def test_corpus_checks(spark):
    s = source(spark, ("1", "1"), ("2", "3"), ("2", "3"), ("5", None))
    assert corpus_checks.corpus_universe(s, side(spark, ("1.00", "1"), ("2", "3"), ("2", "3"), ("5", None))).first().status == "PASS"
    got = corpus_checks.corpus_universe(s, side(spark, ("1", "1"), ("2", "3"), ("7", "3"), ("5", None))).first()
    assert got.status == "FAIL" and "1 dropped (2.00 @ 3.00)" in got.evidence and "1 invented (7.00 @ 3.00)" in got.evidence
    pair = side(spark, ("0", "1"), ("3", "3"), ("2", "3"), ("5", None))
    assert corpus_checks.corpus_universe(s, pair).first().status == "FAIL" and corpus_checks.corpus_aggregate(s, pair).first().status == "PASS"
    assert corpus_checks.corpus_universe(s, pair.where("false")).first().status == "CANNOT_VERIFY"
    journal = spark.createDataFrame([("10", "Yes"), ("10", "no")], "amount string, is_debit string")
    assert corpus_checks.corpus_stage_tie(side(spark, ("-10", None)), journal).first().status == "PASS"
    assert corpus_checks.corpus_stage_tie(side(spark, ("-10.01", None)), journal).first().status == "FAIL"
    assert corpus_checks.multiset_difference(pair, pair).count() == 0
