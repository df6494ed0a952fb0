"""What a run leaves behind: samples of a reconciliation, rows that do not foot, rows of several shapes, summaries, the export."""

from decimal import Decimal as D
from pathlib import Path

from ledgerloom.operators import corpus_checks, emit
from ledgerloom.sources import sinks

LINE = "struct<batch:string,amount:string,is_debit:boolean,transaction_type:string>"


def test_samples_come_in_the_order_of_the_rows(spark):
    kind = "scope string, row_index int, credit decimal(38,2), debit decimal(38,2), balance decimal(38,2)"
    source = spark.createDataFrame([("b", i, D(90 - i), None, D(1)) for i in range(4)] + [("a", i, D(50 + i), None, D(2)) for i in range(4)] + [("b", 9, D(90), None, D(1))], kind)
    derived = source.where("scope = 'b' AND row_index = 3")
    got = corpus_checks.corpus_universe(source, derived).first()
    assert got.evidence == "source 9, derived 1; 8 dropped (50.00 @ 2.00; 51.00 @ 2.00; 52.00 @ 2.00; 53.00 @ 2.00; 90.00 @ 1.00 x2; and 2 more)"
    back = corpus_checks.corpus_universe(derived, source).first()
    assert "8 invented (50.00 @ 2.00; 51.00 @ 2.00; 52.00 @ 2.00; 53.00 @ 2.00; 90.00 @ 1.00 x2; and 2 more)" in back.evidence


def test_rows_whose_batches_do_not_foot_are_not_ready(spark):
    good, off, one = [("b", "5", True, "x"), ("b", "5", False, "x")], [("c", "5", True, "x"), ("c", "6", False, "x")], [("d", "5", True, "x")]
    spans = [("e", "5", True, "x")], [("e", "5", False, "x")], [("f", "ten", True, "x"), ("f", "1", False, "x")], [("none", "5", True, "x"), ("", "5", False, "x")], None
    rows = spark.createDataFrame([("s", i, 1, lines) for i, lines in enumerate([good, off, one, *spans])], f"scope string, row_index int, page int, journal_lines array<{LINE}>")
    got = {r.row_index: (r.review_reason, r.ready_for_export) for r in emit.gated(rows, journal="journal_lines").collect()}
    assert got == {i: ("NON_FOOTING_BATCH", False) if i in (1, 2, 5) else (None, True) for i in range(8)}
    assert emit.gated(rows).where("NOT ready_for_export").count() == 0


def test_rows_of_three_shapes(spark):
    envelope = spark.createDataFrame(
        [("x-001", 3, "2026-01-02", "1,000.50", "EUR", "Paid", "MATCH", "UNRESOLVED", None, True), ("x-002", None, "2026-01-03", "5", "EUR", "", "MATCH", "MATCH", "MISSING_SOURCE_CITATION", False)],
        "row_id string, source_page int, transaction_date string, amount string, currency string, raw_narrative string, counterparty_status string, project_code_status string, review_reason string, ready_for_export boolean",
    )
    run = spark.createDataFrame(
        [("acc", 0, 1, "3 Jan 2026", None, "-4.00", "9.00", "EUR", "told", "R1", "FEE", "me", ("MATCH", "Me", "vendors", 0.9, "w"), "MATCH", "Fees"), ("acc", 1, None, "4 Jan 2026", "4", "", "13", "EUR", "", "", "", "", ("PROBABLE", None, None, None, None), "", "review")],
        "scope string, row_index int, page int, value_date string, credit string, debit string, balance string, currency string, narrative string, bank_reference string, trn_type string, counterparty_raw string, counterparty_match struct<status:string,matched_name:string,table:string,confidence:double,why:string>, project_code_status string, classification string",
    )
    cited = spark.createDataFrame([("j-1", (7, "from the text"), "8.00")], "row_id string, source_citation struct<page:int,snippet:string>, amount string")
    got = {r.id: r for r in emit.unified([envelope, run, cited]).collect()}
    assert set(got) == {"x-001", "x-002", "acc-000", "acc-001", "j-1"}
    assert (got["x-001"].amount, got["x-001"].page, got["x-001"].ready, got["x-001"].stated, got["x-001"].recomputed, got["x-001"].balance) == (D("1000.50"), 3, True, True, False, None)
    assert (got["x-002"].reason, got["x-002"].ready, got["acc-000"].stated) == ("MISSING_SOURCE_CITATION", False, None)
    assert (got["acc-000"].amount, got["acc-000"].balance, got["acc-000"].counterparty.table, got["acc-000"].project_code.status, got["acc-000"].ready) == (D("-4.00"), D("9.00"), "vendors", "MATCH", True)
    assert (got["acc-001"].reason, got["acc-001"].ready, got["j-1"].page, got["j-1"].narrative, got["j-1"].ready) == ("MISSING_SOURCE_CITATION", False, 7, "from the text", True)
    per = emit.stated_clean(emit.unified([envelope, run]).selectExpr("split(id, '-')[0] AS account", "*"))
    assert {r.account: (r.stated, r.recomputed) for r in per.collect()} == {"x": (1, 0), "acc": (None, 1)}
    assert emit.gate_drift(per).first().drift is None and emit.gate_drift(per.where("account = 'x'")).first().drift == -1


def test_summary_latest_and_one_export(spark, tmp_path):
    root = str(tmp_path)
    assert sinks.latest(spark, root) is None
    for run in ("20260101-000000-A", "20260102-000000-B"):
        assert sinks.write_summary(spark, f"{root}/{run}", {"run_id": run, "rows": D("3"), "é": 1}) == f"{root}/{run}/summary.json"
        sinks.mark_latest(spark, root, run)
    assert sinks.latest(spark, root) == "20260102-000000-B" and '"rows": "3"' in (tmp_path / "20260101-000000-A" / "summary.json").read_text()
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("latest")] == ["latest"]
    rows = spark.range(50).selectExpr("cast(id AS string) AS account", "'say \"x\"' AS narrative").repartition(4)
    sinks.export_csv(rows, f"{root}/csv", ("account", "narrative", "page"))
    whole = b"".join(p.read_bytes() for p in sorted(Path(root, "csv").glob("part-*"))).decode("utf-8")
    lines = whole.split("\r\n")
    assert lines[0] == '﻿"account","narrative","page"' and sorted(lines[1:-1]) == sorted(f'"{i}","say ""x""",""' for i in range(50)) and lines[-1] == ""
