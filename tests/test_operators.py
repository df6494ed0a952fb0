"""Text functions, lookup, layout, projections, events, review, profiles, readers, writers, streams."""

import json
import unicodedata
from decimal import Decimal as D

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import text as X
from ledgerloom.operators import emit, events, journal, layout, ledger, reference, review, runs, score
from ledgerloom.plans import profile
from ledgerloom.sources import readers, sinks
from ledgerloom.streaming import events as stream


def one(spark, column, **values):
    """Value of an expression over literals."""
    return spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize("value,want", [(None, ""), ("", ""), (" a\t\n b ", "a b"), (" x  y\u001c", "x y"), ("a​b", "a​b")])
def test_normalise(spark, value, want):
    assert one(spark, X.normalise("v"), v=value) == want


def test_fold_and_compact(spark):
    assert one(spark, X.fold("v"), v="  Coöperatief  STRASSE ß ﬁ① Ø") == "cooperatief strasse ss fi1 ø"
    assert one(spark, X.compact("v"), v="N.I. (Lu), Ltd.") == "nilultd"


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=20))
def test_fold_is_idempotent_on_ascii_and_equals_the_rule(text):
    want = "".join(c for c in unicodedata.normalize("NFKD", " ".join(text.split())) if not unicodedata.combining(c)).casefold()
    assert X._folded(text) == want


def test_variants_and_trim(spark):
    assert one(spark, X.variants("v"), v="NORD, VIK I, SCSP.") == ["NORD, VIK I, SCSP", "NORD VIK I SCSP", "NORDVIK ISCSP"]
    assert one(spark, X.variants("v"), v=" ") == []
    assert one(spark, X.trim_to("v", ["Ltd.", "gmbh"]), v="Big LTDA co LTD.), more") == "Big LTDA co LTD.),"
    assert one(spark, X.trim_to("v", ["ltd"], keep=False), v="Big Ltd more") == "Big"
    assert one(spark, X.trim_to("v", []), v=" a  b ") == "a b"


@pytest.mark.parametrize("value,want", [("1,234.50", D("1234.50")), (" -3 ", D("-3.00")), ("1e3", D("1000.00")), ("NaN", None), ("Infinity", None), ("", None), ("1.2.3", None), (None, None)])
def test_amount(spark, value, want):
    assert one(spark, X.amount("v"), v=value) == want


def test_small_formats(spark):
    assert one(spark, X.money_label("v"), v="EUR 1,234.50") == D("1234.50")
    assert one(spark, X.duration_text(F.col("v").cast("int")), v="125") == "2m 05s"
    assert one(spark, X.code_words("v"), v="NOT_FOUND") == "Not found"
    assert one(spark, X.money_text(F.col("v"), F.lit("EUR")), v="1234.5") == "EUR 1,234.50"
    assert one(spark, X.code_block("v"), v="a```py\nx=1\n```b```\nlonger = 2\n```") == "longer = 2"
    assert one(spark, X.near_miss("r", "t"), r="T T   A B", t="see TT AB") == "JOINED"
    p = F.struct(F.lit(1).alias("page"), F.lit(2.5).alias("x0"), F.lit(3.5).alias("top"), F.lit(4.4).alias("x1"), F.lit(5.6).alias("bottom"))
    assert one(spark, X.citation(p), v="") == "p1 @ (2,4)-(4,6)"
    assert one(spark, X.citation_parts(X.citation(p)), v="").page == 1


def lists(spark):
    return {
        "entities": spark.createDataFrame([("NI V Azurite HoldCo Limited",), ("NI V Kalvik Topco Limited",), ("Cöop U.A. - USD",)], "Name string"),
        "vendors": spark.createDataFrame([("coop",), ("NI V Azurite HoldCo Limited",), ("Plain",)], "Name string"),
    }


def test_lookup_order(spark):
    rows = spark.createDataFrame([("ni v AZURITE, HOLDCO limited",), ("COOP",), ("coop ua",), ("Pl, ain.",), ("nobody",), (None,)], "v string")
    got = {r.v: (r.matched_name, r.table) for r in reference.lookup(rows, "v", [("entities", "Name"), ("vendors", "Name"), ("gone", "x")], lists(spark)).collect()}
    assert got == {"ni v AZURITE, HOLDCO limited": ("NI V Azurite HoldCo Limited", "entities"), "COOP": ("coop", "vendors"), "coop ua": ("Cöop U.A. - USD", "entities"), "Pl, ain.": ("Plain", "vendors"), "nobody": (None, None), None: (None, None)}


def test_candidates_rank_by_rarity(spark):
    rows = spark.createDataFrame([("NI V AZURITE HOLDCO LTD",)], "v string")
    got = reference.candidates(rows, "v", [("entities", "Name")], lists(spark)).orderBy("rank").collect()
    assert got[0].matched_name == "NI V Azurite HoldCo Limited" and [r.rank for r in got] == list(range(1, len(got) + 1))
    assert got[0].score > got[1].score


def test_close_matches_and_span(spark):
    rows = spark.createDataFrame([("NI V KALVIK TOPCO LTD.",), ("zzz",)], "v string")
    for block in (2000, 1):
        got = reference.close_matches(rows, "v", lists(spark)["entities"], "Name", block=block).collect()
        assert {r.rank: r.matched_name for r in got} == {1: "NI V Kalvik Topco Limited", 2: "NI V Azurite HoldCo Limited"}
    assert reference._span("PAID TO (NI V AZ, URITE) NOW", "ni v azurite") == "NI V AZ, URITE"
    assert reference._span("nothing here", "azurite") == "" and reference._span(None, "x") == "" and reference._span("x", "") == ""
    q = spark.createDataFrame([("q1", ["coa"]), ("q2", ["coa", "x"]), ("q3", None)], "id string, requires array<string>")
    assert {r.id: r.available for r in reference.answerable(q, ["coa"]).collect()} == {"q1": True, "q2": False, "q3": True}
    weights = {"ni": 0.1, "azurite": 2.0}
    assert one(spark, reference.resemblance(F.col("a"), F.col("b"), weights, 1.0), a="NI Azurite", b="azurite") == pytest.approx(2.0 / 2.1)


def words(spark, *items):
    return spark.createDataFrame([("x_EUR_1.pdf", 1, t, float(x), float(x) + 5, float(y), float(y) + 8) for t, x, y in items], readers.WORDS)


def test_lines_are_anchored_to_their_first_word(spark):
    got = layout.lines(words(spark, ("a", 1, 10), ("b", 2, 11.4), ("c", 3, 12.8), ("d", 4, 30))).collect()
    assert {r.text: r.line for r in got} == {"a": 0, "b": 0, "c": 1, "d": 2}


HEADERS = layout.HEADERS


def test_parse_statement(spark):
    at = {name: 100 * (i + 1) for i, name in enumerate(HEADERS)}
    w = [("Currency", 40, 5), ("EUR", 180, 5), ("Closing", 460, 5), ("ledger", 500, 5), ("balance", 540, 5), ("brought", 580, 5), ("forward", 620, 5), ("1,000.00", 700, 5)]
    w += [(word, at[name], 40) for name, word in HEADERS.items()]
    w += [("R1", 100, 60), ("31", 400, 60), ("Mar", 410, 60), ("2026", 420, 60), ("50.00", 500, 60), ("1,000.00", 700, 60), ("07:01", 800, 60)]
    w += [("Narrative", 100, 75), ("PAID", 200, 75), ("TO", 230, 75), ("Narrative", 100, 90), ("more", 200, 90)]
    w += [("Balance", 100, 105), ("brought", 140, 105), ("forward", 180, 105), ("31", 220, 105), ("Mar", 240, 105), ("2026", 260, 105), ("950.00", 700, 105), ("Narrative", 100, 120), ("lost", 200, 120)]
    w += [("R2", 100, 135), ("30", 400, 135), ("Mar", 410, 135), ("2026", 420, 135), ("-9.00", 600, 135), ("950.00", 700, 135)]
    statements, rows = layout.parse(words(spark, *w))
    s, r = statements.first(), rows.orderBy("row_index").collect()
    assert (s.scope, s.currency, s.closing_balance, s.printed_openings) == ("EUR_1", "EUR", D("1000.00"), {"31 Mar 2026": D("950.00")})
    assert [(x.row_index, x.bank_reference, x.credit, x.debit, x.balance, x.narrative) for x in r] == [(0, "R1", D("50.00"), None, D("1000.00"), "PAID TO more"), (1, "R2", None, D("-9.00"), D("950.00"), "")]
    assert r[0].provenance.page == 1 and r[0].narrative_provenance.top == 90.0 and "07:01" in s.page_text[0]
    got = {x.name: x.x0 for x in layout.column_positions(layout.lines(words(spark, *w)), HEADERS).collect()}
    assert got == {k: float(v) for k, v in at.items()}


def finished(spark):
    kind = "scope string, row_index int, page int, narrative string, credit string, debit string, who_match struct<status:string,matched_name:string,confidence:double,why:string>, who_raw string, classification string"
    return spark.createDataFrame([("acc", 0, 1, "n", "5.00", None, ("MATCH", "X", None, None), "x", "Fees"), ("acc", 1, 1, "n", None, "-7.00", ("PROBABLE", "Y", 0.8, "near"), "y", "fees"), ("acc", 2, None, "n", "x", None, ("MATCH", "X", None, None), "x", "Fees"), ("acc", 3, 1, "n", "1", None, ("MATCH", "X", None, None), "", "Review")], kind)


def test_gate_and_envelope(spark):
    rows = finished(spark)
    checks = spark.createDataFrame([("c", "acc", "FAIL", "d", ""), ("e", "acc", "CANNOT_VERIFY", "d", ""), ("f", "acc", "PASS", "d", "")], "name string, scope string, status string, detail string, evidence string")
    reasons = {r.row_index: r.review_reason for r in emit.gated(rows).collect()}
    assert reasons == {0: None, 1: "WHO_UNRESOLVED", 2: "MISSING_SOURCE_CITATION", 3: "LOW_CLASSIFICATION_CONFIDENCE"}
    assert all(r.review_reason for r in emit.gated(rows, ["position_match"]).collect())
    queue = emit.queue_order(emit.review_queue(rows, checks)).collect()
    assert [q.reason for q in queue] == ["WHO_UNRESOLVED", "LOW_CLASSIFICATION_CONFIDENCE", "MISSING_SOURCE_CITATION", "CHECK_FAIL"]
    assert "proposed 'Y' at 80%" in queue[0].explanation and queue[0].row_id == "acc-001"
    out = emit.build({"envelope": {"v": 2, "run": "@run_id", "q": "@derive:review_queue", "s": "@derive:summary", "ok": "@derive:export_candidates", "bad": "@derive:blocked_exports", "rows": "@rows", "m": "@derive:mapping_summary", "a": "@derive:audit_trail"}, "row": {"id": "@derive:row_id", "who": "@status:who_match", "none": "$gone", "one": 1}}, rows, checks, {"run_id": "r"})
    assert (out["v"], out["run"], out["ok"].count(), out["bad"].count(), out["rows"].count()) == (2, "r", 1, 3, 4)
    assert out["s"].first().asDict() == {"rows": 4, "ready_for_export": 1, "needs_review": 3, "pass": 1, "fail": 1, "unresolved": 0, "cannot_verify": 1}
    assert out["a"].first().checks_run == ["c", "e", "f"] and set(emit.build({}, rows, checks)) == {"rows", "checks"}
    assert {r.x for r in rows.select(emit.match_chip(rows, "who_match").alias("x")).collect()} == {"MATCH", "PROBABLE"}
    assert emit.conserved(rows, out["ok"], out["bad"]).first().holds
    lines = journal.build(rows, {"fees": "Fee expense"})
    panel = {r.batch: r for r in emit.journal_panel(emit.journal_entries(lines)).collect()}
    assert panel["acc-001"].balanced and panel["acc-001"].debits == D("7.00") and set(panel) == {"acc-000", "acc-001", "acc-003"}
    assert {(x.is_debit, x.transaction_type) for x in lines.where("row_index = 1").first().journal_lines} == {(False, "Cash"), (True, "Fee expense")}
    assert emit.gate_drift(spark.createDataFrame([(1, 2), (None, 1)], "stated int, recomputed int")).first().drift is None
    assert emit.unified([rows, rows.withColumn("source_page", F.lit(9)).drop("page")]).count() == 8


def test_score(spark):
    truth = score.answer_key(spark.createDataFrame([("1", "a", "A", "", "Fees", 1), ("1", "a", "B", "Flag for review x", "Fees", 2), (None, "", "", "", "", 3)], "balance string, counterparty_raw string, counterparty_matched string, project_matched string, classification string, pos int"), "pos")
    kind = "scope string, balance string, counterparty_raw string, counterparty_match struct<status:string,matched_name:string>, project_code_match struct<status:string,matched_name:string>, classification string"
    rows = spark.createDataFrame([("t", "1.00", "x", ("MATCH", "b"), ("MATCH", "P"), "FEES"), ("h", "9", "", None, None, "")], kind)
    t = {r.split: r for r in score.tally(score.compare(rows, truth), ["h"]).collect()}
    assert (t["all"].rows, t["tune"].joined, t["holdout"].unjoined) == (2, 1, 1)
    assert (t["tune"].counterparty_both, t["tune"].counterparty_matched_agree, t["tune"].project_matched_agent_only, t["tune"].classification_agree) == (1, 1, 1, 1)
    assert score.disagreements(score.compare(rows, truth)).count() == 0
    a = spark.createDataFrame([("s", 0, "x"), ("t", 0, "x")], "scope string, row_index int, label string")
    b = spark.createDataFrame([("s", 0, "y"), ("t", 0, "y"), ("t", 1, "z")], "scope string, row_index int, label string")
    assert {r.scope: r._samples for r in score.samples_joined(a, b).collect()}["t"] is None


EVENT = "run string, idx long, kind string, label string, status string, body string, meta map<string,string>, at double"


def test_events(spark):
    checks = lambda *x: {"stage": "a", "checks": json.dumps([{"name": f"c{i}", "status": v} for i, v in enumerate(x)])}
    trace = [
        ("state", "starting", "ok", "", {"passes": "a, b"}, 0.0), ("tool", "grep", "running", "", {}, 1.0), ("stdout", "", "ok", "a\n\nb", {}, 5.0), ("stderr", "", "ok", "c", {}, 5.5), ("tool", "grep", "ok", "", {}, 9.0),
        ("state", "attempt", "ok", "", {"stage": "a", "rows": "5"}, 12.5), ("verdict", "", "ok", "", checks("FAIL", "PASS"), 13.0), ("state", "rejected", "ok", "", {"stage": "a"}, 13.5),
        ("state", "attempt", "ok", "", {"stage": "a"}, 14.0), ("verdict", "", "ok", "", checks("PASS", "PASS"), 15.0), ("state", "exhausted", "ok", "", {"stage": "a", "rows": "0"}, 16.0),
    ]
    e = spark.createDataFrame([("r", i, k, l, s_, b, m, at) for i, (k, l, s_, b, m, at) in enumerate(trace)], EVENT)
    g = {r.idx: r for r in events.gaps(e).collect()}
    assert g[2].in_flight == "grep" and g[1].in_flight is None and g[4].in_flight == "grep" and g[5].in_flight is None and g[4].elapsed == 9.0
    f = events.folded_output(e).first()
    assert (f.n_lines, f.n_errors, f.last, f.tail) == (3, 1, "c", ["a", "b", "c"])
    assert events.failed_stage(e).first().failed_stage == "a"
    assert [(x.stage, x.state, x.outcomes, x.bad) for x in events.stage_states(e).orderBy("position").collect()] == [("a", "failed", ["bad", "live"], 1), ("b", "seen", [], 0)]
    last = events.running_score(e).orderBy(F.desc("idx")).first()
    assert (last.attempts, last.rows, last.stage, last.all_pass, last.all_fail, last.latest_pass, last.latest_fail) == (2, 5, "a", 3, 1, 2, 0)
    assert {(x.what, x.name, x.idx) for x in events.jump_targets(e, "c1").collect()} == {("check", "c1", 9), ("stage", "a", 5)}
    c = events.closing_card(e).first()
    assert (c.won, c.rows, c.attempts, c.passed, c.failed, c.elapsed) == (False, 5, 2, 3, 1, 16.0)
    assert events.closing_card(e, spark.createDataFrame([("r", True)], "run_id string, accepted boolean")).first().won
    d = spark.createDataFrame([("r", i, "delta", "", None, "x" * 100, None, 0.0) for i in range(6)], EVENT)
    assert [len(r.body) for r in events.throttled(d).orderBy("flush").collect()] == [300, 300]
    assert events.reassembled(d, spark.createDataFrame([("r", 600)], "run string, total long")).first().complete


def test_runs(spark):
    r = spark.createDataFrame([("20260101-101010-A", "A", True, True), ("20260102-101010-A", "A", None, False), ("20260102-101010-B", "B", False, True)], "run_id string, account string, accepted boolean, has_trace boolean")
    assert {x.batch: (x.accepted, x.rejected, x.total) for x in runs.by_batch(r).collect()} == {"20260101-101010": (1, 0, 1), "20260102-101010": (0, 1, 2)}
    assert runs.resolve(r, "20260102").first().run_id == "20260102-101010-B" and runs.resolve(r, "latest", "20260101-101010-A").first().run_id == "20260101-101010-A"
    assert runs.picked(r, None, "20260102-101010-A").first().run_id == "20260102-101010-B"
    assert {x.account: x.run_id for x in runs.accounts(r).collect()}["A"] == "20260102-101010-A"
    f = spark.createDataFrame([("x", "resolve-attempt-1.md"), ("x", "extract-attempt-2.md"), ("x", "summary.json")], "run_id string, file string")
    assert runs.stages(f).first().stages == ["extract", "resolve"]


def test_review(spark):
    f = spark.createDataFrame([("a", D("1000"), D("2"), D("5.00"), 1, "DONE", None), ("b", D("1000"), D("2"), D("6.00"), 1, "DONE", ["n"])], "id string, base decimal(20,2), rate decimal(10,4), administrator decimal(20,2), version int, human_state string, notes array<string>")
    r = review.recomputed(f)
    assert {x.id: (x.status, x.version, x.human_state) for x in r.collect()} == {"a": ("MATCH", 2, "UNREVIEWED"), "b": ("DISCREPANCY", 2, "UNREVIEWED")}
    assert review.ready(r).first().ready is False and review.ordered(r).first().id == "b" and review.next_exception(r).first().id == "b"
    u = review.reviewed(r, spark.createDataFrame([("b", "ACCEPTED", " ok ")], "id string, state string, note string"))
    assert {x.id: (x.version, x.notes) for x in u.collect()} == {"a": (2, []), "b": (3, ["n", "ok"])} and review.ready(u).first().ready
    with pytest.raises(Exception, match="version"):
        review.exportable(u, 2).collect()
    assert one(spark, review.direction_text(F.col("v").cast("decimal(10,2)")), v="-2.5") == "2.50 below"
    assert [one(spark, review.label_text(F.col("v")), v=v) for v in ("rule: fee_base_agrees", "_", "NAV")] == ["Fee base agrees", "Verification check", "NAV"]
    req = spark.createDataFrame([("lpa",), ("ledger",)], "role string")
    docs = spark.createDataFrame([("lpa", True, True)], "role string, recognised boolean, confirmed boolean")
    assert review.missing_roles(req, docs).first().role == "ledger" and review.can_start(req, docs).first().can_start is False
    m = review.manifest(spark.createDataFrame([("1",), ("2",)], "client_id string"), spark.createDataFrame([("1", "lpa"), ("1", "x")], "client_id string, role string"))
    assert not m.first().valid
    assert [x.state for x in review.progress(spark.createDataFrame([(1,)], "polls int"), ["a", "b", "c"]).orderBy("k").collect()] == ["complete", "active", "pending"]
    bad = spark.createDataFrame([("m", 1.0, "d", 1, 1.5), ("m", None, "d", 1, 0.5)], "metric string, value double, document string, page int, confidence double")
    assert {x.problem for x in review.metric_problems(bad).collect()} == {"confidence is out of range", "value is missing"}
    ev = spark.createDataFrame([("f", "LPA", "p", 0), ("f", "NAV_WORKBOOK", "Fees!AF12", 1), ("f", "LPA", "Section 8.1", 2), ("f", None, None, 3)], "finding_id string, role string, locator string, position int")
    assert [x.priority for x in review.evidence_order(ev).collect()] == [1, 4, 10, 10]


def test_ledger(spark):
    h = spark.createDataFrame([("x", "60"), ("y", "40")], "n string, amount string")
    assert {r.n: (r.share, r.over) for r in ledger.concentration(h, "n", 0.6).collect()} == {"x": (0.6, False), "y": (0.4, False)}
    e = ledger.excluded(spark.createDataFrame([(["a", "b"],), (["c"],)], "tags array<string>"), "tags", ["b"])
    assert sorted(r.clean for r in e.collect()) == [False, True]


def test_profiles(spark, tmp_path):
    base = {"passes": [{"name": "p", "prompt": "give label", "checks": [{"check": "vocabulary", "field": "label", "allowed": ["x"]}, {"check": "gone"}], "severity": {"c": "often"}, "tables": ["a", "zz"]}]}
    (tmp_path / "base.json").write_text(json.dumps(base))
    (tmp_path / "child.json").write_text(json.dumps({"extends": "base", "output": {"row": {}}}))
    (tmp_path / "loop.json").write_text(json.dumps({"extends": "loop"}))
    (tmp_path / "twice.json").write_text(json.dumps({"passes": [{"name": "p"}, {"name": "p"}]}))
    good, bad = profile.load_all(tmp_path)
    assert [p.name for p in good] == ["base", "child"] and set(bad) == {"loop", "twice"} and len(profile.lint(good[1])) == 2
    assert list(profile.visible(good[0].passes[0], {"a": None, "b": None})) == ["a"]
    checks = spark.createDataFrame([("c", "UNRESOLVED"), ("d", "PASS")], "name string, status string")
    p = profile.Pass("p", severity={"c": "retry"})
    assert not profile.accepted(p, checks).first().accepted and profile.accepted(p, checks, True).first().accepted
    assert len(profile.summaries(tmp_path)) == 4


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "rows.json").write_text('{"rows": [{"a": "1"}, 5, {"a": "2"}]}')
    got = readers.row_files(spark, str(tmp_path / "rows.json"), T.StructType().add("a", "string")).collect()
    assert [(r.row_index, r.a) for r in got] == [(0, "1"), (2, "2")]
    c = readers.coerced(spark.createDataFrame([("1,0", "x", "", None)], "credit string, debit string, balance string, page string")).first()
    assert (c.credit, c.debit, c.page, c.problems) == (D("10.00"), None, 1, ["debit: x"])
    sheet = spark.createDataFrame([(" a\tb ", "1"), ("", " "), (None, "2")], "` Name ` string, Code string")
    assert sorted(map(tuple, readers.list_table(sheet, ["name", "code"]).collect())) == [("", "2"), ("a b", "1")]
    with pytest.raises(ValueError):
        readers.list_table(sheet, ["gone"])
    d = readers.file_digests(spark, str(tmp_path / "rows.json")).first()
    assert d.filename == "rows.json" and d.bytes == (tmp_path / "rows.json").stat().st_size
    assert readers.first_existing(spark, [str(tmp_path / "no"), str(tmp_path)], "*.json").endswith("rows.json")
    run = tmp_path / "runs" / "20260101-101010-A"
    run.mkdir(parents=True)
    (run / "summary.json").write_text(json.dumps({"run_id": "20260101-101010-A", "accepted": True, "rows": 3}))
    (run / "trace.jsonl").write_text('{"kind": "tool", "at": 1.5}\n{"kind": "verdict", "meta": {"checks": [{"name": "c", "status": "FAIL"}]}, "at": 2.5}\n')
    assert readers.runs(spark, str(tmp_path / "runs/*/summary.json")).first().rows == 3
    trace = readers.trace(spark, str(tmp_path / "runs/*/trace.jsonl"))
    assert [(r.idx, r.kind) for r in trace.orderBy("idx").collect()] == [(0, "tool"), (1, "verdict")] and events.closing_card(trace).first().failed == 1
    rows = spark.createDataFrame([("a", 'say "x"')], "account string, narrative string")
    line = sinks.csv_lines(rows).first().value
    assert line.startswith('"a",') and line.endswith('"say ""x"""') and line.count('","') == 16
    sinks.export_csv(rows, str(tmp_path / "csv"))
    assert b"".join(p.read_bytes() for p in (tmp_path / "csv").glob("part-*")).endswith(b"\r\n")
    sinks.write_rows(rows, str(tmp_path / "out"), "resolve")
    assert spark.read.parquet(str(tmp_path / "out/rows")).first().stage == "resolve"
    doc = sinks.result_document(spark.createDataFrame([("s", 1, "b"), ("s", 0, "a")], "scope string, row_index int, v string")).first().document
    assert [x["row_index"] for x in json.loads(doc)["rows"]] == [0, 1]
    fin = finished(spark)
    checks = spark.createDataFrame([("c", "acc", "FAIL", "d", "e1\ne2")], "name string, scope string, status string, detail string, evidence string")
    note = sinks.notes(fin, checks, emit.mapping_summary(fin), emit.review_queue(fin, checks))
    assert "acc c: FAIL, d" in note and "4 to review" in note and sinks.any_failed(checks)


def test_streams(spark, tmp_path):
    run = tmp_path / "in" / "r1"
    run.mkdir(parents=True)
    lines = [{"kind": "state", "label": k, "status": "ok", "meta": {"stage": "s"}, "at": 60.0 + 60.0 * i} for i, k in enumerate(("attempt", "rejected", "attempt", "accepted"))]
    (run / "trace.jsonl").write_text("\n".join(map(json.dumps, lines)))
    e = stream.read(spark, str(tmp_path / "in"))
    seen = []
    stream.subscribe(e, lambda df, _: seen.append(df.count()), str(tmp_path / "c1"), once=True).awaitTermination(120)
    assert sum(seen) == 4
    q = stream.windowed(e).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").agg(F.sum("n")).first()[0] == 4
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.STORE)
    q = stream.stage_states(e).writeStream.format("memory").queryName("s").outputMode("update").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert tuple(spark.table("s").first()) == ("r1", "s", "done", 2, 1, False)


def test_folding_equals_the_rules_on_every_code_point_without_python(spark):
    points = spark.createDataFrame(pd.DataFrame({"c": list(X._points())})).repartition(8)
    made = points.select("c", X.fold(F.concat(F.lit("x"), "c", F.lit("Y"))).alias("f"), X.casefold("c").alias("k"), X.compact("c").alias("a"))
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString() and "Arrow" not in made._jdf.queryExecution().executedPlan().toString()
    bad = [r.c for r in made.toLocalIterator() if (r.f, r.k, r.a) != (X._folded(f"x{r.c}Y"), r.c.casefold(), X._compacted(r.c))]
    assert not bad and made.count() == 0x110000 - 2048


@pytest.mark.parametrize("value", ["Ａǆ ﬃ ŉ", "한국어 텍스트", "ﷺ x ¼½", "ÅÄÖ ß ẞ", "ȩ́ İ ı", "𝔘𝔫𝔦 \u0000 a", "…™ №"])
def test_folding_of_words_that_become_longer(spark, value):
    assert one(spark, X.fold("v"), v=value) == X._folded(value) and one(spark, X.casefold("v"), v=value) == value.casefold() and one(spark, X.compact("v"), v=value) == X._compacted(value)
    assert spark.range(1).select(X.fold(F.lit(None).cast("string")).alias("a"), X.casefold(F.lit(None).cast("string")).alias("b")).first() == ("", None)


def test_parse_moves_words_once(spark):
    for out in layout.parse(words(spark, ("Bank", 100, 40))):
        plan = out._jdf.queryExecution()
        assert plan.executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert len(plan.analyzed().toString()) < 200_000


def test_parse_reads_stories_across_pages_and_the_last_header_word(spark):
    at = {name: 100 * (i + 1) for i, name in enumerate(HEADERS)}
    line = lambda page, y, *texts: [(page, t, x, y) for t, x in texts]
    head = lambda page: line(page, 40, *[(word, at[name]) for name, word in HEADERS.items()])
    row = line(1, 60, ("R1", 100), ("1", 400), ("Mar", 410), ("2026", 420), ("5.00", 500), ("9.00", 700))
    w = head(1) + row + line(1, 80, ("Narrative", 100), ("from", 200)) + line(2, 5, ("Narrative", 100), ("unread", 200)) + line(3, 40, ("Value", 50)) + head(3) + line(3, 80, ("Narrative", 100), ("to", 200))
    table = spark.createDataFrame([("x_EUR_1.pdf", p, t, float(x), float(x) + 5, float(y), float(y) + 8) for p, t, x, y in w], readers.WORDS)
    statements, rows = layout.parse(table)
    assert len(statements.first().page_text) == 3 and statements.first().printed_openings == {}
    # Page 2 has no header, so no columns: its line is no narrative.
    assert [(r.narrative, r.narrative_provenance.page, r.account_number, r.currency) for r in rows.collect()] == [("from to", 3, None, "EUR")]
    assert {r.x0 for r in layout.column_positions(layout.lines(table), HEADERS).where("page = 3").collect()} == {float(x) for x in at.values()}
