"""Registered queries of the smaller operators: text forms, projections, reviews, runs; each with an SQL twin that works it out anew."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerloom.catalog import ORDERS, REASON, RESOLVED, SIDES, lists, order_rows, query, resolved_rows, table
from ledgerloom.functions import text as X
from ledgerloom.operators import corpus_checks, emit, generic_checks, layout, reference, review, runs, score, statement_checks
from ledgerloom.plans import profile
from ledgerloom.schemas import MONEY
from ledgerloom.sources import readers, sinks


def pick(c, *values):
    """The value at ``c`` modulo their number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (c % len(values) + 1).cast("int"))


# Text forms


@query("SELECT DISTINCT p_type AS value FROM part WHERE trim(p_type) <> ''")
def reference_values(spark, sf):
    return reference.values(table(spark, sf, "part"), "p_type")


@query(
    r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' ' || coalesce(text, '') || chr(10) ELSE 'see ```py' || chr(10) || coalesce(text, '') || chr(10) || '``` or ```' || chr(10) || source || '```' END AS reply FROM documents),
    f AS (SELECT doc_id, reply, regexp_extract_all(reply, '```[a-zA-Z]*\n([\s\S]*?)```', 1) AS x FROM t)
    SELECT doc_id, md5(regexp_replace(regexp_replace(CASE WHEN len(x) > 0 THEN list_filter(x, lambda y: length(y) = list_max(list_transform(x, lambda z: length(z))))[1] ELSE reply END, '^[ \t\n\v\f\r]+', ''), '[ \t\n\v\f\r]+$', '')) AS code_md5 FROM f"""
)
def code_blocks(spark, sf):
    body = F.coalesce("text", F.lit(""))
    fenced = F.concat(F.lit("see ```py\n"), body, F.lit("\n``` or ```\n"), F.col("source"), F.lit("```"))
    reply = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), body, F.lit("\n"))).otherwise(fenced)
    return table(spark, sf, "documents").select("doc_id", F.md5(X.code_block(reply)).alias("code_md5"))


WRITTEN = ("%s", " %s ", "+%s", "-%s", "%s.", "NaN", "", "%se2", "1,2,%s", "(%s)")
SPELT = f"""a AS (SELECT o_orderkey AS k, o_orderpriority AS scope, replace({list(WRITTEN)!r}[o_orderkey % {len(WRITTEN)} + 1], '%s', CAST(o_custkey AS VARCHAR)) AS raw FROM orders),
    b AS (SELECT *, replace(trim(raw), ',', '') AS bare FROM a), v AS (SELECT *, CASE WHEN regexp_matches(bare, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN CAST(rtrim(ltrim(bare, '+'), '.') AS DECIMAL(38,2)) END AS value FROM b)"""


def _spelt(spark, sf):
    raw = F.replace(pick(F.col("o_orderkey"), *WRITTEN), F.lit("%s"), F.col("o_custkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("scope"), F.col("o_orderkey").cast("int").alias("row_index"), raw.alias("raw"))


@query(f"WITH {SPELT} SELECT k AS o_orderkey, value AS amount FROM v")
def amounts_parsed(spark, sf):
    return _spelt(spark, sf).select("o_orderkey", X.amount("raw").alias("amount"))


@query(
    f"""WITH {SPELT}, p AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY k) AS n FROM v WHERE trim(raw) <> '' AND value IS NULL),
    e AS (SELECT scope, count(*) AS bad, string_agg('row ' || k || ': credit ''' || raw || ''' is no amount', chr(10) ORDER BY k) FILTER (n <= 5) AS shown FROM p GROUP BY scope)
    SELECT DISTINCT 'values_parse' AS name, scope, CASE WHEN bad IS NULL THEN 'PASS' ELSE 'FAIL' END AS status, coalesce(bad, 0) || ' values are no amounts' AS detail, coalesce(shown || CASE WHEN bad > 5 THEN chr(10) || '... and ' || (bad - 5) || ' more' ELSE '' END, '') AS evidence FROM v LEFT JOIN e USING (scope)"""
)
def values_parse(spark, sf):
    raw = _spelt(spark, sf).withColumnRenamed("raw", "credit")
    return statement_checks.values_parse(raw.select("scope").distinct(), raw, ("credit",))


@query(
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity * 1.5 AS x0, l_linenumber * 2.5 AS top, l_extendedprice AS x1, l_discount * 1000 AS bottom, l_linenumber % 4 + 1 AS page FROM lineitem)
    SELECT l_orderkey, l_linenumber, 'p' || page || ' @ (' || CAST(round_even(x0, 0) AS BIGINT) || ',' || CAST(round_even(top, 0) AS BIGINT) || ')-(' || CAST(round_even(x1, 0) AS BIGINT) || ',' || CAST(round_even(bottom, 0) AS BIGINT) || ')' AS citation,
    CAST(page AS INTEGER) AS page, round_even(x0, 0) AS x0, round_even(x1, 0) AS x1 FROM c"""
)
def citations(spark, sf):
    l = table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    box = F.struct((n % 4 + 1).alias("page"), (F.col("l_quantity") * 1.5).alias("x0"), (n * 2.5).cast("double").alias("top"), F.col("l_extendedprice").cast("double").alias("x1"), (F.col("l_discount") * 1000).alias("bottom"))
    cited = l.select("l_orderkey", "l_linenumber", X.citation(box).alias("citation"))
    back = X.citation_parts(F.col("citation"))
    return cited.select("*", back["page"].alias("page"), back["x0"].alias("x0"), back["x1"].alias("x1"))


@query(
    """SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(38,2)) AS labelled, 'EUR ' || format('{:,.2f}', o_totalprice) AS shown, CASE WHEN o_custkey >= 60 THEN (o_custkey // 60) || 'm ' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') || 's' ELSE o_custkey || 's' END AS lasted,
    upper(left(o_orderpriority, 1)) || lower(replace(substr(o_orderpriority, 2), '_', ' ')) AS words FROM orders"""
)
def display_forms(spark, sf):
    o = table(spark, sf, "orders").withColumn("m", F.col("o_totalprice").cast("decimal(38,2)"))
    shown = X.money_text("m", F.lit("EUR"))
    return o.select("o_orderkey", X.money_label(shown).alias("labelled"), shown.alias("shown"), X.duration_text("o_custkey").alias("lasted"), X.code_words("o_orderpriority").alias("words"))


@query("SELECT o_orderkey, CASE WHEN d > 0 THEN format('{:,.2f}', d) || ' above' WHEN d < 0 THEN format('{:,.2f}', -d) || ' below' ELSE '0.00' END AS difference FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_totalprice - 150000 END AS d FROM orders)")
def differences_in_words(spark, sf):
    d = F.when(F.col("o_orderkey") % 7 == 0, F.lit(0).cast("decimal(20,2)")).otherwise((F.col("o_totalprice").cast("decimal(18,2)") - 150000).cast("decimal(20,2)"))
    return table(spark, sf, "orders").select("o_orderkey", review.direction_text(d).alias("difference"))


@query(
    r"""SELECT p_partkey, CASE WHEN trim(replace(regexp_replace(code, '^[^:]+:\s*', ''), '_', ' ')) = '' THEN 'Verification check' ELSE upper(left(trim(replace(regexp_replace(code, '^[^:]+:\s*', ''), '_', ' ')), 1)) || substr(trim(replace(regexp_replace(code, '^[^:]+:\s*', ''), '_', ' ')), 2) END AS label
    FROM (SELECT p_partkey, replace(['self: %s', 'a_b:%s_x', '%s', ':', '_', ''][p_partkey % 6 + 1], '%s', replace(p_name, ' ', '_')) AS code FROM part)"""
)
def check_labels(spark, sf):
    code = F.replace(pick(F.col("p_partkey"), "self: %s", "a_b:%s_x", "%s", ":", "_", ""), F.lit("%s"), F.replace("p_name", F.lit(" "), F.lit("_")))
    return table(spark, sf, "part").select("p_partkey", review.label_text(code).alias("label"))


# Checks


@query(
    """SELECT 'self:' || o_orderstatus AS name, o_orderpriority AS scope, CASE WHEN o_orderkey % 3 > 0 THEN 'PASS' ELSE 'FAIL' END AS status, substr(repeat('order ' || o_orderkey || ' ', o_orderkey % 30), 1, 120) AS detail, substr(repeat(CAST(o_custkey AS VARCHAR), o_orderkey % 200), 1, 400) AS evidence FROM orders"""
)
def self_claims(spark, sf):
    k = F.col("o_orderkey")
    claims = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("name"), F.col("o_orderpriority").alias("scope"), (k % 3 > 0).alias("holds"), F.repeat(F.concat(F.lit("order "), k, F.lit(" ")), (k % 30).cast("int")).alias("detail"), F.repeat(F.col("o_custkey").cast("string"), (k % 200).cast("int")).alias("evidence")
    )
    return generic_checks.self_claims(claims)


@query(
    f"""WITH {SIDES.replace("AS currency FROM orders", "AS currency, o_orderpriority AS scope, o_orderkey AS pos FROM orders")}, g AS (SELECT amount, balance, sum(a) AS ns, sum(b) AS nd, min(p) FILTER (a = 1) AS ps, min(p) FILTER (b = 1) AS pd FROM
      (SELECT amount, balance, 1 AS a, 0 AS b, row(scope, pos) AS p FROM s UNION ALL SELECT amount, balance, 0, 1, row(scope, pos) FROM d) GROUP BY amount, balance HAVING sum(a) <> sum(b)),
    x AS (SELECT *, abs(ns - nd) AS n, ns > nd AS lost, row_number() OVER (PARTITION BY ns > nd ORDER BY CASE WHEN ns > nd THEN ps ELSE pd END) AS k FROM g),
    y AS (SELECT lost, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) FILTER (k <= 5) AS BIGINT) AS seen, string_agg(amount || ' @ ' || balance || CASE WHEN n > 1 THEN ' x' || CAST(n AS BIGINT) ELSE '' END, '; ' ORDER BY k) FILTER (k <= 5) AS shown FROM x GROUP BY lost)
    SELECT 'FAIL' AS status, 'source ' || (SELECT count(*) FROM s) || ', derived ' || (SELECT count(*) FROM d) || '; ' || (SELECT total || ' dropped (' || shown || CASE WHEN total > seen THEN '; and ' || (total - seen) || ' more' ELSE '' END || ')' FROM y WHERE lost)
      || '; ' || (SELECT total || ' invented (' || shown || CASE WHEN total > seen THEN '; and ' || (total - seen) || ' more' ELSE '' END || ')' FROM y WHERE NOT lost) AS evidence"""
)
def universe_samples(spark, sf):
    o = table(spark, sf, "orders")
    v, k = F.col("o_totalprice").cast(MONEY), F.col("o_orderkey")
    place = F.col("o_orderpriority").alias("scope"), k.alias("row_index")
    source = o.select(v.alias("credit"), F.lit(None).cast(MONEY).alias("debit"), F.col("o_custkey").cast(MONEY).alias("balance"), *place)
    derived = o.where(k % 97 != 0).select(F.when(k % 89 == 0, v + 1).otherwise(v).cast(MONEY).alias("amount"), F.col("o_custkey").cast(MONEY).alias("balance"), *place)
    return corpus_checks.corpus_universe(source, derived).select("status", "evidence")


@query(f"WITH {ORDERS}, g AS (SELECT scope, k, count(*) AS n, sum(CASE WHEN d THEN amount ELSE -amount END) AS net FROM j GROUP BY scope, k) SELECT scope, CAST(k AS INTEGER) AS row_index, 'NON_FOOTING_BATCH' AS review_reason FROM g WHERE n < 2 OR abs(net) > 0.01")
def non_footing_batches(spark, sf):
    rows = order_rows(spark, sf).withColumn("page", F.lit(1))
    return emit.gated(rows, journal="journal_lines").where("NOT ready_for_export").select("scope", "row_index", "review_reason")


# Projections


OPEN = f"""{RESOLVED}, {REASON}, t AS (SELECT *, CASE WHEN k % 5 <> 0 THEN ' (similar)' ELSE '' END AS why, CASE WHEN raw <> '' THEN ', read ''' || raw || '''' ELSE '' END AS said, CASE WHEN k % 13 = 0 AND k % 11 <> 0 THEN 'Atlantis' ELSE name END AS shown FROM g WHERE reason IS NOT NULL)"""


@query(
    f"""WITH {OPEN} SELECT printf('%s-%03d', scope, row_index) AS row_id, lower(replace(reason, '_', ' ')) || CASE WHEN s IN ('MATCH', 'CANNOT_VERIFY') THEN '' ELSE '. counterparty_match is ' || s || said || why
      || CASE WHEN s = 'PROBABLE' AND shown <> '' THEN ', proposed ''' || shown || '''' || CASE WHEN k % 7 <> 0 THEN ' at ' || (k % 10) * 10 || '%' ELSE '' END ELSE '' END END || CASE WHEN ps <> 'MATCH' THEN '. project_status is ' || ps ELSE '' END || '.' AS explanation,
    CASE WHEN s IN ('MATCH', 'CANNOT_VERIFY') THEN '' ELSE 'counterparty_match' END || CASE WHEN s NOT IN ('MATCH', 'CANNOT_VERIFY') AND ps <> 'MATCH' THEN ',' ELSE '' END || CASE WHEN ps <> 'MATCH' THEN 'project_status' ELSE '' END AS open_fields FROM t"""
)
def review_explanations(spark, sf):
    return emit.review_queue(resolved_rows(spark, sf)).select("row_id", "explanation", F.array_join("open_fields", ",").alias("open_fields"))


@query(f"WITH {RESOLVED} SELECT scope, row_index, CASE WHEN k % 23 = 0 THEN NULL ELSE 1 END AS page, 'paid to Nation_' || CASE WHEN k % 19 = 0 THEN 'x' ELSE CAST(n AS VARCHAR) END AS snippet, CASE WHEN s = 'MATCH' AND name = '' AND k % 2 = 1 THEN 'ERROR' ELSE s END AS chip FROM r")
def row_citations(spark, sf):
    rows = resolved_rows(spark, sf)
    cited = emit.source_citation(rows)
    return rows.select("scope", "row_index", cited["page"].alias("page"), cited["snippet"].alias("snippet"), emit.match_chip(rows, "counterparty_match").alias("chip"))


@query(
    f"""WITH {RESOLVED}, {REASON} SELECT 'run-7' AS run_id, count(*) AS rows_out, CAST(12 AS BIGINT) AS rows_in, 'counterparty_match_pairing,resolution_completeness' AS checks_run, '[{{"name":"a.pdf","sha256":"00"}}]' AS inputs FROM g"""
)
def audit_trail(spark, sf):
    rows = resolved_rows(spark, sf)
    checks = generic_checks.run(rows, [{"check": "pairing", "field": "counterparty_match"}, {"check": "completeness", "fields": ["counterparty_match"]}])
    trail = emit.audit_trail(rows, checks, {"run_id": "run-7", "rows_in": 12, "input_documents": [{"name": "a.pdf", "sha256": "00"}]})
    return trail.select("run_id", "rows_out", "rows_in", F.array_join("checks_run", ",").alias("checks_run"), "inputs")


@query(
    f"""WITH {RESOLVED}, {REASON}, a AS (SELECT scope, count_if(k % 10 <> 0 AND reason IS NULL) AS clean, count_if(reason IS NULL) AS again FROM g GROUP BY scope)
    SELECT bool_and(scope <> 'FURNITURE') AS comparable, CAST(sum(clean) FILTER (scope <> 'FURNITURE') AS BIGINT) AS stated, CAST(sum(again) AS BIGINT) AS recomputed, CAST(CASE WHEN bool_and(scope <> 'FURNITURE') THEN sum(again) - sum(clean) END AS BIGINT) AS drift FROM a"""
)
def gate_drift(spark, sf):
    """Rows that state their gate, some of them wrongly, and one account that states nothing."""
    rows = emit.gated(resolved_rows(spark, sf))
    said = F.when(F.col("scope") == "FURNITURE", F.lit(None).cast("boolean")).when(F.col("row_index") % 10 == 0, False).otherwise(F.col("ready_for_export"))
    shown = emit.unified([rows.withColumn("ready_for_export", said)])
    per = emit.stated_clean(shown.withColumn("account", F.regexp_extract("id", "^(.*)-", 1)))
    return emit.gate_drift(per)


@query(
    f"""WITH {RESOLVED}, {REASON} SELECT printf('%s-%03d', scope, row_index) AS id, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DECIMAL(38,2)) AS amount, 'paid to Nation_' || CASE WHEN k % 19 = 0 THEN 'x' ELSE CAST(n AS VARCHAR) END AS narrative, raw AS counterparty_raw, s AS status, class AS classification, reason IS NULL AS ready, reason FROM g
    UNION ALL SELECT printf('%s-%03d', o_orderpriority, o_orderkey), CAST(o_totalprice AS DECIMAL(38,2)), '', '', '', '', o_orderkey % 2 = 0, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'HELD' END FROM orders"""
)
def console_rows(spark, sf):
    k = F.col("o_orderkey")
    envelope = table(spark, sf, "orders").select(
        F.format_string("%s-%03d", F.col("o_orderpriority"), k).alias("row_id"), k.alias("source_page"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount"), (k % 2 == 0).alias("ready_for_export"), F.when(k % 2 == 1, "HELD").alias("review_reason")
    )
    shown = emit.unified([resolved_rows(spark, sf), envelope])
    return shown.select("id", "amount", "narrative", "counterparty_raw", F.upper(X.normalise(F.col("counterparty.status"))).alias("status"), "classification", "ready", "reason")


@query(
    f'''WITH {RESOLVED} SELECT md5(concat_ws(',', '"' || scope || '"', '"' || row_index || '"', '"paid to Nation_' || CASE WHEN k % 19 = 0 THEN 'x' ELSE CAST(n AS VARCHAR) END || '"', '"a ""' || class || '"""', '""')) AS line_md5 FROM r'''
)
def csv_export_lines(spark, sf):
    rows = resolved_rows(spark, sf).withColumn("classification", F.concat(F.lit('a "'), "classification", F.lit('"')))
    return sinks.csv_lines(rows, ("scope", "row_index", "narrative", "classification", "post_date")).select(F.md5("value").alias("line_md5"))


# Score


@query(
    """WITH m AS (SELECT doc_id, source, quality, doc_id % 3 = 0 AS mine, doc_id % 4 <> 0 AS theirs FROM labels JOIN documents USING (doc_id))
    SELECT coalesce(CASE WHEN source IN ('src0', 'src1') THEN 'holdout' ELSE 'tune' END, 'all') AS split, count_if(mine AND theirs AND quality = 1) AS agree, count_if(mine AND theirs AND quality = 0) AS differ, count_if(mine AND NOT theirs) AS agent_only, count_if(NOT mine AND theirs) AS human_only FROM m GROUP BY 1
    UNION ALL SELECT 'all', count_if(mine AND theirs AND quality = 1), count_if(mine AND theirs AND quality = 0), count_if(mine AND NOT theirs), count_if(NOT mine AND theirs) FROM m"""
)
def score_matches(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    none, k = F.lit(""), F.col("doc_id")
    named = F.concat(F.lit("Name "), k)
    mine = F.struct(F.when(k % 3 == 0, "MATCH").otherwise("UNRESOLVED").alias("status"), F.when(k % 3 == 0, named).alias("matched_name"))
    agent = rows.select(F.col("source").alias("scope"), k.alias("balance"), none.alias("counterparty_raw"), mine.alias("counterparty_match"), F.struct(none.alias("status"), none.alias("matched_name")).alias("project_code_match"), none.alias("classification"))
    human = F.when(k % 4 == 0, "").when(F.col("quality") == 1, F.concat(F.lit("NAME  "), k)).otherwise("someone else")
    key = rows.select(k.alias("balance"), none.alias("counterparty_raw"), human.alias("counterparty_matched"), none.alias("project_matched"), none.alias("classification"), F.lit(1).alias("pos"))
    t = score.tally(score.compare(agent, score.answer_key(key, "pos")), ["src0", "src1"])
    return t.select("split", *[F.col(f"counterparty_matched_{c}").alias(c) for c in ("agree", "differ", "agent_only", "human_only")])


@query(
    """WITH n AS (SELECT conv_id, count(*) AS a, count(*) FILTER (turn > 0 OR conv_id % 3 > 0) AS b FROM conversations GROUP BY conv_id)
    SELECT conv_id, turn, CASE WHEN a = b THEN role || '!' END AS other FROM conversations JOIN n USING (conv_id)"""
)
def samples_by_position(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("scope"), F.col("turn").alias("row_index"), "role")
    other = c.where((F.col("row_index") > 0) | (F.col("scope").cast("bigint") % 3 > 0)).withColumn("role", F.concat("role", F.lit("!")))
    return score.samples_joined(c, other).select(F.col("scope").cast("bigint").alias("conv_id"), F.col("row_index").alias("turn"), F.get("_samples", F.lit(0))["role"].alias("other"))


@query(
    """WITH k AS (SELECT doc_id, doc_id // 2 AS key, quality FROM labels), t AS (SELECT key, arg_max(quality, doc_id) AS quality, max(doc_id) AS last FROM k GROUP BY key) SELECT CAST(key AS VARCHAR) AS balance, CAST(quality AS VARCHAR) AS label FROM t"""
)
def answer_key_last(spark, sf):
    none = F.lit("")
    staged = table(spark, sf, "labels").select(F.floor(F.col("doc_id") / 2).cast("bigint").alias("balance"), none.alias("counterparty_raw"), none.alias("counterparty_matched"), none.alias("project_matched"), F.col("quality").cast("string").alias("classification"), F.col("doc_id").alias("pos"))
    key = score.answer_key(staged, "pos")
    return key.select(F.col("balance").cast("decimal(38,0)").cast("string").alias("balance"), F.col("classification").alias("label"))


# Plans and runs


@query("SELECT p_partkey, p_size % 3 = 2 OR p_size % 3 = 0 AS available, CASE p_size % 3 WHEN 1 THEN 'gone,lost' ELSE '' END AS missing FROM part")
def answerable_questions(spark, sf):
    requires = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("nation"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("gone"), F.lit("region"), F.lit("lost")))
    asked = reference.answerable(table(spark, sf, "part").select("p_partkey", requires.alias("requires")), list(lists(spark, sf)))
    return asked.select("p_partkey", "available", F.array_join("missing", ",").alias("missing"))


@query(
    f"""WITH {RESOLVED}, c AS (SELECT scope, count_if((raw = '') <> (s = 'CANNOT_VERIFY')) > 0 AS bad FROM r GROUP BY scope)
    SELECT count_if(bad) AS broken, count(*) AS thin, count_if(bad) = 0 AND count(*) = 0 AS accepted, count_if(bad) = 0 AS accepted_last FROM c"""
)
def pass_accepted(spark, sf):
    rows = resolved_rows(spark, sf).withColumn("_samples", F.array(F.struct(F.lit("other").alias("classification"))))
    plan = [{"check": "pairing", "field": "counterparty_match"}, {"check": "agreement", "fields": ["classification"]}]
    p = profile.Pass("p", severity={"sample_agreement": "retry"})
    checks = generic_checks.run(rows, plan)
    last = profile.accepted(p, checks, last_attempt=True).select("broken", F.col("accepted").alias("accepted_last"))
    return profile.accepted(p, checks).join(last, "broken")


RUNS = """u AS (SELECT strftime(CAST(o_orderdate AS DATE), '%Y%m%d') || '-000000-' || o_orderkey AS run_id, o_orderkey % 3 > 0 AS has_trace, o_orderpriority AS account, CASE WHEN o_orderkey % 2 = 0 THEN 'p' ELSE 'q' END AS profile FROM orders)"""


def _runs(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-000000-"), k).alias("run_id"), (k % 3 > 0).alias("has_trace"), F.col("o_orderpriority").alias("account"), F.when(k % 2 == 0, "p").otherwise("q").alias("profile"))


@query(
    f"""WITH {RUNS} SELECT 'holds' AS asked, (SELECT run_id FROM u WHERE contains(run_id, '-000000-77') ORDER BY run_id DESC LIMIT 1) AS run_id UNION ALL SELECT 'starts', (SELECT run_id FROM u WHERE starts_with(run_id, '1995') OR contains(run_id, '1995') ORDER BY run_id DESC LIMIT 1)
    UNION ALL SELECT 'latest', (SELECT max(run_id) FROM u) UNION ALL SELECT 'exact', (SELECT run_id FROM u WHERE run_id LIKE '%-000000-7') UNION ALL SELECT 'default', (SELECT max(run_id) FROM u WHERE has_trace)"""
)
def run_picks(spark, sf):
    u = _runs(spark, sf)
    exact = runs.resolve(u.where("run_id LIKE '%-000000-7'"), "-000000-7")
    picks = {"holds": runs.resolve(u, "-000000-77"), "starts": runs.resolve(u, "1995"), "latest": runs.resolve(u, "latest"), "exact": exact, "default": runs.picked(u)}
    out = None
    for name, found in picks.items():
        part = found.select(F.lit(name).alias("asked"), "run_id")
        out = part if out is None else out.unionAll(part)
    return out


@query(f"WITH {RUNS} SELECT account, max(run_id) AS run_id FROM u WHERE profile = 'p' GROUP BY account")
def account_runs(spark, sf):
    return runs.accounts(_runs(spark, sf), "p").select("account", "run_id")


@query("SELECT CAST(o_custkey AS VARCHAR) AS run_id, string_agg(DISTINCT lower(o_orderstatus) || '_stage', ',' ORDER BY lower(o_orderstatus) || '_stage') AS stages FROM orders WHERE o_orderkey % 5 > 0 GROUP BY o_custkey")
def run_stages(spark, sf):
    name = F.concat(F.lower("o_orderstatus"), F.lit("_stage"), F.when(F.col("o_orderkey") % 5 > 0, "-attempt-2.md").otherwise("-notes.md"))
    found = runs.stages(table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("run_id"), name.alias("file")))
    return found.select("run_id", F.array_join("stages", ",").alias("stages"))


# Review


ROLE = ("SIDE_LETTER", "NAV_WORKBOOK", "INVESTOR_REGISTER", "INVESTOR_REGISTER", "LPA", "INVESTOR_REGISTER", "LPA", None)
PLACE = ("Section 3.1", "Sheet1!AF12", "row fee_base", "side_letter_filename", "see section 8.1", "INVESTOR_NAME", "section 3.1", None)


@query(f"SELECT o_orderkey, CAST([0, 1, 2, 3, 4, 5, 10, 10][o_orderkey % {len(ROLE)} + 1] AS INTEGER) AS priority FROM orders")
def evidence_ranks(spark, sf):
    e = table(spark, sf, "orders").select("o_orderkey", pick(F.col("o_orderkey"), *ROLE).alias("role"), pick(F.col("o_orderkey"), *PLACE).alias("locator"))
    return e.select("o_orderkey", review.evidence_priority(e).alias("priority"))


@query("SELECT DISTINCT p_type AS role FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_partkey % 50 = 1 AND p_size > 10)")
def missing_roles(spark, sf):
    p = table(spark, sf, "part")
    documents = p.where("p_partkey % 50 = 1").select(F.col("p_type").alias("role"), (F.col("p_size") > 10).alias("recognised"))
    return review.missing_roles(p.select(F.col("p_type").alias("role")).distinct(), documents)


@query(
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN c_custkey % 4 = 0 THEN 'REVIEWED' ELSE 'UNREVIEWED' END AS human_state, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 8 = 0 THEN 'old,' || c_mktsegment ELSE 'old' END AS notes, CASE WHEN c_custkey % 3 = 0 THEN 'MATCH' ELSE 'DISCREPANCY' END AS status FROM customer"""
)
def reviewed_findings(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    findings = c.select(k.alias("id"), F.lit(1).alias("version"), F.lit("UNREVIEWED").alias("human_state"), F.array(F.lit("old")).alias("notes"), F.when(k % 3 == 0, "MATCH").otherwise("DISCREPANCY").alias("status"))
    updates = c.where("c_custkey % 4 = 0").select(k.alias("id"), F.lit("REVIEWED").alias("state"), F.when(k % 8 == 0, F.col("c_mktsegment")).otherwise("  ").alias("note"))
    return review.reviewed(findings, updates).select("id", "version", "human_state", F.array_join("notes", ",").alias("notes"), "status")


OPEN_FINDINGS = "f AS (SELECT c_custkey AS id, ['DISCREPANCY', 'CANNOT_VERIFY', 'UNSUPPORTED', 'MATCH'][c_custkey % 4 + 1] AS status, CASE WHEN c_custkey % 5 = 0 THEN 'REVIEWED' ELSE 'UNREVIEWED' END AS human_state FROM customer)"


def _findings(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), pick(k, "DISCREPANCY", "CANNOT_VERIFY", "UNSUPPORTED", "MATCH").alias("status"), F.when(k % 5 == 0, "REVIEWED").otherwise("UNREVIEWED").alias("human_state"), F.lit(1).alias("version"))


@query(f"WITH {OPEN_FINDINGS} SELECT count_if(status <> 'MATCH' AND human_state = 'UNREVIEWED') AS pending_exceptions, count_if(status <> 'MATCH' AND human_state = 'UNREVIEWED') = 0 AS ready FROM f")
def review_ready(spark, sf):
    return review.ready(_findings(spark, sf))


@query(
    f"""WITH {OPEN_FINDINGS}, o AS (SELECT *, row_number() OVER (ORDER BY CASE status WHEN 'DISCREPANCY' THEN 0 WHEN 'CANNOT_VERIFY' THEN 1 WHEN 'UNSUPPORTED' THEN 2 ELSE 3 END, id) AS k FROM f)
    SELECT 'first' AS after, (SELECT id FROM o WHERE status <> 'MATCH' AND human_state = 'UNREVIEWED' ORDER BY k LIMIT 1) AS id UNION ALL SELECT '42', (SELECT id FROM o WHERE status <> 'MATCH' AND human_state = 'UNREVIEWED' AND k > (SELECT k FROM o WHERE id = 42) ORDER BY k LIMIT 1)
    UNION ALL SELECT '43', (SELECT id FROM o WHERE status <> 'MATCH' AND human_state = 'UNREVIEWED' ORDER BY k <= (SELECT k FROM o WHERE id = 43), k LIMIT 1)"""
)
def next_exceptions(spark, sf):
    f = _findings(spark, sf)
    part = lambda name, after: review.next_exception(f, after).select(F.lit(name).alias("after"), "id")
    return part("first", None).unionAll(part("42", 42)).unionAll(part("43", 43))


@query(f"WITH {OPEN_FINDINGS} SELECT id, status FROM f")
def exportable_findings(spark, sf):
    return review.exportable(_findings(spark, sf), 1).select("id", "status")


@query("SELECT p_partkey, unnest(['read', 'check', 'write']) AS stage, unnest([CASE WHEN p_size % 4 > 0 THEN 'complete' ELSE 'active' END, CASE WHEN p_size % 4 > 1 THEN 'complete' WHEN p_size % 4 = 1 THEN 'active' ELSE 'pending' END, CASE WHEN p_size % 4 > 2 THEN 'complete' WHEN p_size % 4 = 2 THEN 'active' ELSE 'pending' END]) AS state FROM part")
def review_progress(spark, sf):
    polls = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 4).alias("polls"))
    return review.progress(polls, ["read", "check", "write"]).select("p_partkey", "stage", "state")


# Sheets and coerced rows


@query("SELECT DISTINCT p_name AS Name, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END AS Kind FROM part WHERE p_size % 3 > 0 OR p_size % 2 = 1")
def cleaned_sheet(spark, sf):
    p, blank = table(spark, sf, "part"), F.col("p_size") % 3 == 0
    kind = F.when(F.col("p_size") % 2 == 0, "  ").otherwise(F.concat(F.lit("\t"), "p_type", F.lit("  ")))
    sheet = p.select(F.when(blank & (F.col("p_size") % 2 == 0), None).otherwise(F.replace("p_name", F.lit(" "), F.lit("  \n"))).alias(" Name "), kind.alias("Kind"), F.lit("padding").alias("_c2"), F.col("p_brand").alias("Brand"))
    return readers.list_table(sheet, ["NAME", "kind"]).distinct()


@query(f"WITH {SPELT} SELECT k AS o_orderkey, value AS credit, CASE WHEN trim(raw) <> '' AND value IS NULL THEN 'credit: ' || raw ELSE '' END AS problems, CASE WHEN k % 3 = 0 THEN 1 ELSE CAST(k % 9 AS INTEGER) END AS page FROM v")
def coerced_rows(spark, sf):
    k = F.col("o_orderkey")
    rows = _spelt(spark, sf).withColumnRenamed("raw", "credit").withColumn("page", F.when(k % 3 == 0, "none").otherwise((k % 9).cast("string")))
    return readers.coerced(rows, ("credit",)).select("o_orderkey", "credit", F.array_join("problems", ",").alias("problems"), "page")


@query("SELECT 'd_EUR_' || (o_orderkey // 3000) || '.pdf' AS doc, max((o_orderkey % 3000) // 30 + 1) AS pages, count(DISTINCT (o_orderkey % 3000) // 30) AS with_text FROM orders GROUP BY 1")
def page_counts(spark: SparkSession, sf: str):
    from ledgerloom.catalog import word_table

    pages = layout.page_texts(layout.lines(word_table(spark, sf)))
    return pages.groupBy("doc").agg(F.max("pages").cast("bigint").alias("pages"), F.count_if(F.length("text") > 0).alias("with_text"))
