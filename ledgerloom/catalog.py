"""Registered queries of the ledger operators: name -> Spark plan, name -> SQL twin.

The driver's tables stand in for ledgers: events are bank movements (one account per user), orders are rows with journal lines,
nations and parts are reference lists.  Faults are put in by rules on keys, so that checks have something to find.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import corpus_checks, emit, events, generic_checks, layout, ledger, reference, review, runs, score, statement_checks
from ledgerloom.schemas import MONEY

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Inputs


def account_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Statement rows from events: purchases and sign-ups are credits, the rest debits; balances run from the oldest."""
    e = table(spark, sf, "events")
    v = F.coalesce("value", F.lit(0)).cast("decimal(18,2)")
    signed = F.when(F.col("event_type").isin("purchase", "signup"), v).otherwise(-v).cast(MONEY)
    old, new = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = e.withColumn("amount", signed).withColumn("balance", F.sum("amount").over(old).cast(MONEY)).withColumn("row_index", (F.row_number().over(new) - 1).cast("int"))
    return e.select(
        F.col("user_id").cast("string").alias("scope"), "row_index", F.when(F.col("amount") > 0, F.col("amount")).alias("credit"), F.when(F.col("amount") < 0, F.col("amount")).alias("debit"),
        "balance", F.date_format("ts", "d MMM yyyy").alias("value_date"), F.to_date("ts").alias("day"), F.col("event_type").alias("trn_type"),
    )


LEDGER = """l AS (SELECT CAST(user_id AS VARCHAR) AS scope, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS INTEGER) AS row_index, a AS amount,
    CAST(sum(a) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DECIMAL(38,2)) AS balance, CAST(ts AS DATE) AS day
    FROM (SELECT *, CAST(CASE WHEN event_type IN ('purchase', 'signup') THEN v ELSE -v END AS DECIMAL(38,2)) AS a FROM (SELECT *, CAST(coalesce(value, 0) AS DECIMAL(18,2)) AS v FROM events)))"""


def account_statements(spark: SparkSession, sf: str) -> DataFrame:
    """Printed figures of the accounts: every third closing balance is 1.00 off, every fifth is missing; the last two days print openings."""
    rows = account_rows(spark, sf)
    newest = rows.groupBy("scope").agg(F.min_by("balance", "row_index").alias("newest"))
    k = F.col("scope").cast("int")
    closing = F.when(k % 5 == 0, F.lit(None).cast(MONEY)).when(k % 3 == 0, (F.col("newest") + 1).cast(MONEY)).otherwise(F.col("newest"))
    per_day = rows.groupBy("scope", "day", "value_date").agg(F.sum(statement_checks.movement()).alias("moved"))
    late = Window.partitionBy("scope").orderBy(F.desc("day"))
    days = per_day.withColumn("r", F.row_number().over(late)).withColumn("after", F.sum("moved").over(late)).where("r <= 2")
    fault = F.when((k % 4 == 0) & (F.col("r") == 2), F.lit(1)).otherwise(F.lit(0))
    opened = days.join(newest, "scope").groupBy("scope").agg(F.map_from_entries(F.collect_list(F.struct("value_date", (F.col("newest") - F.col("after") + fault).cast(MONEY).alias("v")))).alias("m"))
    empty = F.create_map().cast("map<string,decimal(38,2)>")
    return newest.join(opened, "scope").select("scope", closing.alias("closing_balance"), F.when(k % 7 == 0, empty).otherwise(F.col("m")).alias("printed_openings"))


def order_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as rows of one scope per priority, with two journal lines each; some lines are off, alone, or without a batch."""
    o = table(spark, sf, "orders")
    v, k = F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderkey")
    line = lambda amount, debit, name, batch: F.struct(batch.alias("batch"), amount.cast("string").alias("amount"), F.lit(debit).alias("is_debit"), name.alias("transaction_type"))
    batch = F.when(k % 101 == 0, F.lit("none")).otherwise(F.concat(F.lit("B"), k))
    booked = F.when(k % 89 == 0, F.lit("UNKNOWN")).otherwise(F.concat(F.lit("nation_"), k % 25))
    debit, credit = line(v, True, booked, batch), line(F.when(k % 97 == 0, v + 1).otherwise(v), False, F.lit("Nation_1"), batch)
    lines = F.when(k % 53 == 0, F.array(debit)).otherwise(F.array(debit, credit))
    return o.select(F.col("o_orderpriority").alias("scope"), F.col("o_orderkey").cast("int").alias("row_index"), v.cast("string").alias("amount"), F.when(k % 83 != 0, lines).alias("journal_lines"))


ORDERS = """o AS (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS v, o_orderkey AS k FROM orders),
    j AS (SELECT o_orderpriority AS scope, k, v AS amount, TRUE AS d, CASE WHEN k % 89 = 0 THEN 'UNKNOWN' ELSE 'nation_' || (k % 25) END AS t, 0 AS pos FROM o WHERE k % 83 <> 0
          UNION ALL SELECT o_orderpriority, k, CASE WHEN k % 97 = 0 THEN v + 1 ELSE v END, FALSE, 'Nation_1', 1 FROM o WHERE k % 83 <> 0 AND k % 53 <> 0)"""


def resolved_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as rows with resolutions against nations, of all kinds and with all faults."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    s = F.element_at(F.array(*[F.lit(x) for x in ("MATCH", "PROBABLE", "UNRESOLVED", "CANNOT_VERIFY", "match", "odd")]), (k % 6 + 1).cast("int"))
    name = F.when(k % 11 == 0, F.lit("")).when(k % 13 == 0, F.lit("Atlantis")).otherwise(F.concat(F.lit("nation_"), F.col("c_nationkey")))
    match = F.struct(s.alias("status"), name.alias("matched_name"), F.when(k % 2 == 0, "nation").otherwise("").alias("table"), F.when(k % 7 != 0, (k % 10) / 10).alias("confidence"), F.when(k % 5 != 0, F.lit("similar")).otherwise("").alias("why"))
    raw = F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("NATION_"), F.col("c_nationkey")))
    return c.select(
        F.col("c_mktsegment").alias("scope"), k.cast("int").alias("row_index"), match.alias("counterparty_match"), raw.alias("counterparty_raw"),
        F.when(k % 3 == 0, F.lit("UNRESOLVED")).otherwise("MATCH").alias("project_status"), F.when(k % 9 == 0, F.lit("Review")).when(k % 17 == 0, F.lit("")).otherwise(F.initcap("c_mktsegment")).alias("classification"),
        F.concat(F.lit("paid to Nation_"), F.when(k % 19 == 0, F.lit("x")).otherwise(F.col("c_nationkey").cast("string"))).alias("narrative"), F.when(k % 23 != 0, F.lit(1)).alias("page"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("credit"), F.when(F.col("c_acctbal") <= 0, F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("debit"),
        F.lit("EUR").alias("currency"),
    )


RESOLVED = """r AS (SELECT c_mktsegment AS scope, CAST(c_custkey AS INTEGER) AS row_index, c_custkey AS k, c_nationkey AS n,
    ['MATCH', 'PROBABLE', 'UNRESOLVED', 'CANNOT_VERIFY', 'MATCH', 'ODD'][c_custkey % 6 + 1] AS s,
    CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN 'atlantis' ELSE 'nation_' || c_nationkey END AS name,
    CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'NATION_' || c_nationkey END AS raw,
    CASE WHEN c_custkey % 9 = 0 THEN 'Review' WHEN c_custkey % 17 = 0 THEN '' ELSE upper(left(c_mktsegment, 1)) || lower(c_mktsegment[2:]) END AS class,
    CASE WHEN c_custkey % 3 = 0 THEN 'UNRESOLVED' ELSE 'MATCH' END AS ps, c_acctbal FROM customer)"""


def lists(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {"nation": table(spark, sf, "nation"), "region": table(spark, sf, "region"), "part": table(spark, sf, "part")}


def run_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a recorded trace, one run per user: the opening event, tools, output, attempts and what became of them, verdicts with checks."""
    i, t = F.col("event_id"), F.col("event_type")
    e = table(spark, sf, "events").withColumn("idx", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("bigint"))
    first, pick = F.col("idx") == 0, lambda *names: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
    kind = F.when(first, "state").when(t == "click", "tool").when(t == "view", pick("stdout", "stdout", "stderr")).when(t == "error", "verdict").otherwise("state")
    label = F.when(first, "starting").when(t == "click", pick("t0", "t1", "t2")).when(t == "signup", "attempt").when(t == "purchase", pick("accepted", "rejected", "exhausted", "rejected"))
    check = F.concat(F.lit('[{"name":"'), pick("c0", "c1", "c2"), F.lit('","status":"'), pick("PASS", "FAIL", "UNRESOLVED"), F.lit('"},{"name":"total","status":"'), pick("PASS", "PASS", "FAIL", "PASS", "PASS"), F.lit('"}]'))
    meta = F.map_from_arrays(
        F.array(*map(F.lit, ("passes", "stage", "rows", "checks"))),
        F.array(F.when(first, "s1, s9, s0"), F.when(~first & t.isin("signup", "purchase", "error"), pick("s0", "s1", "s2", "s3")), F.when(~first & t.isin("signup", "purchase"), (i % 7).cast("string")), F.when(~first & (t == "error"), check)),
    )
    return e.select(
        F.col("user_id").alias("run"), "idx", kind.alias("kind"), label.alias("label"), pick("running", "ok").alias("status"), F.col("props").alias("body"), meta.alias("meta"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("at"),
    )


EVENTS = """o AS (SELECT *, user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_id AS i, event_type AS t FROM events),
    p AS (SELECT run, idx, epoch_us(ts) / 1e6 AS sec, props AS body, ['running', 'ok'][i % 2 + 1] AS status,
    CASE WHEN idx = 0 THEN 'state' WHEN t = 'click' THEN 'tool' WHEN t = 'view' THEN ['stdout', 'stdout', 'stderr'][i % 3 + 1] WHEN t = 'error' THEN 'verdict' ELSE 'state' END AS kind,
    CASE WHEN idx = 0 THEN 'starting' WHEN t = 'click' THEN 't' || (i % 3) WHEN t = 'signup' THEN 'attempt' WHEN t = 'purchase' THEN ['accepted', 'rejected', 'exhausted', 'rejected'][i % 4 + 1] END AS label,
    CASE WHEN idx = 0 THEN 's1, s9, s0' END AS passes, CASE WHEN idx > 0 AND t IN ('signup', 'purchase', 'error') THEN 's' || (i % 4) END AS stage, CASE WHEN idx > 0 AND t IN ('signup', 'purchase') THEN i % 7 END AS "rows",
    CASE WHEN idx > 0 AND t = 'error' THEN '[{"name":"c' || (i % 3) || '","status":"' || ['PASS', 'FAIL', 'UNRESOLVED'][i % 3 + 1] || '"},{"name":"total","status":"' || CASE WHEN i % 5 = 2 THEN 'FAIL' ELSE 'PASS' END || '"}]' END AS checks FROM o),
    e AS (SELECT *, coalesce(len(list_filter(json_extract_string(checks, '$[*].status'), lambda x: x = 'PASS')), 0) AS n_pass, coalesce(len(list_filter(json_extract_string(checks, '$[*].status'), lambda x: x = 'FAIL')), 0) AS n_fail,
    coalesce(len(list_filter(json_extract_string(checks, '$[*].status'), lambda x: x = 'UNRESOLVED')), 0) AS n_unresolved FROM p)"""


# Statement checks


@query(
    f"""WITH {LEDGER}, n AS (SELECT *, lead(balance) OVER (PARTITION BY scope ORDER BY row_index) AS actual FROM l)
    SELECT scope, row_index, CAST(balance - amount AS DECIMAL(38,2)) AS expected, actual, balance - amount = actual AS holds, CAST(actual - (balance - amount) AS DECIMAL(38,2)) AS delta FROM n WHERE actual IS NOT NULL"""
)
def chain_links(spark, sf):
    return statement_checks.chain_links(account_rows(spark, sf)).select("scope", "row_index", "expected", "actual", "holds", "delta")


CHAIN = """n AS (SELECT *, lead(balance) OVER (PARTITION BY scope ORDER BY row_index) AS below FROM l), t AS (SELECT scope, count(*) - 1 AS links, count_if(below IS NOT NULL AND balance - amount <> below) AS broken FROM n GROUP BY scope)"""


@query(f"WITH {LEDGER}, {CHAIN} SELECT 'balance_chain' AS name, scope, CASE WHEN broken = 0 THEN 'PASS' ELSE 'FAIL' END AS status, (links - broken) || '/' || links || ' links hold' AS detail, CASE WHEN broken = 0 THEN '' END AS evidence FROM t")
def chain_summary(spark, sf):
    rows = account_rows(spark, sf)
    return statement_checks.balance_chain(rows.select("scope").distinct(), rows)


@query(
    f"""WITH {LEDGER}, c AS (SELECT scope, row_index, balance, CASE WHEN scope = '7' AND row_index = 2 THEN amount - 100 ELSE amount END AS amount FROM l),
    n AS (SELECT *, lead(balance) OVER (PARTITION BY scope ORDER BY row_index) AS nxt FROM c)
    SELECT scope, CASE WHEN count_if(nxt IS NOT NULL AND balance - amount <> nxt) = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
    (count(*) - 1 - count_if(nxt IS NOT NULL AND balance - amount <> nxt)) || '/' || (count(*) - 1) || ' links hold' AS detail FROM n GROUP BY scope"""
)
def chain_breaks_injected(spark, sf):
    rows = account_rows(spark, sf)
    return statement_checks.balance_chain(rows.select("scope").distinct(), statement_checks.corrupted(rows, "7", 2)).select("scope", "status", "detail")


CLOSING = "c AS (SELECT scope, arg_min(balance, row_index) AS newest FROM l GROUP BY scope)"


@query(
    f"""WITH {LEDGER}, {CLOSING}, p AS (SELECT scope, newest, CASE WHEN CAST(scope AS INT) % 5 = 0 THEN NULL WHEN CAST(scope AS INT) % 3 = 0 THEN CAST(newest + 1 AS DECIMAL(38,2)) ELSE newest END AS printed FROM c)
    SELECT scope, CASE WHEN printed IS NULL THEN 'UNRESOLVED' WHEN printed = newest THEN 'PASS' ELSE 'FAIL' END AS status,
    CASE WHEN printed IS NULL THEN 'the statement prints no closing balance' ELSE 'newest row ' || newest || ', printed ' || printed END AS detail,
    CASE WHEN printed <> newest THEN 'difference ' || CAST(newest - printed AS DECIMAL(38,2)) ELSE '' END AS evidence FROM p"""
)
def closing_balance(spark, sf):
    return statement_checks.closing_balance(account_statements(spark, sf), account_rows(spark, sf)).select("scope", "status", "detail", "evidence")


@query(
    f"""WITH {LEDGER}, d AS (SELECT scope, day, sum(amount) AS moved FROM l GROUP BY scope, day), r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY day DESC) AS r FROM d),
    k AS (SELECT scope, least(count(*), 2) AS k, count_if(r = 2 AND CAST(scope AS INT) % 4 = 0) AS bad FROM r WHERE r <= 2 GROUP BY scope)
    SELECT scope, CASE WHEN CAST(scope AS INT) % 7 = 0 THEN 'CANNOT_VERIFY' WHEN bad > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
    CASE WHEN CAST(scope AS INT) % 7 = 0 THEN 'no opening is printed' ELSE (k - bad) || '/' || k || ' printed openings follow from the movements' END AS detail FROM k"""
)
def printed_openings(spark, sf):
    return statement_checks.printed_openings(account_statements(spark, sf), account_rows(spark, sf)).select("scope", "status", "detail")


@query(
    r"""WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS scope, doc_id, len(regexp_extract_all(coalesce(text, ''), '\b\d{2}:\d{2}\b')) + n_chars % 3 AS seen FROM documents), r AS (SELECT *, seen - CASE WHEN doc_id % 5 = 0 AND seen > 0 THEN 1 ELSE 0 END AS n FROM t)
    SELECT scope, CASE WHEN n = seen THEN 'PASS' ELSE 'FAIL' END AS status, n || ' rows, ' || seen || ' times of day in the text' AS detail FROM r"""
)
def row_count_regex(spark, sf):
    """Texts with up to two times of day more, and as many rows as times, but for every fifth, which lost one."""
    d = table(spark, sf, "documents").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.repeat(F.lit("\n07:01 x"), (F.col("n_chars") % 3).cast("int"))))
    scope = F.col("doc_id").cast("string").alias("scope")
    s = d.select(scope, F.split("text", "\n").alias("page_text"))
    seen = d.select(scope, "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\b\d{2}:\d{2}\b"), F.lit(0))).alias("row_index", "time"))
    return statement_checks.row_count(s, seen.where("doc_id % 5 > 0 OR row_index > 0")).select("scope", "status", "detail")


@query(
    f"""WITH {LEDGER} SELECT scope, CASE WHEN count_if(amount = 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, (count(*) - count_if(amount = 0)) || '/' || count(*) || ' rows have one amount' AS detail FROM l GROUP BY scope"""
)
def one_amount_per_row(spark, sf):
    rows = account_rows(spark, sf)
    return statement_checks.one_amount_per_row(rows.select("scope").distinct(), rows).select("scope", "status", "detail")


@query(
    """WITH b AS (SELECT item_id, text AS passage FROM benchmark), n AS (SELECT count(*) AS n FROM benchmark),
    r AS (SELECT doc_id, text, (SELECT passage FROM b WHERE item_id = doc_id % (SELECT n FROM n)) AS passage FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS scope, CASE WHEN coalesce(passage, '') = '' OR contains(text, passage) THEN 'PASS' ELSE 'FAIL' END AS status FROM r"""
)
def reference_provenance(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("bank_reference"))
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = b.count()
    statements = d.select(F.col("doc_id").cast("string").alias("scope"), F.array("text").alias("page_text"))
    rows = d.withColumn("item_id", F.col("doc_id") % max(n, 1)).join(b, "item_id", "left").select(F.col("doc_id").cast("string").alias("scope"), F.lit(0).alias("row_index"), "bank_reference")
    return statement_checks.reference_provenance(statements, rows).select("scope", "status")


# Corpus reconciliation


def _sides(spark, sf):
    o = table(spark, sf, "orders")
    v, k = F.col("o_totalprice").cast(MONEY), F.col("o_orderkey")
    source = o.select(v.alias("credit"), F.lit(None).cast(MONEY).alias("debit"), F.col("o_custkey").cast(MONEY).alias("balance"), F.col("o_orderpriority").alias("currency"))
    derived = o.where(k % 97 != 0).select(F.when(k % 89 == 0, v + 1).otherwise(v).cast(MONEY).alias("amount"), F.col("o_custkey").cast(MONEY).alias("balance"), F.col("o_orderpriority").alias("currency"))
    return source, derived


SIDES = """s AS (SELECT CAST(o_totalprice AS DECIMAL(38,2)) AS amount, CAST(o_custkey AS DECIMAL(38,2)) AS balance, o_orderpriority AS currency FROM orders),
    d AS (SELECT CAST(CAST(o_totalprice AS DECIMAL(38,2)) + CASE WHEN o_orderkey % 89 = 0 THEN 1 ELSE 0 END AS DECIMAL(38,2)) AS amount, CAST(o_custkey AS DECIMAL(38,2)) AS balance, o_orderpriority AS currency FROM orders WHERE o_orderkey % 97 <> 0)"""


@query(f"WITH {SIDES} SELECT amount, balance, count(*) AS n FROM (SELECT amount, balance FROM s EXCEPT ALL SELECT amount, balance FROM d) GROUP BY amount, balance")
def universe_dropped(spark, sf):
    source, derived = _sides(spark, sf)
    return corpus_checks.dropped(corpus_checks.source_keys(source), corpus_checks.derived_keys(derived))


@query(f"WITH {SIDES} SELECT amount, balance, count(*) AS n FROM (SELECT amount, balance FROM d EXCEPT ALL SELECT amount, balance FROM s) GROUP BY amount, balance")
def universe_invented(spark, sf):
    source, derived = _sides(spark, sf)
    return corpus_checks.invented(corpus_checks.source_keys(source), corpus_checks.derived_keys(derived))


@query(
    f"""WITH {SIDES}, x AS (SELECT amount, balance FROM s EXCEPT ALL SELECT amount, balance FROM d), y AS (SELECT amount, balance FROM d EXCEPT ALL SELECT amount, balance FROM s)
    SELECT 'corpus_universe' AS name, CASE WHEN (SELECT count(*) FROM x) + (SELECT count(*) FROM y) = 0 THEN 'PASS' ELSE 'FAIL' END AS status"""
)
def universe_check(spark, sf):
    return corpus_checks.corpus_universe(*_sides(spark, sf)).select("name", "status")


@query(
    f"""WITH {SIDES}, t AS (SELECT (SELECT sum(amount) FROM s) AS a, (SELECT sum(amount) FROM d) AS b)
    SELECT 'corpus_aggregate' AS name, 'all' AS scope, CASE WHEN a = b THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN a = b THEN 'signed totals tie' ELSE 'signed totals do not tie' END AS detail,
    'source ' || a || ', derived ' || b || ', difference ' || (a - b) AS evidence FROM t"""
)
def aggregate_tie(spark, sf):
    return corpus_checks.corpus_aggregate(*_sides(spark, sf))


@query(
    f"""WITH {SIDES}, a AS (SELECT currency, sum(amount) AS a FROM s GROUP BY currency), b AS (SELECT currency, sum(amount) AS b FROM d GROUP BY currency)
    SELECT 'corpus_aggregate' AS name, currency AS scope, CASE WHEN a = b THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN a = b THEN 'signed totals tie' ELSE 'signed totals do not tie' END AS detail,
    'source ' || a || ', derived ' || b || ', difference ' || (a - b) AS evidence FROM a JOIN b USING (currency)"""
)
def aggregate_by_currency(spark, sf):
    return corpus_checks.corpus_aggregate(*_sides(spark, sf), by="currency")


@query(
    f"""WITH {ORDERS}, t AS (SELECT (SELECT CAST(sum(abs(v)) AS DECIMAL(38,2)) FROM o) AS m, (SELECT CAST(sum(amount) AS DECIMAL(38,2)) FROM j WHERE d) AS x, (SELECT CAST(sum(amount) AS DECIMAL(38,2)) FROM j WHERE NOT d) AS y)
    SELECT 'corpus_stage_tie' AS name, CASE WHEN m = x AND x = y THEN 'PASS' ELSE 'FAIL' END AS status, 'rows ' || m || ', debits ' || x || ', credits ' || y AS evidence FROM t"""
)
def stage_tie_corpus(spark, sf):
    rows = order_rows(spark, sf)
    keys = rows.withColumn("balance", F.lit(None).cast(MONEY))
    return corpus_checks.corpus_stage_tie(keys, rows.select(F.inline("journal_lines"))).select("name", "status", "evidence")


# Generic checks


@query(
    f"""WITH {ORDERS}, r AS (SELECT o_orderpriority AS scope, sum(abs(v)) AS m, count(*) AS n FROM o GROUP BY 1), l AS (SELECT scope, count(*) AS k, sum(amount) FILTER (d) AS x, sum(amount) FILTER (NOT d) AS y FROM j GROUP BY scope)
    SELECT scope, CASE WHEN abs(m - x) <= 0.01 AND abs(x - y) <= 0.01 THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN abs(m - x) <= 0.01 AND abs(x - y) <= 0.01 THEN k || ' lines tie to ' || n || ' rows' ELSE 'the lines do not tie to the rows' END AS detail
    FROM r JOIN l USING (scope)"""
)
def stage_tie_rows(spark, sf):
    return generic_checks.stage_tie(order_rows(spark, sf), {}).select("scope", "status", "detail")


@query(
    f"""WITH {ORDERS}, b AS (SELECT scope, k, count(*) AS n, sum(CASE WHEN d THEN amount ELSE -amount END) AS net FROM j GROUP BY scope, k),
    p AS (SELECT scope, CASE WHEN k % 101 = 0 THEN n ELSE 0 END + CASE WHEN n < 2 OR abs(net) > 0.01 THEN 1 ELSE 0 END AS bad FROM b)
    SELECT scope, CASE WHEN sum(bad) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) || ' batches, ' || CAST(sum(bad) AS BIGINT) || ' problems' AS detail FROM p GROUP BY scope"""
)
def double_entry_batches(spark, sf):
    return generic_checks.double_entry(order_rows(spark, sf), {}).select("scope", "status", "detail")


@query(
    f"""WITH {ORDERS} SELECT scope, CASE WHEN count_if(t = 'UNKNOWN') = 0 THEN 'PASS' ELSE 'FAIL' END AS status, (count(*) - count_if(t = 'UNKNOWN')) || '/' || count(*) || ' lines book to the chart' AS detail FROM j GROUP BY scope"""
)
def posting_unknown(spark, sf):
    return generic_checks.posting(order_rows(spark, sf), {"chart": ["nation:n_name"]}, lists(spark, sf)).select("scope", "status", "detail")


@query(
    f"""WITH {ORDERS}, b AS (SELECT scope, CASE WHEN k % 101 = 0 THEN '(row ' || k || ')' ELSE 'B' || k END AS batch, count(*) AS n, sum(CASE WHEN d THEN amount ELSE -amount END) AS net FROM j GROUP BY 1, 2)
    SELECT scope, bool_and(net BETWEEN -0.01 AND 0.01) AS ok, count(*) AS batches, count_if(net BETWEEN -0.01 AND 0.01) AS balanced FROM b GROUP BY scope"""
)
def batches_balance(spark, sf):
    return generic_checks.batches_balance(order_rows(spark, sf)).select("scope", "ok", F.col("batches").cast("bigint"), F.col("balanced").cast("bigint"))


@query(
    f"""WITH {RESOLVED}, p AS (SELECT *, CASE WHEN s = 'ODD' THEN 1 WHEN s IN ('MATCH', 'PROBABLE') AND (name = '' OR name = 'atlantis') THEN 1 ELSE 0 END AS bad FROM r)
    SELECT scope, CASE WHEN sum(bad) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count_if(s = 'MATCH') || ' MATCH, ' || count_if(s = 'PROBABLE') || ' PROBABLE, ' || count_if(s = 'UNRESOLVED') || ' UNRESOLVED, ' || count_if(s = 'CANNOT_VERIFY') || ' CANNOT_VERIFY' AS detail
    FROM p GROUP BY scope"""
)
def membership_pools(spark, sf):
    return generic_checks.membership(resolved_rows(spark, sf), {"field": "counterparty_match", "tables": ["nation:n_name", "region:r_name"]}, lists(spark, sf)).select("scope", "status", "detail")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 11 = 0 OR c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20)")
def membership_anti(spark, sf):
    c = table(spark, sf, "customer").withColumn("key", F.when(F.col("c_custkey") % 11 == 0, "").otherwise(F.concat(F.lit("NATION_"), "c_nationkey")))
    known = table(spark, sf, "nation").where("n_nationkey < 20")
    return c.join(reference.index(known, "n_name").withColumnRenamed("key", "k2"), X.fold("key") == F.col("k2"), "left_anti").select("c_custkey")


def _status_sql(bad: str, detail: str, status: str | None = None) -> str:
    return f"WITH {RESOLVED} SELECT scope, {status or f'''CASE WHEN count_if({bad}) = 0 THEN 'PASS' ELSE 'FAIL' END'''} AS status, {detail} AS detail FROM r GROUP BY scope"


@query(_status_sql("k % 19 = 0 AND raw <> ''", "(count_if(raw <> '') - count_if(k % 19 = 0 AND raw <> '')) || '/' || count_if(raw <> '') || ' values are in narrative'"))
def provenance(spark, sf):
    return generic_checks.provenance(resolved_rows(spark, sf), {"field": "counterparty_raw"}).select("scope", "status", "detail")


@query(_status_sql("class = '' OR class = 'Review'", "(count(*) - count_if(class = '' OR class = 'Review')) || '/' || count(*) || ' rows have a known classification'"))
def vocabulary(spark, sf):
    return generic_checks.vocabulary(resolved_rows(spark, sf), {"field": "classification", "allowed": ["Automobile", "BUILDING", "Furniture", "Machinery", "Household"]}).select("scope", "status", "detail")


@query(_status_sql("s = 'ODD'", "(2 * count(*) - count_if(s = 'ODD')) || '/' || (2 * count(*)) || ' resolutions have a status'"))
def completeness(spark, sf):
    return generic_checks.completeness(resolved_rows(spark, sf), {"fields": ["counterparty_match", "project_status"]}).select("scope", "status", "detail")


@query(_status_sql("(raw = '') <> (s = 'CANNOT_VERIFY')", "(count(*) - count_if((raw = '') <> (s = 'CANNOT_VERIFY'))) || '/' || count(*) || ' rows agree with counterparty_raw'"))
def pairing(spark, sf):
    return generic_checks.pairing(resolved_rows(spark, sf), {"field": "counterparty_match"}).select("scope", "status", "detail")


@query(_status_sql("", "count_if(class = 'Review') || '/' || count(*) || ' rows are ''review'' (' || CAST(round_even(count_if(class = 'Review') * 100.0 / count(*), 0) AS BIGINT) || '%)'", "'PASS'"))
def label_rate(spark, sf):
    return generic_checks.label_rate(resolved_rows(spark, sf), {"field": "classification", "label": "Review"}).select("scope", "status", "detail")


@query(
    _status_sql(
        "", "(count_if(s <> 'CANNOT_VERIFY') - count_if(s = 'UNRESOLVED')) || '/' || count_if(s <> 'CANNOT_VERIFY') || ' resolved, ' || count_if(s = 'UNRESOLVED') || ' not (' || CAST(round_even(count_if(s = 'UNRESOLVED') * 100.0 / count_if(s <> 'CANNOT_VERIFY'), 0) AS BIGINT) || '%)'", "'PASS'"
    )
)
def resolution_rate(spark, sf):
    return generic_checks.resolution_rate(resolved_rows(spark, sf), {"field": "counterparty_match"}).select("scope", "status", "detail")


@query(
    _status_sql(
        "s = 'PROBABLE' AND (k % 5 = 0 OR k % 7 = 0 OR k % 10 = 0)",
        "(count_if(s = 'PROBABLE') - count_if(s = 'PROBABLE' AND k % 5 = 0) - count_if(s = 'PROBABLE' AND (k % 7 = 0 OR k % 10 = 0))) || '/' || count_if(s = 'PROBABLE') || ' proposals have a reason and a confidence'",
    )
)
def proposals(spark, sf):
    return generic_checks.proposals(resolved_rows(spark, sf), {"field": "counterparty_match"}).select("scope", "status", "detail")


@query(
    """WITH c AS (SELECT conv_id, turn, upper(trim(role)) AS role, upper(trim(lead(role) OVER (PARTITION BY conv_id ORDER BY turn))) AS other FROM conversations)
    SELECT CAST(conv_id AS VARCHAR) AS scope, CASE WHEN count(other) = 0 THEN 'CANNOT_VERIFY' WHEN count_if(role <> other) = 0 THEN 'PASS' ELSE 'UNRESOLVED' END AS status FROM c GROUP BY conv_id"""
)
def agreement(spark, sf):
    c = table(spark, sf, "conversations")
    nxt = F.lead(F.struct("role")).over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = c.select(F.col("conv_id").cast("string").alias("scope"), F.col("turn").cast("int").alias("row_index"), "role", F.when(nxt.isNotNull(), F.array(nxt)).alias("_samples"))
    return generic_checks.agreement(rows, {"fields": ["role"]}).select("scope", "status")


@query(
    """WITH q AS (SELECT CAST(n_regionkey AS VARCHAR) AS scope, n_nationkey AS k FROM nation),
    p AS (SELECT scope, CASE WHEN k % 5 = 0 THEN 1 WHEN k % 2 = 0 THEN (CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END) WHEN k % 3 = 0 THEN 1 ELSE 0 END AS bad FROM q)
    SELECT scope, CASE WHEN sum(bad) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, (count(*) - CAST(sum(bad) AS BIGINT)) || '/' || count(*) || ' answers explain themselves' AS detail FROM p GROUP BY scope"""
)
def explanation(spark, sf):
    k = F.col("n_nationkey")
    rows = table(spark, sf, "nation").select(
        F.col("n_regionkey").cast("string").alias("scope"), k.alias("row_index"), F.col("n_name").alias("id"), F.when(k % 5 == 0, "").when(k % 2 == 0, "cannot_verify").otherwise("YES").alias("verdict"),
        F.when(k % 3 == 0, "").otherwise("no table").alias("because"), F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("ledger"))).alias("missing"),
        F.struct(F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("add"))).alias("steps"), F.array(F.lit("orders")).alias("inputs")).alias("explanation"),
    )
    return generic_checks.explanation(rows, {}).select("scope", "status", "detail")


# Text, lookup, candidates


@query(r"SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS normalised_md5 FROM documents")
def normalise_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.normalise("text")).alias("normalised_md5"))


FOLD = r"replace(lower(strip_accents(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))), 'ß', 'ss')"


@query(f"SELECT doc_id, md5({FOLD}) AS folded_md5 FROM documents")
def fold_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.fold("text")).alias("folded_md5"))


@query(rf"SELECT doc_id, md5(regexp_replace({FOLD}, '[^\p{{L}}\p{{N}}]', '', 'g')) AS compact_md5 FROM documents")
def compact_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.compact("text")).alias("compact_md5"))


@query(
    """WITH p AS (SELECT p_partkey, p_name || ', ' || p_type || ',' || p_brand AS v FROM part), a AS (SELECT p_partkey, [v, trim(regexp_replace(replace(v, ',', ' '), ' +', ' ', 'g')), replace(v, ', ', ''), replace(v, ',', '')] AS x FROM p)
    SELECT p_partkey, x[1] AS as_written, CASE WHEN x[2] <> x[1] THEN x[2] END AS spaced, len(list_distinct(x)) AS n FROM a"""
)
def variants_text(spark, sf):
    v = table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(", "), "p_type", F.lit(","), "p_brand").alias("v")).withColumn("x", X.variants("v"))
    return v.select("p_partkey", F.get("x", F.lit(0)).alias("as_written"), F.get("x", F.lit(1)).alias("spaced"), F.size("x").cast("bigint").alias("n"))


@query("SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) IN ('red', 'hot') THEN split_part(p_name, ' ', 1) ELSE p_name || ' Co. of ' || p_type END AS trimmed FROM (SELECT * FROM part WHERE split_part(p_name, ' ', 2) NOT IN ('red', 'hot')) UNION ALL SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) IN ('red', 'hot') THEN split_part(p_name, ' ', 1) ELSE p_name END FROM part WHERE split_part(p_name, ' ', 2) IN ('red', 'hot')")
def trim_to_text(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.trim_to(F.concat("p_name", F.lit(" Co. of "), "p_type"), ["RED.", "hot"]).alias("trimmed"))


@query("SELECT p_partkey FROM part WHERE lower(p_type) IN ('economy', 'promo') AND p_partkey % 3 <> 0")
def lookup_exact(spark, sf):
    p = table(spark, sf, "part").withColumn("v", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("  "), F.lower("p_type"))))
    known = p.sparkSession.createDataFrame([("Economy",), ("PROMO",), (" ",)], "kind string")
    return reference.contains(p, "v", known, "kind").select("p_partkey")


@query(
    """WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'NATION_' || s_nationkey || '.' WHEN s_suppkey % 4 = 1 THEN 'nat, ion_' || s_nationkey WHEN s_suppkey % 4 = 2 THEN 'Nation ' || s_nationkey ELSE 'nobody' END AS v, s_suppkey % 4 AS k, s_nationkey FROM supplier)
    SELECT s_suppkey, CASE WHEN k = 3 THEN NULL ELSE 'NATION_' || s_nationkey END AS matched_name, CASE WHEN k = 3 THEN NULL ELSE 'nation' END AS "table" FROM s"""
)
def lookup_priority(spark, sf):
    k, n = F.col("s_suppkey") % 4, F.col("s_nationkey")
    v = F.when(k == 0, F.concat(F.lit("NATION_"), n, F.lit("."))).when(k == 1, F.concat(F.lit("nat, ion_"), n)).when(k == 2, F.concat(F.lit("Nation "), n)).otherwise("nobody")
    rows = table(spark, sf, "supplier").select("s_suppkey", v.alias("v"))
    return reference.lookup(rows, "v", [("region", "r_name"), ("nation", "n_name")], lists(spark, sf)).select("s_suppkey", "matched_name", "table")


WEIGHTS = """e AS (SELECT DISTINCT 0 AS pool, p_name AS entry FROM part UNION ALL SELECT DISTINCT 1, p_type FROM part), w AS (SELECT DISTINCT pool, entry, unnest(string_split(lower(entry), ' ')) AS word FROM e),
    n AS (SELECT count(*) AS n FROM e), d AS (SELECT word, count(*) AS df FROM w GROUP BY word), x AS (SELECT word, df, n, ln((n + 1) / CAST(df + 1 AS DOUBLE)) AS weight FROM d, n)"""


@query(f"WITH {WEIGHTS} SELECT word, df, n, CAST(round(weight, 6) AS DOUBLE) AS weight FROM x")
def idf_weights(spark, sf):
    w = reference.word_weights(reference.entries([("part", "p_name"), ("part", "p_type")], lists(spark, sf)))
    return w.select("word", "df", F.col("n").cast("bigint"), F.round("weight", 6).alias("weight"))


@query(
    f"""WITH {WEIGHTS}, q AS (SELECT DISTINCT p_name || ' ' || p_type AS value FROM part), m AS (SELECT DISTINCT value, unnest(string_split(lower(value), ' ')) AS word FROM q), t AS (SELECT value, sum(weight) AS mine FROM m JOIN x USING (word) GROUP BY value),
    z AS (SELECT pool, entry, sum(weight) AS theirs FROM w JOIN x USING (word) GROUP BY pool, entry), c AS (SELECT value, pool, entry, sum(weight) AS shared FROM m JOIN w USING (word) JOIN x USING (word) GROUP BY value, pool, entry),
    s AS (SELECT value, pool, entry, round_even(least(shared / mine, shared / theirs), 3) AS score FROM c JOIN t USING (value) JOIN z USING (pool, entry)),
    r AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY score DESC, pool, entry) AS rank FROM s) SELECT value, CAST(rank AS BIGINT) AS rank, entry AS matched_name, score FROM r WHERE rank <= 5"""
)
def candidates_topk(spark, sf):
    rows = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("v"))
    return reference.candidates(rows, "v", [("part", "p_name"), ("part", "p_type")], lists(spark, sf)).select("value", F.col("rank").cast("bigint").alias("rank"), "matched_name", "score")


@query()
def close_matches(spark, sf):
    rows = table(spark, sf, "part").select(F.concat("p_name", F.lit("s")).alias("v"))
    return reference.close_matches(rows, "v", table(spark, sf, "part"), "p_name")


@query("SELECT p_partkey, upper(left(p_name, 2)) || ', ' || upper(p_name[3:]) AS span FROM part")
def narrative_span(spark, sf):
    name = F.upper("p_name")
    told = F.concat(F.lit("PAID TO ("), F.substring(name, 1, 2), F.lit(", "), F.substring(name, 3, 100), F.lit(") today"))
    return table(spark, sf, "part").select("p_partkey", reference.narrative_span(told, F.col("p_name")).alias("span"))


# Projections and gate

REASON = """g AS (SELECT *, CASE WHEN k % 23 = 0 THEN 'MISSING_SOURCE_CITATION' WHEN s NOT IN ('MATCH', 'CANNOT_VERIFY') THEN 'COUNTERPARTY_UNRESOLVED' WHEN ps <> 'MATCH' THEN 'PROJECT_UNRESOLVED' WHEN class = 'Review' THEN 'LOW_CLASSIFICATION_CONFIDENCE' END AS reason FROM r)"""


@query(f"WITH {RESOLVED} SELECT field, status, count(*) AS n FROM (SELECT 'counterparty_match' AS field, s AS status FROM r UNION ALL SELECT 'project_status', ps FROM r UNION ALL SELECT 'position_match', 'MISSING' FROM r) GROUP BY field, status")
def mapping_summary(spark, sf):
    return emit.mapping_summary(resolved_rows(spark, sf), ["position_match"])


@query(f"WITH {RESOLVED}, {REASON} SELECT printf('%s-%03d', scope, row_index) AS row_id, reason, CASE WHEN k % 23 = 0 THEN NULL ELSE 1 END AS page, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DECIMAL(38,2)) AS amount FROM g WHERE reason IS NOT NULL")
def review_queue(spark, sf):
    return emit.review_queue(resolved_rows(spark, sf)).select("row_id", "reason", "page", "amount")


@query(f"WITH {RESOLVED}, {REASON} SELECT scope, reason IS NULL AS ready, count(*) AS n FROM g GROUP BY 1, 2")
def export_split(spark, sf):
    rows = resolved_rows(spark, sf)
    spec = {"id": "@derive:row_id", "scope": "$scope"}
    good, bad = emit.export_candidates(rows, spec), emit.blocked_exports(rows, spec)
    both = good.select("scope", F.lit(True).alias("ready")).unionAll(bad.select("scope", F.lit(False)))
    return both.groupBy("scope", "ready").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {RESOLVED}, {REASON} SELECT printf('%s-%03d', scope, row_index) AS id, CASE WHEN c_acctbal > 0 THEN 'credit' ELSE 'debit' END AS direction, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DECIMAL(38,2)) AS amount, s AS party, 'bank' AS kind, 'run-1' AS run_id,
    'EUR' AS currency, reason IS NULL AS ready FROM g"""
)
def row_projection(spark, sf):
    rows = resolved_rows(spark, sf)
    spec = {"id": "@derive:row_id", "direction": "@derive:direction", "amount": "@derive:signed_amount", "party": "@status:counterparty_match", "kind": "bank", "run_id": "@run_id", "currency": "$currency", "ready": "@derive:ready_for_export"}
    return rows.select(*emit.projection(rows, spec, {"run_id": "run-1"}))


@query(f"WITH {ORDERS} SELECT printf('%s-%03d', scope, k) AS row_id, CASE WHEN k % 101 = 0 THEN 'none' ELSE 'B' || k END AS batch, CAST(amount AS VARCHAR) AS amount, d AS is_debit, t AS transaction_type FROM j")
def journal_flatten(spark, sf):
    return emit.journal_entries(order_rows(spark, sf).where("journal_lines IS NOT NULL"))


@query(
    f"""WITH {ORDERS}, b AS (SELECT CASE WHEN k % 101 = 0 THEN 'none' ELSE 'B' || k END AS batch, amount, d FROM j)
    SELECT batch, CAST(coalesce(sum(amount) FILTER (d), 0) AS DECIMAL(38,2)) AS debits, CAST(coalesce(sum(amount) FILTER (NOT d), 0) AS DECIMAL(38,2)) AS credits, count(*) AS n_lines,
    abs(coalesce(sum(amount) FILTER (d), 0) - coalesce(sum(amount) FILTER (NOT d), 0)) < 0.005 AS balanced FROM b GROUP BY batch"""
)
def journal_panel(spark, sf):
    return emit.journal_panel(emit.journal_entries(order_rows(spark, sf).where("journal_lines IS NOT NULL")))


@query(
    f"""WITH {RESOLVED}, {REASON}, {LEDGER}, {CHAIN} SELECT count(*) AS "rows", count_if(reason IS NULL) AS ready_for_export, count_if(reason IS NOT NULL) AS needs_review, (SELECT count_if(broken = 0) FROM t) AS pass, (SELECT count_if(broken > 0) FROM t) AS fail FROM g"""
)
def summary_tally(spark, sf):
    rows = account_rows(spark, sf)
    return emit.summary(resolved_rows(spark, sf), statement_checks.balance_chain(rows.select("scope").distinct(), rows)).select("rows", "ready_for_export", "needs_review", "pass", "fail")


@query("WITH g AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'x' ELSE 'e' END AS w FROM orders) SELECT count(*) AS source, count_if(w = 'e') AS exported, count_if(w = 'x') AS exceptions, count(*) = count_if(w = 'e') + count_if(w = 'x') AS holds FROM g")
def conserved_rows(spark, sf):
    o = table(spark, sf, "orders")
    return emit.conserved(o, o.where("o_orderkey % 10 <> 0"), o.where("o_orderkey % 10 = 0"))


# Score


@query(
    """WITH m AS (SELECT d.source AS scope, l.doc_id AS balance, l.quality AS mine, CASE WHEN l.doc_id % 10 = 0 THEN NULL ELSE CASE WHEN l.doc_id % 4 = 0 THEN 1 - l.quality ELSE l.quality END END AS theirs FROM labels l JOIN documents d USING (doc_id)),
    s AS (SELECT CASE WHEN scope IN ('src0', 'src1') THEN 'holdout' ELSE 'tune' END AS split, * FROM m)
    SELECT coalesce(split, 'all') AS split, count(*) AS "rows", count(theirs) AS joined, count_if(theirs IS NULL) AS unjoined, count_if(mine = theirs) AS agree, count_if(mine <> theirs) AS differ FROM s GROUP BY GROUPING SETS ((split), ())"""
)
def score_by_split(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    none = F.lit("")
    mine = rows.select(F.col("source").alias("scope"), F.col("doc_id").alias("balance"), none.alias("counterparty_raw"), F.struct(none.alias("status"), none.alias("matched_name")).alias("counterparty_match"), F.struct(none.alias("status"), none.alias("matched_name")).alias("project_code_match"), F.col("quality").cast("string").alias("classification"))
    label = F.when(F.col("doc_id") % 4 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).cast("string")
    staged = rows.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("balance"), none.alias("counterparty_raw"), none.alias("counterparty_matched"), F.lit("Flag for review").alias("project_matched"), label.alias("classification"), F.lit(1).alias("pos"))
    t = score.tally(score.compare(mine, score.answer_key(staged, "pos")), ["src0", "src1"])
    return t.select("split", "rows", "joined", "unjoined", F.col("classification_agree").alias("agree"), F.col("classification_differ").alias("differ"))


# Events and runs


@query(f"WITH {EVENTS} SELECT run, kind, status, count(*) AS n FROM e GROUP BY run, kind, status")
def event_tally(spark, sf):
    return events.tally(run_events(spark, sf))


@query(
    f"""WITH {EVENTS}, g AS (SELECT *, sec - lag(sec) OVER w AS gap, sec - first_value(sec) OVER w AS elapsed, max(CASE WHEN kind = 'tool' THEN idx END) OVER (PARTITION BY run ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM e WINDOW w AS (PARTITION BY run ORDER BY idx))
    SELECT g.run, g.idx, round(gap, 3) AS gap, round(elapsed, 3) AS elapsed, CASE WHEN gap >= 3 AND x.status = 'running' THEN x.label END AS in_flight FROM g LEFT JOIN e x ON x.run = g.run AND x.idx = g.f"""
)
def event_gaps(spark, sf):
    return events.gaps(run_events(spark, sf)).select("run", "idx", F.round("gap", 3).alias("gap"), F.round("elapsed", 3).alias("elapsed"), "in_flight")


ISLANDS = """s AS (SELECT *, CASE WHEN kind IN ('stdout', 'stderr') AND coalesce(lag(kind) OVER (PARTITION BY run ORDER BY idx), '') NOT IN ('stdout', 'stderr') THEN 1 ELSE 0 END AS st FROM e),
    i AS (SELECT * FROM (SELECT *, CAST(sum(st) OVER (PARTITION BY run ORDER BY idx) AS BIGINT) AS island FROM s) WHERE kind IN ('stdout', 'stderr'))"""


@query(f"""WITH {EVENTS}, {ISLANDS} SELECT run, island, min(idx) AS "first", max(idx) AS "last", count(*) AS n FROM i GROUP BY run, island""")
def event_islands(spark, sf):
    return events.islands(run_events(spark, sf))


@query(
    f"""WITH {EVENTS}, {ISLANDS}, l AS (SELECT run, island, idx, kind, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM i),
    r AS (SELECT *, row_number() OVER (PARTITION BY run, island ORDER BY idx DESC, pos DESC) AS k FROM l WHERE trim(line) <> '')
    SELECT run, island, count(*) AS n_lines, count_if(kind = 'stderr') AS n_errors, string_agg(line, '~' ORDER BY k DESC) FILTER (k <= 8) AS tail, max(line) FILTER (k = 1) AS "last" FROM r GROUP BY run, island"""
)
def output_folds(spark, sf):
    return events.folded_output(run_events(spark, sf)).withColumn("tail", F.array_join("tail", "~"))


@query(f"WITH {EVENTS} SELECT run, arg_max(coalesce(stage, ''), idx) AS failed_stage FROM e WHERE kind = 'state' AND label = 'exhausted' GROUP BY run")
def failed_stages(spark, sf):
    return events.failed_stage(run_events(spark, sf))


@query(f"WITH {EVENTS}, g AS (SELECT *, coalesce(sec - lag(sec) OVER (PARTITION BY run ORDER BY idx), 0.0) AS gap FROM e) SELECT run, idx, round(least(gap * 0.35, 1.2) / 2, 6) AS delay, round(least(gap / 2, 1.2), 6) AS cli_delay FROM g")
def replay_delay(spark, sf):
    return events.replay(run_events(spark, sf), 2.0).select("run", "idx", F.round("delay", 6).alias("delay"), F.round("cli_delay", 6).alias("cli_delay"))


@query(
    f"""WITH {EVENTS}, a AS (SELECT run, idx, kind, n_pass, n_fail, n_unresolved, stage AS own, count_if(kind = 'state' AND label = 'attempt') OVER w AS attempts,
    last_value(CASE WHEN kind = 'state' AND "rows" <> 0 THEN "rows" END IGNORE NULLS) OVER w AS "rows", last_value(CASE WHEN kind = 'state' THEN stage END IGNORE NULLS) OVER w AS stage FROM e WINDOW w AS (PARTITION BY run ORDER BY idx)),
    d AS (SELECT *, n_pass - coalesce(lag(n_pass) OVER v, 0) AS dp, n_fail - coalesce(lag(n_fail) OVER v, 0) AS df FROM a WINDOW v AS (PARTITION BY run, kind = 'verdict', coalesce(own, stage) ORDER BY idx))
    SELECT run, idx, CAST(attempts AS BIGINT) AS attempts, CAST("rows" AS BIGINT) AS "rows", stage, CAST(sum(n_pass) OVER w AS BIGINT) AS all_pass, CAST(sum(n_fail) OVER w AS BIGINT) AS all_fail, CAST(sum(n_unresolved) OVER w AS BIGINT) AS all_unresolved,
    CAST(sum(dp) OVER w AS BIGINT) AS latest_pass, CAST(sum(df) OVER w AS BIGINT) AS latest_fail FROM d WINDOW w AS (PARTITION BY run ORDER BY idx)"""
)
def running_score(spark, sf):
    return events.running_score(run_events(spark, sf)).select("run", "idx", "attempts", "rows", "stage", "all_pass", "all_fail", "all_unresolved", "latest_pass", "latest_fail")


@query(
    f"""WITH {EVENTS}, m AS (SELECT *, count_if(label = 'attempt') OVER (PARTITION BY run, stage ORDER BY idx) AS n FROM e WHERE kind = 'state' AND stage IS NOT NULL),
    y AS (SELECT run, stage, n, coalesce(arg_max(CASE label WHEN 'accepted' THEN 'ok' ELSE 'bad' END, idx) FILTER (label IN ('accepted', 'rejected')), 'live') AS outcome FROM m WHERE n > 0 GROUP BY run, stage, n),
    z AS (SELECT run, stage, string_agg(outcome, ',' ORDER BY n) AS outcomes, count(*) AS attempts, count_if(outcome = 'bad') AS bad FROM y GROUP BY run, stage),
    g AS (SELECT run, stage, arg_max(label, idx) AS last, min(idx) AS first FROM m GROUP BY run, stage),
    k AS (SELECT run, unnest(['s1', 's9', 's0']) AS stage, unnest([0, 1, 2]) AS k FROM e WHERE idx = 0)
    SELECT run, stage, row_number() OVER (PARTITION BY run ORDER BY k NULLS LAST, first) AS position, CASE last WHEN 'accepted' THEN 'done' WHEN 'exhausted' THEN 'failed' ELSE CASE WHEN last IS NULL THEN 'seen' ELSE 'current' END END AS state,
    coalesce(outcomes, '') AS outcomes, coalesce(attempts, 0) AS attempts, coalesce(bad, 0) AS bad FROM k FULL JOIN g USING (run, stage) LEFT JOIN z USING (run, stage)"""
)
def stage_states(spark, sf):
    found = events.stage_states(run_events(spark, sf))
    return found.select("run", "stage", F.col("position").cast("bigint").alias("position"), "state", F.array_join("outcomes", ",").alias("outcomes"), F.col("attempts").cast("bigint").alias("attempts"), F.col("bad").cast("bigint").alias("bad"))


@query(
    f"""WITH {EVENTS} SELECT run, count(*) AS events, round(arg_max(sec, idx) - arg_min(sec, idx), 3) AS elapsed, CAST(arg_max("rows", idx) FILTER (kind = 'state' AND "rows" <> 0) AS BIGINT) AS "rows", count_if(kind = 'state' AND label = 'attempt') AS attempts,
    CAST(sum(n_pass) AS BIGINT) AS passed, CAST(sum(n_fail) AS BIGINT) AS failed, CAST(sum(n_unresolved) AS BIGINT) AS unresolved, coalesce(any_value(run % 2 = 0) FILTER (run % 3 > 0), sum(n_fail) = 0) AS won FROM e GROUP BY run"""
)
def closing_card(spark, sf):
    e = run_events(spark, sf)
    finished = e.select("run").distinct().where("run % 3 > 0").select(F.col("run").alias("run_id"), (F.col("run") % 2 == 0).alias("accepted"))
    return events.closing_card(e, finished).withColumn("elapsed", F.round("elapsed", 3))


@query(
    f"""WITH {EVENTS} SELECT run, 'check' AS what, 'c1' AS name, max(idx) AS idx FROM e WHERE list_contains(json_extract_string(checks, '$[*].name'), 'c1') GROUP BY run
    UNION ALL SELECT run, 'stage', stage, min(idx) FROM e WHERE kind = 'state' AND label = 'attempt' AND stage IS NOT NULL GROUP BY run, stage"""
)
def jump_targets(spark, sf):
    return events.jump_targets(run_events(spark, sf), "c1")


@query(f"WITH {EVENTS} SELECT run, md5(string_agg(props, '' ORDER BY idx)) AS text_md5 FROM (SELECT e.*, props FROM e JOIN (SELECT user_id, event_id, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) x ON e.run = x.user_id AND e.idx = x.i) WHERE run % 7 > 0 GROUP BY run")
def reassembled_text(spark, sf):
    e = run_events(spark, sf)
    told = F.sum(F.length("props")) + F.when(F.col("user_id") % 7 == 0, 1).otherwise(0)  # every seventh run lost a character on its way
    totals = table(spark, sf, "events").groupBy(F.col("user_id").alias("run"), "user_id").agg(told.alias("total")).drop("user_id")
    return events.reassembled(e, totals).where("complete").select("run", F.md5("text").alias("text_md5"))


@query(
    """WITH RECURSIVE d AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, coalesce(props, '') AS body FROM events),
    s AS (SELECT run, i, body AS held, 0 AS flush, length(body) >= 250 AS full FROM d WHERE i = 1
          UNION ALL SELECT d.run, d.i, CASE WHEN s.full THEN d.body ELSE s.held || d.body END, s.flush + CAST(s.full AS INTEGER),
                           length(CASE WHEN s.full THEN d.body ELSE s.held || d.body END) >= 250 FROM s JOIN d ON d.run = s.run AND d.i = s.i + 1),
    l AS (SELECT run, max(i) AS i FROM d GROUP BY run)
    SELECT s.run, CAST(flush AS INTEGER) AS flush, held AS body FROM s JOIN l ON s.run = l.run WHERE s.full OR (s.i = l.i AND held <> '')"""
)
def throttled_text(spark, sf):
    return events.throttled(run_events(spark, sf))


@query(
    """WITH r AS (SELECT strftime(CAST(o_orderdate AS DATE), '%Y%m%d') || '-000000' AS batch, o_orderstatus FROM orders)
    SELECT batch, count_if(o_orderstatus = 'F') AS accepted, count_if(o_orderstatus = 'O') AS rejected, count(*) AS total FROM r GROUP BY batch"""
)
def batch_runs(spark, sf):
    o = table(spark, sf, "orders")
    accepted = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    return runs.by_batch(o.select(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-000000-"), "o_orderkey").alias("run_id"), accepted.alias("accepted")))


# Review


def _fees(spark, sf):
    c = table(spark, sf, "customer")
    base = F.col("c_acctbal").cast("decimal(20,2)")
    exact = F.round(base * F.lit("0.005").cast("decimal(10,4)"), 2)
    return c.select(F.col("c_custkey").alias("id"), base.alias("base"), F.lit("2.0").cast("decimal(10,4)").alias("rate"), F.when(F.col("c_custkey") % 8 == 0, exact + 1).otherwise(exact).cast("decimal(20,2)").alias("administrator"), F.lit(1).alias("version"), F.lit("DONE").alias("human_state"))


FEES = """f AS (SELECT c_custkey AS id, CAST(c_acctbal AS DECIMAL(18,2)) AS base FROM customer), x AS (SELECT id, base * 0.005 AS expected, round(base * 0.005, 2) + CASE WHEN id % 8 = 0 THEN 1 ELSE 0 END AS admin FROM f)"""


@query(f"WITH {FEES} SELECT id, CAST(expected AS DECIMAL(30,8)) AS expected, CAST(abs(admin - expected) AS DECIMAL(30,8)) AS difference, CASE WHEN abs(admin - expected) < 0.005 THEN 'MATCH' ELSE 'DISCREPANCY' END AS status, 2 AS version FROM x")
def fee_recompute(spark, sf):
    return review.recomputed(_fees(spark, sf)).select("id", "expected", "difference", "status", "version")


@query(f"WITH {FEES}, s AS (SELECT CASE WHEN abs(admin - expected) < 0.005 THEN 'MATCH' ELSE 'DISCREPANCY' END AS status FROM x) SELECT status, count(*) AS n, count(*) AS pending FROM s GROUP BY status")
def finding_counts(spark, sf):
    return review.counts(review.recomputed(_fees(spark, sf)))


FILES = ("%s NAV.xlsx", "%s nav.pdf", "%s_LPA_2024.pdf", "Side-Letter %s.docx", "Investor %s.csv", "register %s.pdf", "%s navigator.csv", "Partnership Agreement %s.PDF", "administrator %s.xlsx", "lpa %s.docx", "input %s.XLSX")


@query(
    f"""WITH f AS (SELECT p_partkey, lower(replace({list(FILES)!r}[p_partkey % {len(FILES)} + 1], '%s', p_name)) AS n FROM part),
    g AS (SELECT p_partkey, CASE WHEN regexp_matches(n, '[.](xlsx|csv)$') AND regexp_matches(n, '\\bnav\\b|administrator') THEN 'NAV_WORKBOOK' WHEN n LIKE '%.pdf' AND regexp_matches(n, '(^|[^a-z0-9])lpa([^a-z0-9]|$)|partnership.agreement') THEN 'LPA'
    WHEN regexp_matches(n, 'side.?letter') THEN 'SIDE_LETTER' WHEN regexp_matches(n, '[.](xlsx|csv)$') AND regexp_matches(n, 'investor|register|input') THEN 'INVESTOR_REGISTER' ELSE 'SUPPORTING' END AS role FROM f)
    SELECT p_partkey, role, role <> 'SUPPORTING' AS recognised FROM g"""
)
def role_guess(spark, sf):
    shape = F.element_at(F.array(*map(F.lit, FILES)), (F.col("p_partkey") % len(FILES) + 1).cast("int"))
    role = review.role_guess(F.replace(shape, F.lit("%s"), F.col("p_name")))
    return table(spark, sf, "part").select("p_partkey", role.alias("role")).withColumn("recognised", review.recognised("role"))


@query(
    """WITH f AS (SELECT p_partkey, p_name || CASE WHEN p_partkey % 5 = 0 THEN '.exe' ELSE '.pdf' END AS name, CAST(p_size AS BIGINT) * 600000 AS bytes FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY name, bytes ORDER BY p_partkey) AS k FROM f)
    SELECT p_partkey, CASE WHEN name LIKE '%.exe' THEN 'EXTENSION' WHEN bytes > 26214400 THEN 'SIZE' WHEN k > 1 THEN 'DUPLICATE' END AS problem FROM k"""
)
def upload_problems(spark, sf):
    p = table(spark, sf, "part")
    files = p.select("p_partkey", F.col("p_partkey").alias("position"), F.concat("p_name", F.when(F.col("p_partkey") % 5 == 0, ".exe").otherwise(".pdf")).alias("name"), (F.col("p_size").cast("bigint") * 600000).alias("bytes"))
    return review.accepted_files(files).select("p_partkey", "problem")


# Reports that the documents describe


@query("SELECT n_name AS entity, l_returnflag AS account, CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE -CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DECIMAL(38,2)) AS net, count(*) AS n_lines FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2")
def movements_rec(spark, sf):
    l = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"), (F.col("l_linestatus") == "F").alias("is_debit"))
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return ledger.movements(l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("n_name").alias("entity"), F.col("l_returnflag").alias("account"), "amount", "is_debit"))


@query("SELECT l_suppkey, CAST(sum(abs(CAST(l_extendedprice AS DECIMAL(18,2)))) AS DECIMAL(38,2)) AS exposure, count(*) AS n_lines FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0) GROUP BY l_suppkey")
def mapping_gaps_ranked(spark, sf):
    l = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    return ledger.mapping_gaps(l, table(spark, sf, "supplier").where("s_suppkey % 3 <> 0").withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey")


@query("WITH m AS (SELECT n_nationkey AS key, n_name AS target, 2 AS priority FROM nation UNION ALL SELECT n_nationkey, 'X_' || n_name, 1 FROM nation WHERE n_nationkey % 4 = 0), b AS (SELECT key, arg_min(target, priority) AS target FROM m GROUP BY key) SELECT s_suppkey, target FROM supplier LEFT JOIN b ON s_nationkey = key")
def crosswalk_override(spark, sf):
    n = table(spark, sf, "nation")
    rules = n.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("target"), F.lit(2).alias("priority")).unionAll(n.where("n_nationkey % 4 = 0").select("n_nationkey", F.concat(F.lit("X_"), "n_name"), F.lit(1)))
    return ledger.crosswalk(table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "key"), rules, "key").select("s_suppkey", "target")


@query("WITH t AS (SELECT o_orderpriority AS p, o_custkey AS c, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS amount FROM orders GROUP BY 1, 2), s AS (SELECT *, amount / sum(amount) OVER (PARTITION BY p) AS share FROM t) SELECT p AS o_orderpriority, c AS o_custkey, CAST(amount AS DECIMAL(38,2)) AS amount, CAST(share AS DOUBLE) > 0.002 AS \"over\" FROM s")
def concentration_share(spark, sf):
    h = table(spark, sf, "orders").select("o_orderpriority", "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    return ledger.concentration(h, "o_custkey", 0.002, "o_orderpriority").select("o_orderpriority", "o_custkey", "amount", "over")


# Layout


def word_table(spark: SparkSession, sf: str) -> DataFrame:
    """Words laid out from orders: thirty rows a page, with tops that waver within a line."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    parts = [("o_orderkey", 40), ("o_orderpriority", 190), ("o_orderstatus", 330), ("o_totalprice", 470)]
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("text"), F.lit(float(x)).alias("x0")) for i, (c, x) in enumerate(parts)])
    w = o.select(k, F.inline(cells))
    top = (k % 30) * 14.0 + ((k + F.col("i")) % 4) * 0.3
    return w.select(F.concat(F.lit("d_EUR_"), F.floor(k / 3000), F.lit(".pdf")).alias("doc"), (F.floor((k % 3000) / 30) + 1).cast("int").alias("page"), F.col("text"), F.col("x0"), (F.col("x0") + 30).alias("x1"), top.alias("top"), (top + 8).alias("bottom"), k.alias("k"))


@query("SELECT 'd_EUR_' || (o_orderkey // 3000) || '.pdf' AS doc, CAST((o_orderkey % 3000) // 30 + 1 AS INTEGER) AS page, CAST(dense_rank() OVER (PARTITION BY o_orderkey // 30 ORDER BY o_orderkey) - 1 AS INTEGER) AS line, o_orderkey AS order_key FROM orders")
def line_groups(spark, sf):
    lined = layout.lines(word_table(spark, sf))
    first = layout.between(lined, 39.0, 41.0)
    return first.select("doc", "page", "line", F.col("text").cast("bigint").alias("order_key"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS order_key, o_orderpriority AS priority, o_orderstatus AS status FROM orders")
def cell_bands(spark, sf):
    lined = layout.lines(word_table(spark, sf))
    names = spark.createDataFrame([("key", 0, 30.0, 180.0), ("priority", 1, 180.0, 320.0), ("status", 2, 320.0, 460.0), ("price", 3, 460.0, float("inf"))], "name string, k int, lo double, hi double")
    pages = lined.select("doc", "page").distinct()
    bands = pages.withColumn("b", F.array(*[F.struct(F.lit(r["name"]).alias("name"), F.lit(r["k"]).alias("k"), F.lit(r["lo"]).alias("lo"), F.lit(r["hi"]).alias("hi")) for r in names.collect()])).select("doc", "page", F.inline("b"))
    c = layout.cells(lined, bands).groupBy("doc", "page", "line").pivot("name", ["key", "priority", "status"]).agg(F.first("value"))
    return c.select(F.col("key").alias("order_key"), "priority", "status")
