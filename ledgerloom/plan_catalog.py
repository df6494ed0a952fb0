"""Registered queries of whole check plans, with evidence: what a run of all checks says of every scope, and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.catalog import LEDGER, ORDERS, RESOLVED, account_rows, account_statements, lists, order_rows, query, resolved_rows
from ledgerloom.operators import generic_checks, statement_checks
from ledgerloom.schemas import MONEY

#: From problems ``p(name, scope, row_index, ord, problem)`` and check rows ``c(name, scope, status, detail)`` to checks with evidence.
EVIDENCE = """k AS (SELECT *, row_number() OVER (PARTITION BY name, scope ORDER BY row_index, ord, problem) AS k, count(*) OVER (PARTITION BY name, scope) AS total FROM p),
    v AS (SELECT name, scope, string_agg(problem, chr(10) ORDER BY k) FILTER (k <= 5) || CASE WHEN max(total) > 5 THEN chr(10) || '... and ' || (max(total) - 5) || ' more' ELSE '' END AS evidence FROM k GROUP BY name, scope),
    b AS (SELECT name, scope, count(*) AS bad FROM p GROUP BY name, scope)"""

PLAN = [
    {"check": "provenance", "field": "counterparty_raw"}, {"check": "membership", "field": "counterparty_match", "tables": ["nation:n_name", "region:r_name"]},
    {"check": "resolution_rate", "field": "counterparty_match"}, {"check": "pairing", "field": "counterparty_match"}, {"check": "completeness", "fields": ["counterparty_match", "project_status"]},
    {"check": "vocabulary", "field": "classification", "allowed": ["Automobile", "BUILDING", "Furniture", "Machinery", "Household"]}, {"check": "proposals", "field": "counterparty_match"},
    {"check": "label_rate", "field": "classification", "label": "Review"},
]


@query(
    f"""WITH {RESOLVED}, x AS (SELECT *, CASE WHEN k % 13 = 0 AND k % 11 <> 0 THEN 'Atlantis' ELSE name END AS shown, CASE WHEN k % 2 = 0 THEN 'nation' ELSE 'any pool' END AS pool FROM r),
    p AS (SELECT 'counterparty_raw_provenance' AS name, scope, row_index, 0 AS ord, 'row ' || k || ': ''' || raw || ''' is not in narrative' AS problem FROM x WHERE raw <> '' AND k % 19 = 0
      UNION ALL SELECT 'counterparty_match_membership', scope, row_index, 0, 'row ' || k || CASE WHEN s = 'ODD' THEN ': status ''ODD'' is unknown' WHEN name = '' THEN ': ' || s || ' names nothing' ELSE ': ' || s || ' on ''' || shown || ''', which is not in ' || pool END
        FROM x WHERE s = 'ODD' OR (s IN ('MATCH', 'PROBABLE') AND name IN ('', 'atlantis'))
      UNION ALL SELECT 'counterparty_match_pairing', scope, row_index, 0, 'row ' || k || ': ' || s || ' although counterparty_raw is ' || CASE WHEN raw = '' THEN 'empty' ELSE '''' || raw || '''' END FROM x WHERE (raw = '') <> (s = 'CANNOT_VERIFY')
      UNION ALL SELECT 'resolution_completeness', scope, row_index, 0, 'row ' || k || ': no status for counterparty_match' FROM x WHERE s = 'ODD'
      UNION ALL SELECT 'classification_vocabulary', scope, row_index, 0, 'row ' || k || CASE WHEN class = '' THEN ': no classification' ELSE ': ''Review'' is no classification' END FROM x WHERE class IN ('', 'Review')
      UNION ALL SELECT 'counterparty_match_proposals', scope, row_index, 0, 'row ' || k || ': a proposal without a reason' FROM x WHERE s = 'PROBABLE' AND k % 5 = 0
      UNION ALL SELECT 'counterparty_match_proposals', scope, row_index, 1, 'row ' || k || CASE WHEN k % 7 = 0 THEN ': a proposal without a confidence' ELSE ': confidence 0.0 is not between 0 and 1' END FROM x WHERE s = 'PROBABLE' AND (k % 7 = 0 OR k % 10 = 0)), {EVIDENCE},
    l AS (SELECT name, scope, 'rows ' || string_agg(k, ', ' ORDER BY k) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY name, scope ORDER BY k) AS i FROM
      (SELECT 'counterparty_match_resolution_rate' AS name, scope, k, 12 AS most FROM x WHERE s = 'UNRESOLVED' UNION ALL SELECT 'classification_review_rate', scope, k, 10 FROM x WHERE class = 'Review')) WHERE i <= most GROUP BY name, scope),
    n AS (SELECT scope, count(*) AS n, count_if(raw <> '') AS claimed, count_if(s = 'MATCH') AS a, count_if(s = 'PROBABLE') AS b, count_if(s = 'UNRESOLVED') AS c, count_if(s = 'CANNOT_VERIFY') AS d, count_if(class = 'Review') AS hits FROM x GROUP BY scope),
    c AS (SELECT name, n.scope, coalesce(bad, 0) AS bad, CASE WHEN coalesce(bad, 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CASE name WHEN 'counterparty_raw_provenance' THEN (claimed - coalesce(bad, 0)) || '/' || claimed || ' values are in narrative'
        WHEN 'counterparty_match_membership' THEN a || ' MATCH, ' || b || ' PROBABLE, ' || c || ' UNRESOLVED, ' || d || ' CANNOT_VERIFY' WHEN 'counterparty_match_pairing' THEN (n - coalesce(bad, 0)) || '/' || n || ' rows agree with counterparty_raw'
        WHEN 'resolution_completeness' THEN (2 * n - coalesce(bad, 0)) || '/' || (2 * n) || ' resolutions have a status' WHEN 'classification_vocabulary' THEN (n - coalesce(bad, 0)) || '/' || n || ' rows have a known classification'
        WHEN 'counterparty_match_proposals' THEN (b - coalesce(bad, 0)) || '/' || b || ' proposals have a reason and a confidence'
        WHEN 'counterparty_match_resolution_rate' THEN (n - d - c) || '/' || (n - d) || ' resolved, ' || c || ' not (' || CAST(round_even(c * 100.0 / (n - d), 0) AS BIGINT) || '%)' ELSE hits || '/' || n || ' rows are ''review'' (' || CAST(round_even(hits * 100.0 / n, 0) AS BIGINT) || '%)' END AS detail
      FROM n CROSS JOIN (SELECT unnest(['counterparty_raw_provenance', 'counterparty_match_membership', 'counterparty_match_pairing', 'resolution_completeness', 'classification_vocabulary', 'counterparty_match_proposals', 'counterparty_match_resolution_rate', 'classification_review_rate']) AS name)
      LEFT JOIN b USING (name, scope))
    SELECT name, scope, status, detail, coalesce(v.evidence, l.evidence, '') AS evidence FROM c LEFT JOIN v USING (name, scope) LEFT JOIN l USING (name, scope)"""
)
def check_plan(spark: SparkSession, sf: str) -> DataFrame:
    return generic_checks.run(resolved_rows(spark, sf), PLAN, lists(spark, sf))


@query(
    f"""WITH {ORDERS}, g AS (SELECT scope, k, CASE WHEN k % 101 = 0 THEN '(row ' || k || ')' ELSE 'B' || k END AS batch, count(*) AS n, sum(CASE WHEN d THEN amount ELSE -amount END) AS net FROM j GROUP BY scope, k),
    p AS (SELECT 'double_entry' AS name, scope, k AS row_index, unnest(range(0, n)) AS ord, 'row ' || k || ': a line has no batch id' AS problem FROM g WHERE k % 101 = 0
      UNION ALL SELECT 'double_entry', scope, k, 10, 'batch ' || batch || CASE WHEN n < 2 THEN ' has one line' ELSE ' nets to ' || CAST(net AS DECIMAL(38,6)) END FROM g WHERE n < 2 OR abs(net) > 0.01
      UNION ALL SELECT 'posting', scope, k, pos, 'row ' || k || ': ''UNKNOWN'' is not in the chart' FROM j WHERE t = 'UNKNOWN'), {EVIDENCE},
    m AS (SELECT o_orderpriority AS scope, count(*) AS n, sum(abs(v)) AS m FROM o GROUP BY 1), y AS (SELECT scope, count(*) AS k, sum(amount) FILTER (d) AS debits, sum(amount) FILTER (NOT d) AS credits FROM j GROUP BY scope),
    z AS (SELECT *, abs(m - debits) <= 0.01 AND abs(debits - credits) <= 0.01 AS ties FROM m JOIN y USING (scope)), q AS (SELECT scope, count(*) AS batches FROM g GROUP BY scope)
    SELECT 'double_entry' AS name, scope, CASE WHEN coalesce(bad, 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, batches || ' batches, ' || coalesce(bad, 0) || ' problems' AS detail, coalesce(evidence, '') AS evidence
      FROM q LEFT JOIN (SELECT * FROM b WHERE name = 'double_entry') b USING (scope) LEFT JOIN (SELECT * FROM v WHERE name = 'double_entry') v USING (scope)
    UNION ALL SELECT 'posting', scope, CASE WHEN coalesce(bad, 0) = 0 THEN 'PASS' ELSE 'FAIL' END, (k - coalesce(bad, 0)) || '/' || k || ' lines book to the chart', coalesce(evidence, '')
      FROM y LEFT JOIN (SELECT * FROM b WHERE name = 'posting') b USING (scope) LEFT JOIN (SELECT * FROM v WHERE name = 'posting') v USING (scope)
    UNION ALL SELECT 'stage_tie', scope, CASE WHEN ties THEN 'PASS' ELSE 'FAIL' END, CASE WHEN ties THEN k || ' lines tie to ' || n || ' rows' ELSE 'the lines do not tie to the rows' END,
      'rows ' || format('{{:,.2f}}', CAST(m AS DOUBLE)) || ', debits ' || format('{{:,.2f}}', CAST(debits AS DOUBLE)) || ', credits ' || format('{{:,.2f}}', CAST(credits AS DOUBLE)) FROM z"""
)
def journal_check_plan(spark: SparkSession, sf: str) -> DataFrame:
    return generic_checks.run(order_rows(spark, sf), [{"check": "double_entry"}, {"check": "posting", "chart": ["nation:n_name"]}, {"check": "stage_tie"}], lists(spark, sf))


def printed_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Statements with their text and rows with references, some changed, some misspelt, for all six checks."""
    rows, k = account_rows(spark, sf), F.col("scope").cast("int")
    written = F.when(k % 9 == 0, "Q Q").when(k % 9 == 1, "ab").when(k % 9 == 2, "A B").otherwise("R")
    off = (k % 10 == 7) & (F.col("row_index") == 2)
    less = lambda c: F.when(off, (F.col(c) - 100).cast(MONEY)).otherwise(F.col(c)).alias(c)
    rows = rows.select("scope", "row_index", less("credit"), less("debit"), "balance", "value_date", F.when(F.col("row_index") < 7, written).otherwise("").alias("bank_reference"))
    n = rows.groupBy("scope").agg(F.count(F.lit(1)).cast("int").alias("n"))
    page = F.concat(F.repeat(F.lit("07:01 R "), F.col("n") + F.when(k % 6 == 0, 1).otherwise(0)), F.lit("AB"))
    return account_statements(spark, sf).join(n, "scope").withColumn("page_text", F.array(page)).drop("n"), rows


@query(
    f"""WITH {LEDGER}, a AS (SELECT *, CAST(scope AS INT) AS s, CASE WHEN CAST(scope AS INT) % 10 = 7 AND row_index = 2 AND amount <> 0 THEN amount - 100 ELSE amount END AS moved FROM l),
    e AS (SELECT *, CAST(balance - moved AS DECIMAL(38,2)) AS expected, lead(balance) OVER (PARTITION BY scope ORDER BY row_index) AS actual FROM a),
    w AS (SELECT scope, s, count(*) AS n, arg_min(balance, row_index) AS newest FROM a GROUP BY scope, s),
    d AS (SELECT scope, day, sum(amount) AS told, sum(moved) AS moved FROM a GROUP BY scope, day),
    y AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY day DESC) AS r, sum(told) OVER t AS told_after, sum(moved) OVER t AS movements FROM d WINDOW t AS (PARTITION BY scope ORDER BY day DESC)),
    o AS (SELECT scope, strftime(day, '%-d %b %Y') AS marker, newest, CAST(movements AS DECIMAL(38,2)) AS movements, CAST(newest - movements AS DECIMAL(38,2)) AS derived,
          CAST(newest - told_after + CASE WHEN s % 4 = 0 AND r = 2 THEN 1 ELSE 0 END AS DECIMAL(38,2)) AS printed FROM y JOIN w USING (scope) WHERE r <= 2 AND s % 7 <> 0),
    f AS (SELECT *, CASE WHEN s % 5 = 0 THEN NULL WHEN s % 3 = 0 THEN CAST(newest + 1 AS DECIMAL(38,2)) ELSE newest END AS closing, n + CASE WHEN s % 6 = 0 THEN 1 ELSE 0 END AS times FROM w),
    p AS (SELECT 'balance_chain' AS name, scope, row_index, 0 AS ord, 'row ' || row_index || ': ' || balance || ' less ' || moved || ' is ' || expected || ', the next row has ' || actual || ' (' || CAST(actual - expected AS DECIMAL(38,2)) || ')' AS problem FROM e WHERE actual <> expected
      UNION ALL SELECT 'printed_openings', scope, 0, 0, marker || ': ' || newest || ' less ' || movements || ' is ' || derived || ', printed ' || printed FROM o WHERE derived <> printed
      UNION ALL SELECT 'one_amount_per_row', scope, row_index, 0, 'row ' || row_index || ': credit None, debit None []' FROM a WHERE amount = 0
      UNION ALL SELECT 'reference_provenance', scope, row_index, 0, 'row ' || row_index || ': ''' || ['Q Q', 'ab', 'A B'][s % 9 + 1] || ''' is not in the text' || ['', ' (it is with other spaces or case)', ' (it is without the spaces inside)'][s % 9 + 1] FROM a WHERE s % 9 < 3 AND row_index < 7), {EVIDENCE},
    c AS (SELECT f.*, name, coalesce(bad, 0) AS bad, (SELECT count(*) FROM o WHERE o.scope = f.scope) AS openings FROM f CROSS JOIN (SELECT unnest(['balance_chain', 'closing_balance', 'printed_openings', 'row_count', 'one_amount_per_row', 'reference_provenance']) AS name) LEFT JOIN b USING (name, scope))
    SELECT name, scope, CASE WHEN name = 'closing_balance' THEN CASE WHEN closing IS NULL THEN 'UNRESOLVED' WHEN closing = newest THEN 'PASS' ELSE 'FAIL' END WHEN name = 'row_count' THEN CASE WHEN times = n THEN 'PASS' ELSE 'FAIL' END
        WHEN name = 'printed_openings' AND openings = 0 THEN 'CANNOT_VERIFY' WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
      CASE name WHEN 'balance_chain' THEN (n - 1 - bad) || '/' || (n - 1) || ' links hold' WHEN 'closing_balance' THEN CASE WHEN closing IS NULL THEN 'the statement prints no closing balance' ELSE 'newest row ' || newest || ', printed ' || closing END
        WHEN 'printed_openings' THEN CASE WHEN openings = 0 THEN 'no opening is printed' ELSE (openings - bad) || '/' || openings || ' printed openings follow from the movements' END WHEN 'row_count' THEN n || ' rows, ' || times || ' times of day in the text'
        WHEN 'one_amount_per_row' THEN (n - bad) || '/' || n || ' rows have one amount' ELSE (n - bad) || '/' || n || ' references are in the text' END AS detail,
      CASE WHEN name = 'closing_balance' AND closing <> newest THEN 'difference ' || CAST(newest - closing AS DECIMAL(38,2)) WHEN name = 'row_count' AND times <> n THEN 'a line is missing from the rows, or one is there twice' ELSE coalesce(evidence, '') END AS evidence
    FROM c LEFT JOIN v USING (name, scope)"""
)
def statement_check_plan(spark: SparkSession, sf: str) -> DataFrame:
    return statement_checks.run_statement_checks(*printed_rows(spark, sf))
