"""Registered queries of the statement parser: statements are laid out as positioned words, page by page, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.catalog import LEDGER, account_rows, query, word_table
from ledgerloom.operators import layout

ROWS_PER_PAGE = 20
#: Where the columns start on a page.
COLUMNS = {"bank_reference": 30.0, "customer_reference": 110.0, "trn_type": 190.0, "value_date": 250.0, "credit": 320.0, "debit": 400.0, "balance": 480.0, "time": 560.0, "post_date": 620.0}


def _words(top: float, *texts: tuple[str, str | Column | list[Column]]) -> list[tuple[Column, float, float]]:
    """Words of a line with their places: in a column one after the other, ten points apart."""
    out = []
    for name, text in texts:
        words = [F.lit(w) for w in text.split(" ")] if isinstance(text, str) else text if isinstance(text, list) else [text]
        out += [(w, COLUMNS.get(name, 200.0) + i * 10, top) for i, w in enumerate(words)]
    return out


def statement_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the statements of all accounts: account block, header and marker, rows newest first, narratives of up to two lines."""
    r = account_rows(spark, sf)
    i = F.col("row_index")
    money = lambda c: F.format_number(c, 2)
    day = [F.split_part("value_date", F.lit(" "), F.lit(n)) for n in (1, 2, 3)]
    body = _words(
        0.0, ("bank_reference", F.concat(F.lit("R"), i)), ("trn_type", F.col("trn_type")), ("value_date", day), ("credit", money("credit")), ("debit", money("debit")), ("balance", money("balance")),
        ("time", F.concat(F.lit("07:0"), i % 10)), ("post_date", day),
    )
    only = lambda when, words: [(F.when(when, w), *place) for w, *place in words]
    body += only(i % 3 != 2, _words(10.0, ("bank_reference", "Narrative"), ("customer_reference", "Paid"), ("trn_type", "for"), ("value_date", F.col("trn_type"))))
    body += only(i % 3 == 1, _words(20.0, ("bank_reference", "Narrative"), ("customer_reference", "ref"), ("trn_type", i.cast("string"))))

    # A page is headed by the words of its newest row.
    head = [*_words(50.0, *layout.HEADERS.items()), *_words(75.0, ("bank_reference", [*map(F.lit, ("Balance", "brought", "forward")), *day, money("balance")]))]
    block = lambda y, label, *value: _words(y, ("bank_reference", label), ("block", list(value)))
    first = block(10.0, "Currency", F.lit("EUR")) + block(20.0, "Account number", F.concat(F.lit("N"), F.col("scope"))) + block(30.0, "Bank name", F.lit("First"), F.lit("Bank"))
    first += block(40.0, "Closing ledger balance brought forward", money("balance"))
    words = [*body, *only(i % ROWS_PER_PAGE == 0, head), *only(i == 0, first)]
    x0, top = (F.get(F.array(*[F.lit(w[n]) for w in words]), F.col("k")) for n in (1, 2))
    top = top + F.when(F.col("k") < len(body), 100.0 + (i % ROWS_PER_PAGE) * 30.0).otherwise(0.0)
    page = (F.floor(i / ROWS_PER_PAGE) + 1).cast("int").alias("page")
    each = r.select(F.concat(F.lit("stmt_EUR_"), F.col("scope"), F.lit(".pdf")).alias("doc"), page, "row_index", F.posexplode(F.array(*[w[0] for w in words])).alias("k", "text")).where("text IS NOT NULL")
    return each.select("doc", "page", "text", x0.alias("x0"), top.alias("top")).select("doc", "page", "text", "x0", (F.col("x0") + 8).alias("x1"), "top", (F.col("top") + 6).alias("bottom"))


@query(
    f"""WITH {LEDGER}, n AS (SELECT CAST(user_id AS VARCHAR) AS scope, event_type, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS i FROM events)
    SELECT 'EUR_' || l.scope AS scope, row_index, 'N' || l.scope AS account_number, 'EUR' AS currency, 'R' || row_index AS bank_reference, event_type AS trn_type, strftime(l.day, '%-d %b %Y') AS value_date, '07:0' || (row_index % 10) AS "time",
    CASE WHEN amount > 0 THEN amount END AS credit, CASE WHEN amount < 0 THEN amount END AS debit, balance, CASE row_index % 3 WHEN 0 THEN 'Paid for ' || event_type WHEN 1 THEN 'Paid for ' || event_type || ' ref ' || row_index ELSE '' END AS narrative,
    CAST(row_index // 20 + 1 AS INTEGER) AS page, CAST(100 + (row_index % 20) * 30 AS DOUBLE) AS top FROM l JOIN n ON l.scope = n.scope AND l.row_index = n.i"""
)
def parsed_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = layout.parse(statement_words(spark, sf))[1]
    money = lambda c: F.col(c).cast("decimal(38,2)").alias(c)
    return rows.select("scope", "row_index", "account_number", "currency", "bank_reference", "trn_type", "value_date", "time", money("credit"), money("debit"), money("balance"), "narrative", F.col("provenance.page").alias("page"), F.col("provenance.top").alias("top"))


@query(
    f"""WITH {LEDGER}, p AS (SELECT scope, row_index // 20 + 1 AS page, arg_min(balance, row_index) AS newest, arg_min(day, row_index) AS day FROM l GROUP BY 1, 2),
    o AS (SELECT scope, day, arg_max(newest, page) AS opening FROM p GROUP BY scope, day)
    SELECT 'EUR_' || p.scope AS scope, 'stmt_EUR_' || p.scope || '.pdf' AS source_file, 'N' || p.scope AS account_number, 'First Bank' AS bank_name, max(newest) FILTER (page = 1) AS closing_balance, count(*) AS pages,
    (SELECT string_agg(strftime(day, '%-d %b %Y') || ' ' || opening, '; ' ORDER BY strftime(day, '%-d %b %Y')) FROM o WHERE o.scope = p.scope) AS openings FROM p GROUP BY p.scope"""
)
def parsed_statements(spark: SparkSession, sf: str) -> DataFrame:
    s = layout.parse(statement_words(spark, sf))[0]
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("printed_openings"), lambda e: F.concat(e["key"], F.lit(" "), e["value"].cast("string")))), "; ")
    return s.select("scope", "source_file", "account_number", "bank_name", "closing_balance", F.size("page_text").cast("bigint").alias("pages"), shown.alias("openings"))


@query(
    f"""WITH {LEDGER} SELECT DISTINCT 'stmt_EUR_' || scope || '.pdf' AS doc, CAST(row_index // 20 + 1 AS INTEGER) AS page, unnest({list(layout.HEADERS)}) AS name, unnest({[COLUMNS[n] for n in layout.HEADERS]}::DOUBLE[]) AS x0 FROM l"""
)
def header_columns(spark: SparkSession, sf: str) -> DataFrame:
    return layout.column_positions(layout.lines(statement_words(spark, sf)), layout.HEADERS)


@query("SELECT o_orderkey, 40.0::DOUBLE AS x0, round((o_orderkey % 30) * 14.0, 3)::DOUBLE AS top, 500.0::DOUBLE AS x1, round((o_orderkey % 30) * 14.0 + 8.9, 3)::DOUBLE AS bottom FROM orders")
def line_boxes(spark: SparkSession, sf: str) -> DataFrame:
    t = layout.line_texts(layout.lines(word_table(spark, sf)))
    return t.select(F.split_part("text", F.lit(" "), F.lit(1)).cast("bigint").alias("o_orderkey"), "x0", F.round("top", 3).alias("top"), "x1", F.round("bottom", 3).alias("bottom"))
