"""Registered queries that are written as SQL text over this package's SQL names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.catalog import ORACLE, query, table
from ledgerloom.functions.sql import register


@query(ORACLE["candidates_topk"])
def candidates_by_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The candidate search, in SQL: words and weights by joins, the best entries of each value by the table function."""
    register(spark)
    return spark.sql(
        """WITH e AS (SELECT DISTINCT 0 AS pool, ledger_normalise(p_name) AS entry FROM {part} UNION ALL SELECT DISTINCT 1, ledger_normalise(p_type) FROM {part}),
        w AS (SELECT pool, entry, explode(ws) AS word FROM (SELECT pool, entry, ledger_words(entry) AS ws FROM e)),
        x AS (SELECT word, ln(((SELECT count(*) FROM e) + 1) / (count(*) + 1)) AS weight FROM w GROUP BY word),
        z AS (SELECT pool, entry, sum(weight) AS theirs FROM w JOIN x USING (word) GROUP BY pool, entry),
        m AS (SELECT value, explode(ws) AS word FROM (SELECT value, ledger_words(value) AS ws FROM (SELECT DISTINCT concat_ws(' ', p_name, p_type) AS value FROM {part}))),
        t AS (SELECT value, sum(coalesce(weight, ln((SELECT count(*) FROM e) + 1))) AS mine FROM m LEFT JOIN x USING (word) GROUP BY value)
        SELECT value, rank, matched_name, score FROM ledger_candidates(TABLE(
            SELECT m.value, w.pool, w.entry, x.weight, t.mine, z.theirs FROM m JOIN w USING (word) JOIN x USING (word) JOIN t ON t.value = m.value JOIN z ON z.pool = w.pool AND z.entry = w.entry
        ) PARTITION BY value)""",
        part=table(spark, sf, "part"),
    )


@query(
    """WITH d AS (SELECT o_orderkey, o_orderpriority AS name, o_orderkey % 4 AS k FROM orders),
    s AS (SELECT *, CASE k WHEN 0 THEN 'x ' || lower(name) || '. y' WHEN 1 THEN 'PAID ' || left(name, 3) || ' ' || substr(name, 4) || ')' WHEN 2 THEN 'éx ' || name || name ELSE 'nobody' END AS narrative FROM d)
    SELECT o_orderkey, CASE k WHEN 0 THEN lower(name) WHEN 1 THEN trim(left(name, 3) || ' ' || substr(name, 4)) WHEN 2 THEN name ELSE '' END AS span, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS compacted, k < 3 AS found,
    CASE k WHEN 0 THEN 'SPACING' WHEN 1 THEN '' WHEN 2 THEN '' ELSE '' END AS hint FROM s"""
)
def spans_by_sql(spark: SparkSession, sf: str) -> DataFrame:
    """Names in narratives, in SQL: the slice that spells each, its compact form, and why a name is not there letter for letter."""
    register(spark)
    return spark.sql(
        """WITH d AS (SELECT o_orderkey, o_orderpriority AS name, CASE o_orderkey % 4 WHEN 0 THEN concat('x ', lower(o_orderpriority), '. y') WHEN 1 THEN concat('PAID ', left(o_orderpriority, 3), ' ', substr(o_orderpriority, 4), ')')
            WHEN 2 THEN concat('éx ', o_orderpriority, o_orderpriority) ELSE 'nobody' END AS narrative FROM {orders})
        SELECT o_orderkey, span, ledger_compact(name) AS compacted, ledger_compact(name) = ledger_compact(span) AS found, CASE WHEN contains(narrative, name) OR o_orderkey % 4 = 1 THEN '' ELSE ledger_near_miss(name, narrative) END AS hint
        FROM d JOIN ledger_spans(TABLE(SELECT o_orderkey AS id, narrative, name FROM d)) s ON s.id = d.o_orderkey""",
        orders=table(spark, sf, "orders"),
    )
