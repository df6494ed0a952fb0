"""The functions of this package for SQL text: scalar names and table functions.

Scalars are temporary SQL functions whose bodies are the package's own expressions, so they are optimised and compiled like any other; the table functions
take Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators.reference import _span

#: name -> (its arguments, what it gives, the expression).
SCALARS: dict[str, tuple[str, str, Callable[..., Column]]] = {
    "ledger_normalise": ("v STRING", "STRING", lambda: X.normalise("v")),
    "ledger_fold": ("v STRING", "STRING", lambda: X.fold("v")),
    "ledger_compact": ("v STRING", "STRING", lambda: X.compact("v")),
    "ledger_casefold": ("v STRING", "STRING", lambda: X.casefold("v")),
    "ledger_words": ("v STRING", "ARRAY<STRING>", lambda: X.words(X.fold("v"))),
    "ledger_variants": ("v STRING", "ARRAY<STRING>", lambda: X.variants("v")),
    "ledger_amount": ("v STRING", "DECIMAL(38,2)", lambda: X.amount("v")),
    "ledger_money_label": ("v STRING", "DECIMAL(38,2)", lambda: X.money_label("v")),
    "ledger_code_words": ("v STRING", "STRING", lambda: X.code_words("v")),
    "ledger_near_miss": ("reference STRING, body STRING", "STRING", lambda: X.near_miss("reference", "body")),
}


def sql_text(c: Column) -> str:
    """An expression as SQL text; operators that are written as functions get quoted names."""
    return re.sub(r"('(?:[^'\\]|\\.)*')|([!=<>+\-*/%&|]+)(?=\()", lambda m: m[1] or f"`{m[2]}`", c._jc.node().sql())


class Spans:
    """``id, narrative, name`` -> ``id, span``: where a narrative spells a name, as it is written there."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        told, names = batch.column("narrative").to_pylist(), batch.column("name").to_pylist()
        yield pa.table({"id": batch.column("id").cast(pa.string()), "span": pa.array([_span(t, n) for t, n in zip(told, names)], pa.string())})


class Candidates:
    """Shared words of one value (``value, pool, entry, weight, mine, theirs``; partitioned by value) -> its best entries.

    Weights of an entry are added up as they come, so a partition holds one number per entry.
    """

    LIMIT = 5

    def __init__(self) -> None:
        self.value: str | None = None
        self.shared: dict[tuple[int, str], list[float]] = {}

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        columns = [batch.column(c).to_pylist() for c in ("value", "pool", "entry", "weight", "mine", "theirs")]
        for value, pool, entry, weight, mine, theirs in zip(*columns):
            self.value = value
            known = self.shared.setdefault((pool, entry), [0.0, max(mine, theirs)])
            known[0] += weight
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        scored = sorted((-round(shared / most, 3), pool, entry) for (pool, entry), (shared, most) in self.shared.items() if shared > 0)[: self.LIMIT]
        yield pa.table({
            "value": pa.array([self.value] * len(scored), pa.string()), "rank": pa.array(range(1, len(scored) + 1), pa.int64()), "matched_name": pa.array([e for *_, e in scored], pa.string()),
            "score": pa.array([-s for s, *_ in scored], pa.float64()),
        })


def register(spark: SparkSession) -> None:
    """Make all names known to a session's SQL, unless they are."""
    if spark.catalog.functionExists("ledger_candidates") and all(map(spark.catalog.functionExists, SCALARS)):
        return
    for name, (arguments, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {sql_text(body())}")
    spark.udtf.register("ledger_spans", F.arrow_udtf(Spans, returnType="id string, span string"))
    spark.udtf.register("ledger_candidates", F.arrow_udtf(Candidates, returnType="value string, rank bigint, matched_name string, score double"))
