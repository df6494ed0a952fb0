"""Turning what checks say of rows into check rows: one row per check and scope, with the first problems as evidence.

A check states, per row, counts to be summed and the problems it sees.  ``settled`` takes all checks of a plan together: one pass over the rows, then
aggregations of shrinking size (the rows of a task's block, a block of rows, a block of blocks, the scope), each of which keeps the first few problems per
check only.  So nothing gathers a scope's problems, however many there are, and the rows are read once for any number of checks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import let

EVIDENCE = 5
#: Rows of a block: no aggregation gathers more than the problems of so many rows, or of so many blocks.
BLOCK = 4096

Sums = Callable[[str], Column]


@dataclass(frozen=True)
class Check:
    """A check, stated per row: ``counts`` are summed over a scope, ``problems`` is an array of texts (nulls are none).

    ``status`` and ``detail`` get the sums by name; ``n`` is the number of rows and ``n_problems`` that of problems.  ``listed`` marks rows whose numbers
    are the evidence, ``limit`` of them; ``shown`` makes the evidence from the sums.
    """

    name: str
    status: Callable[[Sums], Column]
    detail: Callable[[Sums], Column]
    counts: dict[str, Column] = field(default_factory=dict)
    problems: Column | None = None
    listed: Column | None = None
    limit: int = EVIDENCE
    shown: Callable[[Sums], Column] | None = None


def passing(m: Sums) -> Column:
    return F.when(m("n_problems") == 0, "PASS").otherwise("FAIL")


PROBLEM = "array<struct<check:int,row_index:bigint,ord:int,problem:string>>"


def problem_list(check: int, row: Column | str, texts: Column) -> Column:
    """Texts of an array as problems of a check, in their order."""
    at = F.col(row) if isinstance(row, str) else row
    kept = F.filter(texts, lambda x: x.isNotNull())
    return F.transform(kept, lambda x, i: F.struct(F.lit(check).alias("check"), at.cast("bigint").alias("row_index"), i.cast("int").alias("ord"), x.alias("problem")))


def _of(check: int) -> Callable[[Column], Column]:
    return lambda x: x["check"] == check


def _first(problems: Column, limits: dict[int, int]) -> Column:
    """The first problems of each check."""
    if not limits:
        return F.array().cast(PROBLEM)
    return let(problems, lambda p: F.concat(*[F.slice(F.array_sort(F.filter(p, _of(i))), 1, n) for i, n in limits.items()]))


def judged(rows: DataFrame, checks: list[Check], *keep: str) -> DataFrame:
    """What all checks say of each row: ``scope, row_index``, the columns ``keep``, a count ``m<i>_<name>`` per check and name, and ``problems``."""
    counts = {f"m{i}_{k}": c.cast("long") if k not in DECIMALS else c for i, check in enumerate(checks) for k, c in check.counts.items()}
    texts = {i: check.problems if check.listed is None else F.array(F.when(check.listed, F.col("row_index").cast("string"))) for i, check in enumerate(checks) if check.problems is not None or check.listed is not None}
    found = F.concat(*[problem_list(i, "row_index", t) for i, t in texts.items()]) if texts else F.array().cast(PROBLEM)
    r = rows.select("scope", "row_index", *keep, *[c.alias(k) for k, c in counts.items()], found.cast(PROBLEM).alias("problems"))
    return r.withColumns({f"m{i}_n_problems": F.size(F.filter("problems", _of(i))).cast("long") for i in texts})


#: Counts that are amounts.
DECIMALS = ("moved", "debits", "credits")


def settled(partial: DataFrame, checks: list[Check], more: list[str] | None = None) -> DataFrame:
    """Check rows from judged rows (or sums of some): ``scope, block``, ``n``, counts and ``problems``; ``more`` are columns whose maximum is kept."""
    limits = {i: c.limit for i, c in enumerate(checks) if f"m{i}_n_problems" in partial.columns}
    sums = [c for c in partial.columns if c == "n" or c[0] == "m" and c[1:2].isdigit()]

    def level(df: DataFrame, *keys: Column | str) -> DataFrame:
        total = [F.sum(c).cast("decimal(38,6)" if c.split("_", 1)[-1] in DECIMALS else "long").alias(c) for c in sums]
        kept = [F.max(c).alias(c) for c in more or []]
        return df.groupBy("scope", *keys).agg(*total, *kept, _first(F.flatten(F.collect_list("problems")), limits).alias("problems"))

    t = level(level(level(partial, "block"), F.floor(F.col("block") / BLOCK).alias("block")))
    t = t.withColumns({c: F.coalesce(c, F.lit(0)) for c in sums})
    out = []
    for i, check in enumerate(checks):
        m = lambda k, i=i: F.col(k) if k == "n" or more and k in more else F.col(f"m{i}_{k}")
        mine = F.transform(F.filter("problems", _of(i)), lambda x: x["problem"])
        if check.shown is not None:
            evidence = check.shown(m)
        elif check.listed is not None:
            evidence = let(mine, lambda p: F.when(F.size(p) > 0, F.concat(F.lit("rows "), F.array_join(p, ", "))).otherwise(""))
        elif i in limits:
            over = F.when(m("n_problems") > check.limit, F.concat(F.lit("\n... and "), m("n_problems") - check.limit, F.lit(" more"))).otherwise("")
            evidence = F.concat(F.array_join(mine, "\n"), over)
        else:
            evidence = F.lit("")
        out.append(F.struct(F.lit(check.name).alias("name"), F.col("scope").cast("string").alias("scope"), check.status(m).alias("status"), check.detail(m).alias("detail"), evidence.alias("evidence")))
    return t.select(F.inline(F.array(*out)))


def block_of(row: Column | str) -> Column:
    return F.floor(F.coalesce(F.col(row) if isinstance(row, str) else row, F.lit(0)) / BLOCK)


def blocks(judged_rows: DataFrame) -> DataFrame:
    """Judged rows summed within each task, block by block: the shuffle that follows carries a row per block and task."""
    limits = {int(c[1 : c.index("_")]): 1 << 10 for c in judged_rows.columns if c.endswith("_n_problems")}
    sums = [c for c in judged_rows.columns if c[0] == "m" and c[1:2].isdigit()]
    keyed = judged_rows.withColumn("block", block_of("row_index")).withColumn("task", F.spark_partition_id())
    total = [F.sum(c).cast("decimal(38,6)" if c.split("_", 1)[-1] in DECIMALS else "long").alias(c) for c in sums]
    return keyed.groupBy("scope", "block", "task").agg(F.count(F.lit(1)).alias("n"), *total, _first(F.flatten(F.collect_list("problems")), limits).alias("problems")).drop("task")


# Checks of other shapes: counts and problems as tables.


def evidence(problems: DataFrame, limit: int = EVIDENCE) -> DataFrame:
    """``scope, n_problems, evidence``: the first problems by (row_index, ord) and how many more there are.

    Only ``limit`` rows of a scope are ever gathered; the rank filter is applied before the shuffle too.
    """
    order = Window.partitionBy("scope").orderBy("row_index", "ord", "problem")
    first = problems.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit)
    shown = first.groupBy("scope").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "problem"))), lambda x: x["problem"]), "\n").alias("shown"))
    counted = problems.groupBy("scope").agg(F.count(F.lit(1)).alias("n_problems"))
    more = F.when(F.col("n_problems") > limit, F.concat(F.lit("\n... and "), F.col("n_problems") - limit, F.lit(" more"))).otherwise("")
    return counted.join(shown, "scope").select("scope", "n_problems", F.concat("shown", more).alias("evidence"))


def exploded(rows: DataFrame, problems: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Problem rows from an array column of texts (nulls are no problem): ``scope, row_index, ord, problem``."""
    found = rows.select("scope", "row_index", *keep, F.posexplode(F.filter(problems, lambda x: x.isNotNull())).alias("ord", "problem"))
    return found


def checks(counts: DataFrame, problems: DataFrame | None, name: Column | str, status: Column, detail: Column, limit: int = EVIDENCE) -> DataFrame:
    """Check rows for every scope of ``counts``; ``status`` and ``detail`` may use its columns, ``n_problems`` and ``evidence``."""
    table = counts
    if problems is not None:
        table = counts.join(evidence(problems, limit), "scope", "left")
    else:
        table = counts.withColumn("n_problems", F.lit(0).cast("bigint")).withColumn("evidence", F.lit("")) if "evidence" not in counts.columns else counts.withColumn("n_problems", F.lit(0).cast("bigint"))
    table = table.withColumn("n_problems", F.coalesce("n_problems", F.lit(0))).withColumn("evidence", F.coalesce("evidence", F.lit("")))
    return table.select((F.lit(name) if isinstance(name, str) else name).alias("name"), "scope", status.alias("status"), detail.alias("detail"), "evidence")


def passed() -> Column:
    return F.when(F.col("n_problems") == 0, "PASS").otherwise("FAIL")


def text(*parts: Column | str) -> Column:
    """Concatenate columns and literals, nulls as ``None``."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("None")) if isinstance(p, Column) else F.lit(p) for p in parts])


def quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))
