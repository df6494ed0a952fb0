"""Checks of parsed statements.  Rows carry ``scope`` (the account) and ``row_index`` (0 is the newest)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import amount, citation, let, near_miss, statement_date
from ledgerloom.operators.verdicts import EVIDENCE, Check, block_of, checks, exploded, judged, passed, passing, quoted, settled, text
from ledgerloom.schemas import MONEY


def movement() -> Column:
    """Signed amount of a row: credit, else debit (negative already), else zero."""
    return F.coalesce("credit", "debit", F.lit(0)).cast(MONEY)


def scopes(statements: DataFrame, rows: DataFrame) -> DataFrame:
    """Row count of every statement, those without rows included."""
    return statements.select("scope").join(rows.groupBy("scope").agg(F.count(F.lit(1)).alias("n")), "scope", "left").select("scope", F.coalesce("n", F.lit(0)).alias("n"))


def chain_links(rows: DataFrame) -> DataFrame:
    """Every link of the balance chain: ``expected`` (balance less amount), ``actual`` (next balance), ``holds``, ``delta``.

    A chain is one sequence: each statement's rows are sorted in one task, as many as the statement has.
    """
    order = Window.partitionBy("scope").orderBy("row_index")
    r = rows.withColumn("amount", movement()).withColumn("next_index", F.lead("row_index").over(order)).withColumn("actual", F.lead("balance").over(order))
    r = r.where("next_index IS NOT NULL").withColumn("expected", (F.col("balance") - F.col("amount")).cast(MONEY))
    return r.withColumn("holds", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False))).withColumn("delta", (F.col("actual") - F.col("expected")).cast(MONEY))


def _marks(statements: DataFrame) -> DataFrame:
    return statements.select("scope", F.explode("printed_openings").alias("marker", "printed")).withColumn("boundary", statement_date("marker"))


def opening_markers(statements: DataFrame, rows: DataFrame) -> DataFrame:
    """Printed openings against newest balance less the movements on or after their day; undated markers hold.

    A sweep: marks and rows of a statement in one order, latest day first and rows before marks, where a running sum holds each mark's movements.
    """
    day = statement_date("value_date")
    moves = rows.select("scope", day.alias("day"), F.when(day.isNotNull(), movement()).alias("amount"), "balance", "row_index")
    marks = _marks(statements).select("scope", F.col("boundary").alias("day"), "marker", "printed")
    both = moves.unionByName(marks, allowMissingColumns=True).withColumn("mark", F.col("marker").isNotNull())
    w = Window.partitionBy("scope")
    swept = both.withColumn("movements", F.coalesce(F.sum("amount").over(_upto(w)), F.lit(0)).cast(MONEY))
    swept = swept.withColumn("newest", F.min_by("balance", F.when(~F.col("mark"), F.col("row_index"))).over(w)).where("mark")
    out = swept.select("scope", "marker", "printed", F.col("day").alias("boundary"), F.when(F.col("day").isNull(), 0).otherwise(F.col("movements")).cast(MONEY).alias("movements"), "newest")
    out = out.withColumn("derived", (F.col("newest") - F.col("movements")).cast(MONEY))
    return out.withColumn("holds", F.col("boundary").isNull() | F.coalesce(F.col("derived") == F.col("printed"), F.lit(False)))


def _upto(w: Window) -> Window:
    """From the latest day to the record's own, rows before marks."""
    return w.orderBy(F.desc_nulls_last("day"), "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _checks() -> dict[str, Check]:
    """The checks of a statement, by name: what a record says of each, and what that comes to."""
    gap = lambda m: (F.coalesce(m("newest"), F.lit(0)) - m("closing_balance")).cast(MONEY)
    has, printed = lambda m: m("n_rows") > 0, lambda m: m("closing_balance").isNotNull()
    closing = lambda m: F.when(~printed(m), "UNRESOLVED").when(has(m) & F.coalesce(m("newest") == m("closing_balance"), F.lit(False)), "PASS").otherwise("FAIL")
    links = lambda m: F.greatest(m("n_rows") - 1, F.lit(0))
    counted = lambda m: m("times") == m("n_rows")
    opened = lambda m: F.when(m("openings") == 0, "CANNOT_VERIFY").when(~has(m), "FAIL").otherwise(passing(m))
    row = lambda *parts: text("row ", F.col("row_index"), ": ", *parts)
    why_link = F.when(F.col("expected").isNull() | F.col("actual").isNull(), row("a balance is missing")).otherwise(
        row(F.col("balance"), " less ", F.col("amount"), " is ", F.col("expected"), ", the next row has ", F.col("actual"), " (", F.col("delta"), ")")
    )
    why_opening = text(F.col("marker"), ": ", F.col("newest"), " less ", F.col("movements"), " is ", F.col("derived"), ", printed ", F.col("printed"))
    hint = near_miss("bank_reference", "full")
    hint = F.when(F.col("nth_lost") <= EVIDENCE, let(hint, lambda h: F.when(h == "JOINED", " (it is without the spaces inside)").when(h == "SPACING", " (it is with other spaces or case)").otherwise(""))).otherwise("")
    share = lambda what: lambda m: text(m("n_rows") - m("n_problems"), "/", m("n_rows"), what)
    found = [
        Check("balance_chain", passing, lambda m: text(links(m) - m("n_problems"), "/", links(m), " links hold"), problems=F.array(F.when(F.col("broken"), why_link))),
        Check(
            "closing_balance", closing, lambda m: F.when(~printed(m), "the statement prints no closing balance").when(~has(m), "no rows").otherwise(text("newest row ", m("newest"), ", printed ", m("closing_balance"))),
            shown=lambda m: F.when((closing(m) == "FAIL") & has(m), F.coalesce(text("difference ", gap(m)), F.lit(""))).otherwise(""),
        ),
        Check(
            "printed_openings", opened,
            lambda m: F.when(m("openings") == 0, "no opening is printed").when(~has(m), "no rows").otherwise(text(m("openings") - m("n_problems"), "/", m("openings"), " printed openings follow from the movements")),
            problems=F.array(F.when(F.col("unfit"), why_opening)),
        ),
        Check(
            "row_count", lambda m: F.when(counted(m), "PASS").otherwise("FAIL"), lambda m: text(m("n_rows"), " rows, ", m("times"), " times of day in the text"),
            shown=lambda m: F.when(counted(m), "").otherwise("a line is missing from the rows, or one is there twice"),
        ),
        Check("one_amount_per_row", passing, share(" rows have one amount"), problems=F.array(F.when(F.col("odd"), row("credit ", F.col("credit"), ", debit ", F.col("debit"), " [", F.coalesce("cited", F.lit("")), "]")))),
        Check("reference_provenance", passing, share(" references are in the text"), problems=F.array(F.when(F.col("lost"), row(quoted(F.col("bank_reference")), " is not in the text", hint)))),
    ]
    return {c.name: c for c in found}


def run_statement_checks(statements: DataFrame, rows: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """All checks of every statement (or those named) as one table, from one pass over the rows.

    Rows, printed openings and the statement itself become records of one table, dealt by statement and sorted twice: by position, for the chain and the
    newest balance, and by day, for the openings.  The text is a column of the statement's record; rows see it as they pass, and nothing joins it to them.  Statements without rows are checked too, rows without a statement are not.
    """
    have = set(statements.columns)
    of = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    day = statement_date("value_date") if "value_date" in rows.columns else F.lit(None).cast("date")
    r = rows.select(
        "scope", F.lit(0).alias("kind"), of("row_index", "bigint").cast("bigint").alias("row_index"), of("credit", MONEY).alias("credit"), of("debit", MONEY).alias("debit"), of("balance", MONEY).alias("balance"), day.alias("day"),
        F.coalesce(of("bank_reference", "string"), F.lit("")).alias("bank_reference"), (citation("provenance") if "provenance" in rows.columns else F.lit("")).alias("cited"),
    )
    table = r.withColumn("amount", F.coalesce("credit", "debit", F.lit(0)).cast(MONEY)).withColumn("mark", F.lit(False))
    if "printed_openings" in have:
        m = _marks(statements).select("scope", F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("row_index"), F.col("boundary").alias("day"), "marker", "printed", F.lit(True).alias("mark"))
        table = table.unionByName(m, allowMissingColumns=True)
    else:
        table = table.withColumn("marker", F.lit(None).cast("string")).withColumn("printed", F.lit(None).cast(MONEY))
    pages = F.coalesce("page_text", F.array().cast("array<string>")) if "page_text" in have else F.array().cast("array<string>")
    seen = F.aggregate(F.transform(pages, lambda p: F.regexp_count(F.coalesce(p, F.lit("")), F.lit(r"\b\d{2}:\d{2}\b"))), F.lit(0), lambda a, x: a + x)
    figures = F.coalesce(F.size("printed_openings"), F.lit(0)) if "printed_openings" in have else F.lit(0)
    s = statements.select(
        "scope", F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("row_index"), F.lit(True).alias("mark"), (F.col("closing_balance") if "closing_balance" in have else F.lit(None)).cast(MONEY).alias("closing_balance"),
        F.greatest(figures, F.lit(0)).cast("bigint").alias("openings"), seen.cast("bigint").alias("times"), F.array_join(pages, "\n").alias("body"),
    )
    table = table.unionByName(s, allowMissingColumns=True)

    w = Window.partitionBy("scope")
    along = w.orderBy("kind", "row_index")
    t = table.withColumn("movements", F.coalesce(F.sum(F.when(F.col("day").isNotNull(), F.col("amount"))).over(_upto(w)), F.lit(0)).cast(MONEY))
    t = t.withColumn("next_kind", F.lead("kind").over(along)).withColumn("actual", F.lead("balance").over(along))
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.struct("kind", "balance")).over(whole)
    t = t.where(F.col("scope").isNotNull()) if "page_text" in have else t
    t = t.withColumn("newest", F.when(first["kind"] == 0, first["balance"])).withColumn("has_rows", first["kind"] == 0).withColumn("stated", F.max("kind").over(whole) == 2).where("stated")
    full = F.first("body", ignorenulls=True).over(whole)  # a text lies in its statement's record only: sorts and windows hold it once
    t = t.withColumn("full", full)
    is_row = F.col("kind") == 0
    linked = is_row & F.coalesce(F.col("next_kind") == 0, F.lit(False))
    t = t.withColumn("expected", (F.col("balance") - F.col("amount")).cast(MONEY)).withColumn("delta", (F.col("actual") - F.col("expected")).cast(MONEY))
    t = t.withColumn("derived", (F.col("newest") - F.col("movements")).cast(MONEY))
    t = t.withColumns({
        "broken": linked & ~F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)),
        "unfit": (F.col("kind") == 1) & F.col("day").isNotNull() & F.col("has_rows") & ~F.coalesce(F.col("derived") == F.col("printed"), F.lit(False)),
        "odd": is_row & (F.col("credit").isNull() == F.col("debit").isNull()),
        "lost": is_row & (F.col("bank_reference") != "") & ~F.col("full").contains(F.col("bank_reference")),
    })
    t = t.drop("full")
    t = t.withColumn("nth_lost", F.count_if("lost").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("full", full)  # hints are asked for what is shown only

    all_ = _checks()
    checks = [all_[n] for n in names or all_]
    kept = ["newest", "closing_balance", "openings", "times", "n_rows"]
    j = judged(t.withColumn("n_rows", is_row.cast("bigint")), checks, *kept)
    sums = [c for c in j.columns if c.endswith("_n_problems")]
    per_block = j.withColumn("block", block_of("row_index")).groupBy("scope", "block").agg(
        *[F.sum(c).alias(c) for c in sums], *[(F.sum if c == "n_rows" else F.max)(c).alias(c) for c in kept], F.flatten(F.collect_list("problems")).alias("problems")
    )
    per_block = per_block.withColumn("n_rows", F.sum("n_rows").over(w)).withColumn("n", F.lit(0).cast("bigint"))
    return settled(per_block, checks, kept)


CHECKS = ("balance_chain", "closing_balance", "printed_openings", "row_count", "one_amount_per_row", "reference_provenance")


def _alone(name: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    def check(statements: DataFrame, rows: DataFrame) -> DataFrame:
        return run_statement_checks(statements, rows, (name,))

    check.__name__ = name
    return check


balance_chain, closing_balance, printed_openings, row_count, one_amount_per_row, reference_provenance = map(_alone, CHECKS)


def values_parse(statements: DataFrame, raw_rows: DataFrame, fields: tuple[str, ...] = ("credit", "debit", "balance")) -> DataFrame:
    """Raw values that are neither blank nor amounts."""
    bad = F.array(*[F.when((F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) != "") & amount(f).isNull(), text("row ", F.col("row_index"), f": {f} ", quoted(F.col(f).cast("string")), " is no amount")) for f in fields])
    return checks(scopes(statements, raw_rows), exploded(raw_rows, bad), "values_parse", passed(), text(F.col("n_problems"), " values are no amounts"))


def corrupted(rows: DataFrame, scope: str, row_index: int, by: str = "100") -> DataFrame:
    """Fault injection: take ``by`` from the amount of one row."""
    here = (F.col("scope") == scope) & (F.col("row_index") == row_index)
    less = lambda c: F.when(here & F.col(c).isNotNull(), (F.col(c) - F.lit(by).cast(MONEY)).cast(MONEY)).otherwise(F.col(c))
    return rows.withColumn("debit", F.when(F.col("credit").isNull(), less("debit")).otherwise(F.col("debit"))).withColumn("credit", less("credit"))
