"""Reconciliation of source rows with derived rows and with the journal, over the whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.statement_checks import movement
from ledgerloom.operators.verdicts import text
from ledgerloom.schemas import MONEY


def _place(rows: DataFrame) -> list[Column]:
    """Where a row stands in its table, if it says so: the statement, then the row."""
    have = [F.col(c).alias(c) for c in ("scope", "row_index") if c in rows.columns]
    return [F.struct(*have).alias("at")] if len(have) == 2 else []


def source_keys(rows: DataFrame) -> DataFrame:
    """Amount and balance of every source row."""
    return rows.select(movement().alias("amount"), F.col("balance").cast(MONEY).alias("balance"), *_place(rows))


def derived_keys(rows: DataFrame) -> DataFrame:
    """Amount (else credit, else debit) and balance; rows without an amount are left out, a null balance is a key like any other."""
    have = [F.col(c).cast(MONEY) for c in ("amount", "credit", "debit") if c in rows.columns]
    return rows.select(F.coalesce(*have).alias("amount"), F.col("balance").cast(MONEY).alias("balance"), *_place(rows)).where("amount IS NOT NULL")


def multiset_difference(source: DataFrame, derived: DataFrame, keys: tuple[str, ...] = ("amount", "balance")) -> DataFrame:
    """Keys whose counts differ: ``n_source, n_derived``, and the first place of each (``at``) if both sides have places; one shuffle, counts made before it."""
    placed = ["at"] if "at" in source.columns and "at" in derived.columns else []
    both = source.select(*keys, *placed, F.lit(1).alias("s"), F.lit(0).alias("d")).unionAll(derived.select(*keys, *placed, F.lit(0), F.lit(1)))
    first = [F.coalesce(F.min(F.when(F.col(side) == 1, F.col("at"))), F.min("at")).alias(f"at_{side}") for side in ("s", "d") if placed]
    return both.groupBy(*keys).agg(F.sum("s").alias("n_source"), F.sum("d").alias("n_derived"), *first).where("n_source <> n_derived")


def dropped(source: DataFrame, derived: DataFrame) -> DataFrame:
    return multiset_difference(source, derived).where("n_source > n_derived").select("amount", "balance", (F.col("n_source") - F.col("n_derived")).alias("n"))


def invented(source: DataFrame, derived: DataFrame) -> DataFrame:
    return multiset_difference(source, derived).where("n_derived > n_source").select("amount", "balance", (F.col("n_derived") - F.col("n_source")).alias("n"))


def one_row(*parts: DataFrame) -> DataFrame:
    """Columns of several one-row tables side by side, without a join."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def _sample(keys: DataFrame, label: str, limit: int = 5) -> DataFrame:
    """First keys by their place (by amount and balance where there is none) as one text; one row."""
    order = [c for c in ("at", "amount", "balance") if c in keys.columns]
    first = keys.orderBy(*order).limit(limit).withColumn("k", F.row_number().over(Window.orderBy(*order)))  # five rows at most
    item = text(F.col("amount"), " @ ", F.coalesce(F.col("balance").cast("string"), F.lit("no balance")), F.when(F.col("n") > 1, F.concat(F.lit(" x"), F.col("n"))).otherwise(""))
    shown = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", item.alias("t")))), lambda x: x["t"]), "; ").alias(f"{label}_shown"), F.coalesce(F.sum("n"), F.lit(0)).alias(f"{label}_in"))
    return one_row(shown, keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"{label}_n")))


def corpus_universe(source_rows: DataFrame, derived_rows: DataFrame, scope: str = "all") -> DataFrame:
    """Does every source row appear in the derived rows exactly once, and nothing else?"""
    s, d = source_keys(source_rows), derived_keys(derived_rows)
    diff = multiset_difference(s, d)
    at = lambda side: [F.col(f"at_{side}").alias("at")] if f"at_{side}" in diff.columns else []
    lost = _sample(diff.where("n_source > n_derived").select("amount", "balance", (F.col("n_source") - F.col("n_derived")).alias("n"), *at("s")), "lost")
    new = _sample(diff.where("n_derived > n_source").select("amount", "balance", (F.col("n_derived") - F.col("n_source")).alias("n"), *at("d")), "new")
    one = one_row(s.agg(F.count(F.lit(1)).alias("n_source")), d.agg(F.count(F.lit(1)).alias("n_derived")), lost, new)
    empty, clean = (F.col("n_source") == 0) | (F.col("n_derived") == 0), (F.col("lost_n") == 0) & (F.col("new_n") == 0)
    part = lambda k, what: F.when(F.col(f"{k}_n") > 0, text(F.col(f"{k}_n"), f" {what} (", F.col(f"{k}_shown"), F.when(F.col(f"{k}_n") > F.col(f"{k}_in"), text("; and ", F.col(f"{k}_n") - F.col(f"{k}_in"), " more")).otherwise(""), ")"))
    return one.select(
        F.lit("corpus_universe").alias("name"), F.lit(scope).alias("scope"), F.when(empty, "CANNOT_VERIFY").when(clean, "PASS").otherwise("FAIL").alias("status"),
        F.when(empty, "one side is empty").when(clean, "every source row is there once").otherwise("derived rows differ from the source").alias("detail"),
        F.concat_ws("; ", text("source ", F.col("n_source"), ", derived ", F.col("n_derived")), part("lost", "dropped"), part("new", "invented")).alias("evidence"),
    )


def corpus_aggregate(source_rows: DataFrame, derived_rows: DataFrame, scope: str = "all", by: str | None = None) -> DataFrame:
    """Signed totals must be equal; all currencies are summed together, or apart with ``by``."""
    pick = lambda rows, amount, tag: rows.select((F.col(by) if by else F.lit(scope)).alias("scope"), amount.alias("x"), F.lit(tag).alias("side"))
    have = [F.col(c).cast(MONEY) for c in ("amount", "credit", "debit") if c in derived_rows.columns]
    both = pick(source_rows, movement(), "s").unionAll(pick(derived_rows.where(F.coalesce(*have).isNotNull()), F.coalesce(*have), "d"))
    total = lambda tag: F.coalesce(F.sum(F.when(F.col("side") == tag, F.col("x"))), F.lit(0)).cast(MONEY)
    t = both.groupBy("scope").agg(total("s").alias("source"), total("d").alias("derived"), F.count_if(F.col("side") == "s").alias("ns"), F.count_if(F.col("side") == "d").alias("nd"))
    empty, same = (F.col("ns") == 0) | (F.col("nd") == 0), F.col("source") == F.col("derived")
    return t.select(
        F.lit("corpus_aggregate").alias("name"), "scope", F.when(empty, "CANNOT_VERIFY").when(same, "PASS").otherwise("FAIL").alias("status"),
        F.when(empty, "one side is empty").when(same, "signed totals tie").otherwise("signed totals do not tie").alias("detail"),
        text("source ", F.col("source"), ", derived ", F.col("derived"), ", difference ", (F.col("source") - F.col("derived")).cast(MONEY)).alias("evidence"),
    )


def says_debit(c: Column) -> Column:
    """Side of a journal line whose flag may be a boolean or a word."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("yes", "true", "debit", "dr", "1"), F.lit(False))


def corpus_stage_tie(rows: DataFrame, journal: DataFrame, scope: str = "all") -> DataFrame:
    """Absolute movement of the rows, debits and credits must be the same number, exactly."""
    r = derived_keys(rows).agg(F.coalesce(F.sum(F.abs("amount")), F.lit(0)).cast(MONEY).alias("movement"), F.count(F.lit(1)).alias("nr"))
    value = F.coalesce(F.col("amount").cast(MONEY), F.lit(0))
    side = lambda yes: F.coalesce(F.sum(F.when(says_debit(F.col("is_debit")) == yes, value)), F.lit(0)).cast(MONEY)
    j = journal.agg(side(True).alias("debits"), side(False).alias("credits"), F.count(F.lit(1)).alias("nj"))
    one = one_row(r, j)  # sums are made before the sides meet
    empty, same = (F.col("nr") == 0) | (F.col("nj") == 0), (F.col("movement") == F.col("debits")) & (F.col("debits") == F.col("credits"))
    return one.select(
        F.lit("corpus_stage_tie").alias("name"), F.lit(scope).alias("scope"), F.when(empty, "CANNOT_VERIFY").when(same, "PASS").otherwise("FAIL").alias("status"),
        F.when(empty, "one side is empty").when(same, "the journal ties to its rows").otherwise("the journal does not tie to its rows").alias("detail"),
        text("rows ", F.col("movement"), ", debits ", F.col("debits"), ", credits ", F.col("credits")).alias("evidence"),
    )
