"""Agreement of runs with an answer key, joined on balance and split by account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import casefold, normalise
from ledgerloom.operators.generic_checks import resolution
from ledgerloom.schemas import MONEY


def answer_key(staging: DataFrame, order: str) -> DataFrame:
    """Answers by balance: rows without one are left out, and of several the last counts."""
    last = Window.partitionBy("balance").orderBy(F.desc(order))
    return staging.withColumn("balance", F.col("balance").cast(MONEY)).where("balance IS NOT NULL").withColumn("__k", F.row_number().over(last)).where("__k = 1").drop("__k")


def _said(c: Column) -> Column:
    return F.when(F.lower(c).startswith("flag for review"), "").otherwise(c)


def compare(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """Every row with ``joined`` and, per field, what the comparison says."""
    mine = rows.select(
        "scope", F.col("balance").cast(MONEY).alias("balance"), normalise("counterparty_raw").alias("my_raw"), normalise(resolution(rows, "counterparty_match")["matched_name"]).alias("my_party"),
        normalise(resolution(rows, "project_code_match")["matched_name"]).alias("my_project"), normalise("classification").alias("my_class"),
    )
    theirs = truth.select(
        F.col("balance").cast(MONEY).alias("balance"), normalise("counterparty_raw").alias("raw"), _said(normalise("counterparty_matched")).alias("party"),
        _said(normalise("project_matched")).alias("project"), normalise("classification").alias("class"), F.lit(True).alias("hit"),
    )
    j = mine.join(theirs, "balance", "left").withColumn("joined", F.coalesce("hit", F.lit(False)))
    four = lambda a, b: F.when((a != "") & (b != ""), "both").when(a != "", "agent_only").when(b != "", "human_only").otherwise("neither")
    same = lambda a, b: casefold(a) == casefold(b)
    matched = lambda a, b: F.when((a != "") & (b != ""), F.when(same(a, b), "agree").otherwise("differ")).when(a != "", "agent_only").when(b != "", "human_only")
    c = F.col
    return j.select(
        "scope", "balance", "joined", F.when(c("joined"), four(c("my_raw"), c("raw"))).alias("counterparty"), F.when(c("joined"), matched(c("my_party"), c("party"))).alias("counterparty_matched"),
        F.when(c("joined"), matched(c("my_project"), c("project"))).alias("project_matched"), F.when(c("joined"), F.when(same(c("my_class"), c("class")), "agree").otherwise("differ")).alias("classification"),
    )


def tally(compared: DataFrame, holdout: list[str] = ()) -> DataFrame:
    """Counts by split (``tune``, ``holdout`` and, over both, ``all``)."""
    split = F.when(F.col("scope").isin(*holdout), "holdout").otherwise("tune") if holdout else F.lit("tune")
    count = lambda f, v: F.count_if(F.col(f) == v).alias(f"{f}_{v}")
    out = compared.withColumn("split", split).rollup("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("joined").alias("joined"), F.count_if(~F.col("joined")).alias("unjoined"),
        *[count("counterparty", v) for v in ("both", "agent_only", "human_only", "neither")],
        *[count(f, v) for f in ("counterparty_matched", "project_matched") for v in ("agree", "differ", "agent_only", "human_only")],
        *[count("classification", v) for v in ("agree", "differ")],
    )
    return out.withColumn("split", F.coalesce("split", F.lit("all")))


def disagreements(compared: DataFrame) -> DataFrame:
    """Rows and fields on which both sides say something else."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("outcome")) for f in ("counterparty_matched", "project_matched", "classification")])
    return compared.select("scope", "balance", F.inline(pairs)).where("outcome = 'differ'")


def samples_joined(one: DataFrame, other: DataFrame, key: str = "scope") -> DataFrame:
    """Attach another sample of the same rows by position, for scopes where both have as many rows."""
    n = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    equal = n(one, "a").join(n(other, "b"), key).where("a = b").select(key)
    sample = other.join(equal, key, "left_semi").select(key, "row_index", F.array(F.struct(*[c for c in other.columns if c not in (key, "row_index")])).alias("_samples"))
    return one.join(sample, [key, "row_index"], "left")
