"""Ledger reports that the specification documents describe: movements, mapping gaps, crosswalks, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.schemas import MONEY


def movements(lines: DataFrame, by: tuple[str, ...] = ("entity", "account")) -> DataFrame:
    """Debits less credits per entity and account."""
    value = F.col("amount").cast(MONEY)
    return lines.groupBy(*by).agg(F.sum(F.when(F.col("is_debit"), value).otherwise(-value)).cast(MONEY).alias("net"), F.count(F.lit(1)).alias("n_lines"))


def mapping_gaps(lines: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Keys without a mapping, by exposure."""
    open_ = lines.join(mapping.select(key).distinct(), key, "left_anti")
    return open_.groupBy(key).agg(F.sum(F.abs(F.col("amount").cast(MONEY))).cast(MONEY).alias("exposure"), F.count(F.lit(1)).alias("n_lines")).orderBy(F.desc("exposure"), key)


def crosswalk(lines: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Map lines to target accounts; of several rules for a key the one of least ``priority`` counts."""
    rule = mapping.groupBy(key).agg(F.min_by("target", F.struct("priority", "target")).alias("target"), F.min("priority").alias("priority"))
    return lines.join(rule, key, "left")


def concentration(holdings: DataFrame, by: str, ceiling: float | Column, within: str | None = None) -> DataFrame:
    """Share of each holding in the total (of its group), and whether it is over the ceiling."""
    per = holdings.groupBy(*([within] if within else []), by).agg(F.sum(F.col("amount").cast(MONEY)).cast(MONEY).alias("amount"))
    total = F.sum("amount").over(Window.partitionBy(*([within] if within else [])))
    limit = F.lit(str(ceiling)).cast("decimal(10,8)") if isinstance(ceiling, float) else ceiling.cast("decimal(10,8)")
    share = F.bround(F.try_divide(F.col("amount").cast("double"), F.col("total").cast("double")), 6)
    # The comparison multiplies, so it is exact; decimal division keeps six digits.
    out = per.withColumn("total", total.cast("decimal(26,2)")).withColumn("over", F.col("amount") > F.col("total") * limit)
    return out.withColumn("share", share).drop("total")


def in_band(values: DataFrame, value: str, low: float, high: float) -> DataFrame:
    return values.withColumn("in_band", F.col(value).between(low, high))


def excluded(holdings: DataFrame, field: str, exclusions: list[str]) -> DataFrame:
    """Holdings with the excluded labels that they carry."""
    return holdings.withColumn("hits", F.array_intersect(F.col(field), F.array(*[F.lit(x) for x in exclusions]))).withColumn("clean", F.size("hits") == 0)
