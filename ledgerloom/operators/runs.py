"""Run catalogue: one row per run directory or summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def described(runs: DataFrame) -> DataFrame:
    """Add ``batch`` (the first two ``-`` parts of the id), ``started`` and ``finished`` (a summary is there)."""
    parts = F.split("run_id", "-")
    batch = F.concat_ws("-", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    out = runs.withColumn("batch", batch).withColumn("started", F.try_to_timestamp("batch", F.lit("yyyyMMdd-HHmmss")))
    return out.withColumn("finished", F.col("accepted").isNotNull() if "accepted" in runs.columns else F.lit(False))


def stages(files: DataFrame) -> DataFrame:
    """Distinct stages of each run from its attempt files, such as ``resolve-attempt-2.md``."""
    stage = F.regexp_extract("file", r"([a-z_]+)-attempt-\d+\.", 1)
    return files.withColumn("stage", stage).where("stage <> ''").groupBy("run_id").agg(F.array_sort(F.collect_set("stage")).alias("stages"))


def newest_first(runs: DataFrame, limit: int | None = None) -> DataFrame:
    out = runs.orderBy(F.desc("run_id"))
    return out if limit is None else out.limit(limit)


def by_batch(runs: DataFrame) -> DataFrame:
    """Accepted, rejected (of finished runs) and all runs of each batch."""
    r = described(runs)
    return r.groupBy("batch").agg(F.count_if(F.col("finished") & F.col("accepted")).alias("accepted"), F.count_if(F.col("finished") & ~F.col("accepted")).alias("rejected"), F.count(F.lit(1)).alias("total"))


def resolve(runs: DataFrame, asked: str, latest: str | None = None) -> DataFrame:
    """The run that a short id means: the latest marker, an exact id, else the newest that starts with or holds it."""
    if asked == "latest" and latest:
        asked = latest
    rank = F.when(F.col("run_id") == asked, 0).when(F.lit(asked == "latest") | F.col("run_id").startswith(asked) | F.col("run_id").contains(asked), 1)
    return runs.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", F.desc("run_id")).limit(1).drop("rank")


def picked(runs: DataFrame, asked: str | None = None, latest: str | None = None) -> DataFrame:
    """Run to show: the one asked for, else the latest if it has a trace, else the newest with a trace."""
    rank = F.when(F.col("run_id") == F.lit(asked), 0).when((F.col("run_id") == F.lit(latest)) & F.col("has_trace"), 1).when(F.col("has_trace"), 2)
    return runs.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", F.desc("run_id")).limit(1).drop("rank")


def accounts(runs: DataFrame, profile: str | None = None) -> DataFrame:
    """Distinct accounts, of one profile's runs if one is named, with their newest run."""
    r = runs if profile is None else runs.where(F.col("profile") == profile)
    k = F.row_number().over(Window.partitionBy("account").orderBy(F.desc("run_id")))
    return r.withColumn("k", k).where("k = 1").drop("k")
