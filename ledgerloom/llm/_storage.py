"""Tables written in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, one of our own for a local session, as in tests, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("ledgerloom.shared.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
            spark.conf.set("ledgerloom.shared.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start from the table.

    Nothing reads the shuffles of the write again, so their files go with it, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Cap the rows of an Arrow batch: both sides of the exchange with Python hold a whole batch of texts outside the heap.

    Batches of very long texts are bounded by ``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB by default) besides.  Plans read the setting
    when they run, so it stays set in the session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    have = int(spark.conf.get(key, "10000"))
    if have <= 0 or have > rows:
        spark.conf.set(key, str(rows))


def only(docs: DataFrame, stay: DataFrame, keys: list[Column], repeated: bool) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose ``keys`` equal the columns of a row of ``stay``; with ``repeated``, one row for each.

    The columns travel in a struct, so names of ``docs`` cannot clash with those of the keys.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[k.alias(n) for k, n in zip(keys, names)])
    stay = stay.toDF(*[f"s{i}" for i in range(len(keys))])
    same = [F.col(n).eqNullSafe(F.col(f"s{i}")) for i, n in enumerate(names)]
    kept = rows.join(stay, reduce(lambda a, b: a & b, same), "left_semi")
    kept = kept.dropDuplicates(names) if repeated else kept
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
