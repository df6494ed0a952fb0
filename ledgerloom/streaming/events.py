"""Run events as a stream: new trace files are read as they arrive.

The reference of this package has an append log only; watermarks, windows and expiry here are an extension.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ledgerloom.operators.events import told
from ledgerloom.schemas import EVENT

#: Keyed state with timers needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATES = "run string, stage string, state string, attempts bigint, bad bigint, expired boolean"


def read(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Events of JSON-lines files under ``path/<run>/``, as they arrive, with event time ``ts``."""
    e = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True).json(path)
    return e.withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("bigint")))


def windowed(events: DataFrame, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Events per window, kind and status; later events than ``late`` are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "kind", "status").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), "kind", "status", "n")


class StageStates(StatefulProcessor):
    """Stages of one run: a map from stage to what is known of it, and a timer that ends the run when nothing has come for a while."""

    def __init__(self, expire_ms: int, ttl_ms: int | None = None):
        self.expire_ms, self.ttl_ms = expire_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stages = handle.getMapState("stages", "stage string", "at double, last string, attempts bigint, bad bigint", self.ttl_ms)
        self.until = handle.getValueState("until", "ms bigint", self.ttl_ms)

    @staticmethod
    def _row(run: str, stage: str, known: tuple, expired: bool) -> Row:
        _, last, attempts, bad = known
        return Row(run=run, stage=stage, state={"accepted": "done", "exhausted": "failed"}.get(last, "current"), attempts=attempts, bad=bad, expired=expired)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        """Updates the stages that the rows name and moves the timer to the run's last event; a row per changed stage."""
        changed: dict[str, tuple] = {}
        newest = 0
        for r in sorted(rows, key=lambda r: r["at"]):
            stage, label = r["stage"], r["label"]
            if stage not in changed:
                known = self.stages.getValue((stage,)) if self.stages.containsKey((stage,)) else None
                changed[stage] = tuple(known) if known is not None else (float("-inf"), "", 0, 0)
            at, last, attempts, bad = changed[stage]
            attempts += label == "attempt"
            bad += label == "rejected"
            if r["at"] >= at:
                at, last = float(r["at"]), label
            changed[stage] = (at, last, int(attempts), int(bad))
            newest = max(newest, int(r["at"] * 1000))
        for stage, known in changed.items():
            self.stages.updateValue((stage,), known)
            yield self._row(key[0], stage, known, False)
        before = self.until.get()[0] if self.until.exists() else None
        if self.ttl_ms is None and (before is None or newest + self.expire_ms > before):
            if before is not None:
                self.handle.deleteTimer(before)
            # A timer in the past of the watermark would never be set off by it.
            due = max(newest + self.expire_ms, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(due)
            self.until.update((due,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """The run is over: its stages are told once more, as expired, and forgotten."""
        for (stage,), known in list(self.stages.iterator()):
            yield self._row(key[0], stage, tuple(known), True)
        self.stages.clear()
        self.until.clear()

    def close(self) -> None:
        pass


def stage_states(events: DataFrame, late: str = "5 minutes", expire_seconds: int = 3600, ttl_seconds: int | None = None) -> DataFrame:
    """State of each stage of each run, updated with every batch: a row per change, and one with ``expired`` when its run ends.

    Events later than the watermark (``late``) are dropped.  A run of which nothing has come for ``expire_seconds`` of event time is told as expired and
    its state goes, so state grows with the runs under way.  With ``ttl_seconds``, state goes by the clock instead, without being told.
    """
    moved = (F.col("kind") == "state") & F.col("label").isin("attempt", "accepted", "rejected", "exhausted") & told("stage").isNotNull()
    moves = events.where(moved).select("run", told("stage").alias("stage"), "label", "at", "ts").withWatermark("ts", late)
    processor = StageStates(expire_seconds * 1000, None if ttl_seconds is None else ttl_seconds * 1000)
    return moves.groupBy("run").transformWithState(processor, STATES, "Update", "EventTime" if ttl_seconds is None else "ProcessingTime")


def since(events: DataFrame, run: str, n: int) -> DataFrame:
    """Events of a run from the ``n``-th on, for polling a finished or growing trace (batch)."""
    return events.where((F.col("run") == run) & (F.col("idx") >= n)).orderBy("idx")


def subscribe(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Call ``handle`` with every micro-batch, at least once; with ``once``, stop when all that is there has been handled."""
    writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def keep_once(path: str) -> Callable[[DataFrame, int], None]:
    """A handler that keeps every micro-batch exactly once, in ``path/batch=<id>``.

    A batch is written aside and renamed into place.  After a crash, Spark repeats a batch with the offsets that it had: if its folder is there, it was
    kept, and if it is not, what was written aside is not read.
    """

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        Path = spark._jvm.org.apache.hadoop.fs.Path  # noqa: N806
        final, aside = Path(f"{path}/batch={number}"), f"{path}/_aside/{number}-{uuid.uuid4().hex}"
        fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(final):
            return
        batch.write.parquet(aside)
        if not fs.rename(Path(aside), final) and not fs.exists(final):
            raise OSError(f"batch {number} could not be moved into place")

    return keep


def kept(spark: SparkSession, path: str) -> DataFrame:
    """What ``keep_once`` has kept, with the number of each row's ``batch``."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")
