"""Analysis of run events: ``run, idx, kind, label, detail, status, body, meta, at`` (epoch seconds); ``idx`` orders a run.

Kinds are those of recorded traces: ``state`` (labels ``attempt``, ``accepted``, ``rejected``, ``exhausted``; ``meta`` holds ``stage``, ``rows`` and, on the
opening event, ``passes``), ``tool``, ``stdout``, ``stderr``, and ``verdict`` (``meta`` holds ``checks``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import let

GAP, REPLAY, SLOWEST = 3.0, 0.35, 1.2
OUTPUT = ("stdout", "stderr")
CHECKS = "array<struct<name:string,status:string>>"


def _order() -> Window:
    return Window.partitionBy("run").orderBy("idx")


def tally(events: DataFrame) -> DataFrame:
    return events.groupBy("run", "kind", "status").agg(F.count(F.lit(1)).alias("n"))


def told(name: str) -> Column:
    """An entry of ``meta``, null where it is blank; lists there are JSON text."""
    return F.nullif(F.trim(F.try_element_at("meta", F.lit(name))), F.lit(""))


def checks() -> Column:
    """Checks that a verdict reports; none for other events."""
    none = F.array().cast(CHECKS)
    return F.when(F.col("kind") == "verdict", F.coalesce(F.from_json(told("checks"), CHECKS), none)).otherwise(none)


STATUSES = ("pass", "fail", "unresolved")


def check_counts() -> Column:
    """How many checks of an event passed, failed, or are unresolved; the text is parsed once."""
    count = lambda found, s: F.size(F.filter(found, lambda c: c["status"] == s.upper())).cast("bigint").alias(s)
    return let(checks(), lambda found: F.struct(*[count(found, s) for s in STATUSES]))


def _is(*labels: str) -> Column:
    return (F.col("kind") == "state") & F.col("label").isin(*labels)


def gaps(events: DataFrame, least: float = GAP) -> DataFrame:
    """Elapsed time, the gap before each event, and, for long gaps, the step in flight: the last tool event, if it is ``running``."""
    w = _order()
    tool = F.last(F.when(F.col("kind") == "tool", F.struct("label", "status")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = events.withColumn("elapsed", F.col("at") - F.first("at").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("gap", F.col("at") - F.lag("at").over(w))
    return e.withColumn("in_flight", F.when((F.col("gap") >= least) & (tool["status"] == "running"), tool["label"]))


def replay(events: DataFrame, speed: float = 1.0) -> DataFrame:
    """Delay before each event: a share of the real gap, capped; and what the command line waits."""
    e = events.withColumn("gap", F.coalesce(F.col("at") - F.lag("at").over(_order()), F.lit(0.0)))
    return e.withColumn("delay", F.least(F.col("gap") * REPLAY, F.lit(SLOWEST)) / speed).withColumn("cli_delay", F.least(F.col("gap") / max(speed, 0.1), F.lit(SLOWEST)))


def _on_islands(events: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Events of ``kinds`` with the number of their island; an event of any other kind ends one."""
    w, inside = _order(), F.col("kind").isin(*kinds)
    starts = (inside & ~F.coalesce(F.lag("kind").over(w).isin(*kinds), F.lit(False))).cast("int")
    return events.withColumn("starts", starts).withColumn("island", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(inside)


def islands(events: DataFrame, kinds: tuple[str, ...] = OUTPUT) -> DataFrame:
    """Runs of consecutive events of some kinds: ``run, island, first, last, n``."""
    return _on_islands(events, kinds).groupBy("run", "island").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count(F.lit(1)).alias("n"))


def folded_output(events: DataFrame, kinds: tuple[str, ...] = OUTPUT, shown: int = 8) -> DataFrame:
    """Output of each island: non-blank lines, those on the error stream, the last line, and the last few."""
    line = _on_islands(events, kinds).select("run", "island", "idx", "kind", F.posexplode(F.split("body", "\n")).alias("pos", "line")).where("trim(line) <> ''")
    rank = Window.partitionBy("run", "island").orderBy(F.desc("idx"), F.desc("pos"))
    tail = line.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= shown).groupBy("run", "island").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "line")), asc=False), lambda x: x["line"]).alias("tail"))
    n = line.groupBy("run", "island").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("kind") == "stderr").alias("n_errors"))
    return n.join(tail, ["run", "island"]).withColumn("last", F.element_at("tail", -1))


def throttled(deltas: DataFrame, size: int = 250) -> DataFrame:
    """Text deltas regrouped as they are flushed: when ``size`` characters have gathered, and at the end: ``run, flush, body``.

    What is flushed depends on all before it, so a run is read in order by one task, which streams its sorted events and holds only the text not
    yet flushed.  Null bodies are empty; a null run is a run of its own; a run without text has no row.
    """
    schema = T.StructType([deltas.schema["run"], T.StructField("flush", T.IntegerType()), T.StructField("body", T.StringType())])

    def flush(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held, length, n, begun, kind = None, [], 0, 0, False, None
        for batch in batches:
            kind, out = batch.schema.field("run").type, []
            for r, body in zip(batch.column("run").to_pylist(), batch.column("body").to_pylist()):
                if not begun or r != run:
                    if held:
                        out.append((run, n, "".join(held)))
                    run, held, length, n, begun = r, [], 0, 0, True
                if body:
                    held.append(body)
                    length += len(body)
                if length >= size:
                    out.append((run, n, "".join(held)))
                    held, length, n = [], 0, n + 1
            yield _flushed(out, kind)
        if held:
            yield _flushed([(run, n, "".join(held))], kind)

    ordered = deltas.select("run", "idx", "body").repartition("run").sortWithinPartitions("run", "idx", "body")
    return ordered.select("run", "body").mapInArrow(flush, schema)


def _flushed(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    run, n, body = zip(*rows) if rows else ((), (), ())
    return pa.record_batch([pa.array(run, kind), pa.array(n, pa.int32()), pa.array(body, pa.string())], names=["run", "flush", "body"])


def reassembled(deltas: DataFrame, totals: DataFrame) -> DataFrame:
    """Bodies of deltas joined in order, checked against the total length that the closing event states."""
    text = deltas.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "body"))), lambda x: x["body"]), "").alias("text"))
    return text.join(totals, "run", "left").withColumn("complete", F.length("text") == F.col("total"))


def failed_stage(events: DataFrame) -> DataFrame:
    """Stage of the last event that says attempts ran out, empty if it names none; runs without one have no row."""
    return events.where(_is("exhausted")).groupBy("run").agg(F.max_by(F.coalesce(told("stage"), F.lit("")), "idx").alias("failed_stage"))


def running_score(events: DataFrame) -> DataFrame:
    """After each event: attempts, rows, stage, and checks so far: of all verdicts (``all_*``) and of the latest of each stage (``latest_*``)."""
    w = _order().rowsBetween(Window.unboundedPreceding, 0)
    state = F.col("kind") == "state"
    last = lambda c: F.last(F.when(state, c), ignorenulls=True).over(w)
    e = events.withColumn("said", check_counts())
    e = e.withColumn("attempts", F.count_if(_is("attempt")).over(w)).withColumn("rows", last(F.nullif(told("rows").try_cast("bigint"), F.lit(0)))).withColumn("stage", last(told("stage")))
    # What a verdict adds to the latest ones: its checks less those of the verdict before it on the same stage.
    before = Window.partitionBy("run", F.col("kind") == "verdict", F.coalesce(told("stage"), F.col("stage"))).orderBy("idx")
    for s in STATUSES:
        n = F.col(f"said.{s}")
        e = e.withColumn(f"all_{s}", F.sum(n).over(w)).withColumn(f"latest_{s}", n - F.coalesce(F.lag(n).over(before), F.lit(0)))
    return e.withColumns({f"latest_{s}": F.sum(f"latest_{s}").over(w) for s in STATUSES}).drop("said")


def stage_states(events: DataFrame) -> DataFrame:
    """Stages of each run: ``run, stage, position, state, outcomes, attempts, bad``.

    Passes that the opening event announces come first and are ``seen`` until they start, others follow as they appear.  Each attempt has an
    outcome: ``ok``, ``bad``, or ``live`` while nothing has been said of it.
    """
    moves = events.where((F.col("kind") == "state") & told("stage").isNotNull()).select("run", "idx", "label", told("stage").alias("stage"))
    n = F.count_if(F.col("label") == "attempt").over(Window.partitionBy("run", "stage").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    said = F.when(F.col("label") == "accepted", "ok").when(F.col("label") == "rejected", "bad")
    moved = F.when(F.col("label").isin("attempt", "accepted", "rejected", "exhausted"), F.col("idx"))
    tries = moves.withColumn("n", n).groupBy("run", "stage", "n").agg(
        F.coalesce(F.max_by(said, F.when(said.isNotNull(), F.col("idx"))), F.lit("live")).alias("outcome"), F.max_by("label", moved).alias("last"), F.max(moved).alias("at"), F.min("idx").alias("first")
    )
    attempt = F.when(F.col("n") > 0, F.struct("n", "outcome"))
    seen = tries.groupBy("run", "stage").agg(F.max_by("last", "at").alias("last"), F.min("first").alias("first"), F.transform(F.array_sort(F.collect_list(attempt)), lambda x: x["outcome"]).alias("outcomes"))
    opening = events.groupBy("run").agg(F.min_by(F.struct("kind", told("passes").alias("passes")), "idx").alias("o")).where("o.kind = 'state'")
    named = opening.select("run", F.posexplode(F.split("o.passes", ",")).alias("k", "stage")).withColumn("stage", F.trim("stage")).where("stage <> ''").groupBy("run", "stage").agg(F.min("k").alias("k"))
    state = F.when(F.col("last") == "accepted", "done").when(F.col("last") == "exhausted", "failed").when(F.col("last").isNotNull(), "current").otherwise("seen")
    position = F.row_number().over(Window.partitionBy("run").orderBy(F.asc_nulls_last("k"), "first"))
    every = named.join(seen, ["run", "stage"], "full").withColumn("outcomes", F.coalesce("outcomes", F.array().cast("array<string>")))
    return every.select("run", "stage", position.alias("position"), state.alias("state"), "outcomes", F.size("outcomes").alias("attempts"), F.size(F.filter("outcomes", lambda x: x == "bad")).alias("bad"))


def closing_card(events: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """One row per run: won, elapsed, events, rows, attempts and checks by status.  A recorded verdict counts; without one, no failed check."""
    rows = F.nullif(told("rows").try_cast("bigint"), F.lit(0))
    card = events.withColumn("said", check_counts()).groupBy("run").agg(
        F.count(F.lit(1)).alias("events"), (F.max_by("at", "idx") - F.min_by("at", "idx")).alias("elapsed"), F.max_by(rows, F.when((F.col("kind") == "state") & rows.isNotNull(), F.col("idx"))).alias("rows"),
        F.count_if(_is("attempt")).alias("attempts"), F.sum("said.pass").alias("passed"), F.sum("said.fail").alias("failed"), F.sum("said.unresolved").alias("unresolved"),
    )
    clean = F.col("failed") == 0
    if summaries is None:
        return card.withColumn("won", clean)
    return card.join(summaries.select(F.col("run_id").alias("run"), "accepted"), "run", "left").withColumn("won", F.coalesce("accepted", clean)).drop("accepted")


def jump_targets(events: DataFrame, check: str) -> DataFrame:
    """Last verdict that reports a named check, and the first attempt of each stage."""
    named = events.where(F.exists(checks(), lambda c: c["name"] == check)).groupBy("run").agg(F.max("idx").alias("idx")).select("run", F.lit("check").alias("what"), F.lit(check).alias("name"), "idx")
    first = events.where(_is("attempt") & told("stage").isNotNull()).groupBy("run", told("stage").alias("name")).agg(F.min("idx").alias("idx")).select("run", F.lit("stage").alias("what"), "name", "idx")
    return named.unionByName(first)
