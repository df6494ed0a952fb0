"""Streams: late and expired runs, the states of the batch query, and batches that are kept once."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import events
from ledgerloom.sources import readers
from ledgerloom.streaming import events as stream


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.STORE)


def put(folder, run, name, *moves):
    """A trace file of ``(label, stage, at)`` events, older files first."""
    (folder / run).mkdir(parents=True, exist_ok=True)
    path = folder / run / name
    path.write_text("\n".join(json.dumps({"kind": "state", "label": label, "status": "ok", "meta": {"stage": stage}, "at": at}) for label, stage, at in moves))
    age = len(list(folder.rglob("*.jsonl")))
    os.utime(path, (1_700_000_000 + age, 1_700_000_000 + age))


def states(spark, folder, checkpoint, **options):
    out = []
    e = stream.read(spark, str(folder), files_per_trigger=1)
    q = stream.stage_states(e, **options).writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).outputMode("update").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return out


def test_states_equal_the_batch_query_and_runs_expire(spark, tmp_path):
    folder = tmp_path / "in"
    put(folder, "r1", "1.jsonl", ("attempt", "s", 1000.0), ("rejected", "s", 1010.0), ("attempt", "t", 1015.0))
    put(folder, "r2", "1.jsonl", ("attempt", "s", 1020.0))
    put(folder, "r1", "2.jsonl", ("attempt", "s", 1030.0), ("accepted", "s", 1040.0), ("exhausted", "t", 1045.0))
    put(folder, "r2", "2.jsonl", ("accepted", "s", 1050.0))
    got = states(spark, folder, tmp_path / "c", late="60 seconds", expire_seconds=10_000)
    assert not any(r[5] for r in got)
    last = {r[:2]: r[2:5] for r in got}  # the last row of a stage is its state
    batch = events.stage_states(readers.trace(spark, str(folder) + "/*/*.jsonl"))
    assert last == {(r.run, r.stage): (r.state, r.attempts, r.bad) for r in batch.collect()}

    # Time goes on: r1 and r2 end, an event that comes too late changes nothing, and r3 is under way.
    put(folder, "r3", "1.jsonl", ("attempt", "s", 20_000.0))
    put(folder, "r3", "2.jsonl", ("rejected", "s", 20_100.0))
    put(folder, "r1", "3.jsonl", ("rejected", "s", 1041.0))
    put(folder, "r3", "3.jsonl", ("accepted", "s", 20_200.0))
    more = states(spark, folder, tmp_path / "c", late="60 seconds", expire_seconds=10_000)
    assert sorted(r for r in more if r[5]) == [("r1", "s", "done", 2, 1, True), ("r1", "t", "failed", 1, 0, True), ("r2", "s", "done", 1, 0, True)]
    assert [r for r in more if not r[5]][-1] == ("r3", "s", "done", 1, 1, False)
    assert not [r for r in more if r[0] == "r1" and not r[5]]


def test_a_repeated_batch_is_kept_once(spark, tmp_path):
    folder, kept, checkpoint = tmp_path / "in", str(tmp_path / "kept"), tmp_path / "c"
    for k in range(3):
        put(folder, f"r{k}", "1.jsonl", ("attempt", "s", 10.0 * k), ("accepted", "s", 10.0 * k + 1))
    e = lambda: stream.read(spark, str(folder), files_per_trigger=1)
    stream.subscribe(e(), stream.keep_once(kept), str(checkpoint), once=True).awaitTermination(240)
    rows = stream.kept(spark, kept)
    assert rows.count() == 6 and rows.select("batch").distinct().count() == 3

    # A crash after the last batch was written and before Spark noted it: the batch runs again.
    for name in ("2", ".2.crc"):
        (checkpoint / "commits" / name).unlink(missing_ok=True)
    calls = []
    keep = stream.keep_once(kept)
    stream.subscribe(e(), lambda df, n: (calls.append(n), keep(df, n)), str(checkpoint), once=True).awaitTermination(240)
    assert calls == [2] and stream.kept(spark, kept).count() == 6

    # A crash while it was being written: what lies aside is not read, and the batch is kept when it runs again.
    (tmp_path / "kept" / "batch=2").rename(tmp_path / "kept" / "_aside" / "2-half")
    for name in ("2", ".2.crc"):
        (checkpoint / "commits" / name).unlink(missing_ok=True)
    assert stream.kept(spark, kept).count() == 4
    stream.subscribe(e(), keep, str(checkpoint), once=True).awaitTermination(240)
    assert stream.kept(spark, kept).groupBy("run").agg(F.count(F.lit(1)).alias("n")).where("n <> 2").count() == 0 and stream.kept(spark, kept).count() == 6
