"""Writers: rows and checks per stage, results, traces, CSV export, notes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the CSV export, in order.
EXPORT = (
    "account", "row_id", "value_date", "post_date", "time", "direction", "amount", "currency", "balance", "classification", "counterparty", "counterparty_status",
    "project_code", "project_status", "ready_for_export", "review_reason", "narrative",
)


def write_rows(rows: DataFrame, path: str, stage: str, checks: DataFrame | None = None) -> None:
    """Rows (and checks) of a stage, in a folder per stage; a stage that is written again replaces its own folder only."""
    rows.write.mode("overwrite").parquet(f"{path}/rows/stage={stage}")
    if checks is not None:
        checks.write.mode("overwrite").parquet(f"{path}/checks/stage={stage}")


def result_json(rows: DataFrame, path: str) -> None:
    """Result rows as JSON lines; one document of a whole run would pass through one task."""
    rows.write.mode("overwrite").json(path)


def result_document(rows: DataFrame) -> DataFrame:
    """``{"rows": [...]}`` per scope, in row order: a statement's rows, not a corpus's."""
    body = F.struct(*[c for c in rows.columns if c != "scope"])
    return rows.groupBy("scope").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("row_index", body.alias("row")))).alias("rows"))).alias("document"))


def write_trace(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def csv_lines(rows: DataFrame, columns: tuple[str, ...] = EXPORT) -> DataFrame:
    """CSV lines with every cell quoted and quotes doubled; columns that are not there are empty."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit(""), F.lit('"'), F.lit('""')), F.lit('"'))
    return rows.select(F.concat_ws(",", *[cell(c) for c in columns]).alias("value"))


def export_csv(rows: DataFrame, path: str, columns: tuple[str, ...] = EXPORT) -> None:
    """The export as one folder of part files with CRLF line ends, which are the file in the order of their names: the first starts with a byte-order mark
    and the column names."""
    head = "\ufeff" + ",".join(f'"{c}"' for c in columns)
    first = rows.sparkSession.createDataFrame([(head,)], "value string").coalesce(1)
    first.unionAll(csv_lines(rows, columns)).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def _put(spark: SparkSession, path: str, content: str) -> None:
    """A small file, written aside and renamed into place over what was there, so that a reader sees the old one or the new one."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.FileContext.getFileContext(hadoop.Path(path).toUri(), spark._jsc.hadoopConfiguration())
    aside = hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    fs = aside.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(aside)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    files.rename(aside, hadoop.Path(path), over)


def write_summary(spark: SparkSession, folder: str, summary: dict) -> str:
    """``summary.json`` of a run; values that JSON has no form for are written as text."""
    _put(spark, f"{folder}/summary.json", json.dumps(summary, indent=2, default=str))
    return f"{folder}/summary.json"


def mark_latest(spark: SparkSession, root: str, run_id: str) -> None:
    """Say which run is the newest, for those who ask for none by name."""
    _put(spark, f"{root}/latest", run_id)


def latest(spark: SparkSession, root: str) -> str | None:
    """The run that was marked last, if one was."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/latest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.option("wholetext", True).text(f"{root}/latest").first()["value"].strip()


def notes(rows: DataFrame, checks: DataFrame, field_statuses: DataFrame, queue: DataFrame, shown: int = 6, items: int = 200) -> str:
    """A report for people: counts, statuses, checks that did not pass with their first evidence, rows to review.

    It is meant to be read, so it lists the first ``items`` rows of the queue and says how many there are.
    """
    n = rows.count()
    out = [f"{n} rows", ""]
    out += [f"{r['field']}: {r['status']} {r['n']}" for r in field_statuses.orderBy("field", "status").limit(items).collect()]
    bad = checks.where("status <> 'PASS'").orderBy("scope", "name").limit(items).collect()
    for c in bad:
        out += ["", f"{c['scope']} {c['name']}: {c['status']}, {c['detail']}", *["  " + x for x in (c["evidence"] or "").split("\n")[:shown] if x]]
    total = queue.count()
    out += ["", f"{total} to review"] + [f"{q['row_id']}: {q['reason']}" for q in queue.where("row_id IS NOT NULL").orderBy("row_id").limit(items).collect()]
    return "\n".join(out)


def any_failed(checks: DataFrame) -> bool:
    """Exit state of a verification: did a check fail?"""
    return not checks.where("status = 'FAIL'").isEmpty()
