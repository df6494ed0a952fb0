"""WARC archives: write records, read them back, and merge their capture indexes.

* **Writing.**  Records are built as strings with DataFrame functions and written by Spark's text writer with the record
  separator as line separator, so files are committed like any other output and no task writes by itself.  A payload that occurred
  before (same SHA-256, ``MIN_REVISIT`` bytes or more) becomes a *revisit* record without payload.
* **Reading.**  Archives are read whole (their size is bounded by ``records_per_file``) and cut by ``Content-Length``.  The digest
  and size of a response come from its payload; a revisit takes those of the response it refers to.
* **External index merge.**  The captures of an archive, sorted by URL key, time and id, are a *run*.  Runs are cut at range bounds that a
  bounded sample of keys gives; each range merges its slices of all runs with a k-way loser tree.  Bounds are whole
  sort keys, so a URL with very many captures spreads over ranges.  Ranges in order are the global capture history.

Edge cases: a null payload is empty; a null URL is written as an empty target; line breaks in a URL are percent-encoded; a null id is
written as an empty id, read as null and larger than any other; rows with equal ids and payloads are all responses if theirs is the smallest id;
an empty table gives an empty archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm._storage import new_path, written

MIN_REVISIT = 100
RECORDS_PER_FILE = 4000
RANGE_ROWS = 50_000
SAMPLED_KEYS = 20_000
EPOCH = "2024-01-01 00:00:00"
BREAK = "\r\n"
CAPTURES = "archive string, offset long, length long, record_type string, id string, url string, time string, digest string, payload_bytes long, refers_to string"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None) -> DataFrame:
    """One WARC record per row, as ``value``; without ``time_col`` a capture is dated by its id, in seconds after ``EPOCH``."""
    key, payload = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    time = F.col(f"`{time_col}`").cast("timestamp_ntz") if time_col else F.lit(EPOCH).cast("timestamp_ntz") + F.make_interval(secs=F.coalesce(F.pmod(F.try_to_number(key.cast("string"), F.lit("999999999999999999")), F.lit(10**9)), F.lit(0)).cast("decimal(18,6)"))
    rows = pages.select(
        key.alias("id"), F.coalesce(F.regexp_replace(F.regexp_replace(F.col(f"`{url_col}`").cast("string"), "\r", "%0D"), "\n", "%0A"), F.lit("")).alias("url"),
        payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("bytes"), F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"),
    )
    twice = rows.where(F.col("bytes") >= MIN_REVISIT).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = rows.join(twice, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:capture:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat_ws(BREAK, F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.col("bytes")), F.lit(BREAK))
    body = F.concat(http, F.when(again, "").otherwise(F.col("payload")))
    field = lambda k, v: F.concat(F.lit(f"{k}: "), v)
    head = F.concat_ws(
        BREAK, F.lit("WARC/1.1"), field("WARC-Type", F.when(again, "revisit").otherwise("response")), field("WARC-Record-ID", name(F.col("id"))),
        field("WARC-Date", F.col("time")), field("WARC-Target-URI", F.col("url")), field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), F.when(again, field("WARC-Refers-To", name(F.col("first")))),
        F.lit("Content-Type: application/http; msgtype=response"), field("Content-Length", F.octet_length(body).cast("string")), F.lit(BREAK),
    )
    return rows.select(F.concat(head, body).alias("value"))


def write(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, **columns) -> None:
    """Write the rows of ``pages`` to gzipped archives of at most ``records_per_file`` records under ``path``."""
    out = records(pages, **columns).write.option("lineSep", BREAK * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file)
    out.text(path)


_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*\r?$", re.M)


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, header fields and block of each record of an archive."""
    at = 0
    while at < len(data):
        if data[at : at + 2] in (b"\r\n",):  # separators between records
            at += 2
            continue
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at) + 4
        fields = {k.decode().lower(): v.decode() for k, v in _FIELD.findall(data, at, end)}
        last = end + int(fields["content-length"])
        if last > len(data):
            raise ValueError(f"record at byte {at} is cut short")
        yield at, last - at, fields, data[end:last]
        at = last


def _capture(archive: str, at: int, length: int, fields: dict[str, str], block: bytes) -> tuple:
    name = lambda k: (fields.get(k) or "")[len("<urn:capture:") : -1] or None
    kind = fields["warc-type"]
    if kind == "response":
        payload = memoryview(block)[block.index(b"\r\n\r\n") + 4 :]
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
    else:
        digest, size = fields["warc-payload-digest"].partition(":")[2], None
    return archive, at, length, kind, name("warc-record-id"), fields["warc-target-uri"], fields["warc-date"], digest, size, name("warc-refers-to")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``: the columns of ``CAPTURES``; revisits have no size yet."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").schema("path string, modificationTime timestamp, length long, content binary").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CAPTURES.split(", ")]
        for batch in batches:
            for archive, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = [_capture(archive, *r) for r in parse(zlib.decompress(content.as_buffer(), 31))]
                types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return files.mapInArrow(run, CAPTURES)


def resolve(captures: DataFrame) -> DataFrame:
    """Give revisits the size of the response that they refer to; their digests must agree."""
    full = captures.where("record_type = 'response'").groupBy(F.col("id").alias("refers_to"), "digest").agg(F.max("payload_bytes").alias("found"))
    joined = captures.join(full, ["refers_to", "digest"], "left")
    return joined.withColumn("payload_bytes", F.coalesce("payload_bytes", "found")).select(*captures.columns)


def url_key(url: str) -> str:
    """Sort-friendly form of a URL: host labels reversed, then path and query, without scheme, fragment or case of the host."""
    rest = url.partition("#")[0]
    rest = rest.partition("://")[2] or rest
    host, slash, tail = rest.partition("/")
    host = host.rpartition("@")[2].lower()
    host, _, port = host.partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + slash + tail


class LoserTree:
    """Merge of sorted lists: inner nodes hold the losers of their matches, so each output costs one path of comparisons."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.node = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.at[a], self.at[b]
        if x == len(self.runs[a]) or y == len(self.runs[b]):
            return y == len(self.runs[b]) and (x < len(self.runs[a]) or a < b)
        p, q = self.runs[a][x], self.runs[b][y]
        return (p, a) < (q, b)

    def _play(self, winner: int) -> None:
        """Climb from a leaf; an empty node (first round only) holds its visitor."""
        n = (winner + self.k) // 2
        while n > 0:
            held = self.node[n]
            if held < 0:
                self.node[n] = winner
                return
            if self._less(held, winner):
                self.node[n], winner = winner, held
            n //= 2
        self.node[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        for _ in range(sum(map(len, self.runs))):
            best = self.node[0]
            yield self.runs[best][self.at[best]]
            self.at[best] += 1
            self._play(best)


def _order(url: str | None, time: str | None, key: str | None) -> tuple:
    number = key is not None and key.isdecimal()
    return url_key(url or ""), time or "", key is None, (int(key) if number else 0), key or ""


def merge_index(captures: DataFrame, range_rows: int = RANGE_ROWS, sampled: int = SAMPLED_KEYS) -> DataFrame:
    """Captures in global order: adds ``url_key``, ``capture_range`` and ``history_pos`` (0-based over all captures).

    At most ``sampled`` keys (in expectation) are looked at to choose range bounds, whatever the number of captures.
    """
    spark = captures.sparkSession
    rows = captures.count()
    ranges = max(1, -(-rows // range_rows))
    some = captures.select("url", "time", "id").sample(min(1.0, sampled / max(rows, 1)), 7).collect() if ranges > 1 else []
    keys = sorted(_order(*r) for r in some)
    bounds = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []
    names = captures.columns
    schema = captures.schema

    def runs(table: pa.Table) -> pa.Table:
        """Sort the captures of one archive and cut the run at the bounds."""
        order = [_order(*r) for r in zip(*(table.column(c).to_pylist() for c in ("url", "time", "id")))]
        by = sorted(range(len(order)), key=order.__getitem__)
        part = [bisect_right(bounds, order[i]) for i in by]
        table = table.take(pa.array(by, pa.int64()))
        return table.append_column("capture_range", pa.array(part, pa.int32())).append_column("seq", pa.array(range(len(by)), pa.int64()))

    def merged(table: pa.Table) -> pa.Table:
        """Merge the slices of all runs that fall into one range."""
        table = table.combine_chunks()
        order = [_order(*r) for r in zip(*(table.column(c).to_pylist() for c in ("url", "time", "id")))]
        archive = table.column("archive").to_pylist()
        slices: dict[str, list[int]] = {}
        for i in np.argsort(table.column("seq").to_numpy(), kind="stable").tolist():  # rows of a run, in the run's order
            slices.setdefault(archive[i], []).append(i)
        by = [x[-1] for x in LoserTree([[(*order[i], i) for i in run] for run in slices.values()])]
        out = table.take(pa.array(by, pa.int64())).drop_columns(["seq"])
        out = out.append_column("url_key", pa.array([order[i][0] for i in by], pa.string()))
        return out.append_column("pos", pa.array(range(len(by)), pa.int64()))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    cut = captures.groupBy("archive").applyInArrow(runs, f"{fields}, capture_range int, seq long")
    placed = written(cut.groupBy("capture_range").applyInArrow(merged, f"{fields}, capture_range int, url_key string, pos long"), "captures")
    sizes = {r.capture_range: r.n for r in placed.groupBy("capture_range").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per range
    base, before = [], 0
    for r in sorted(sizes):
        base.append((r, before))
        before += sizes[r]
    starts = spark.createDataFrame(base, "capture_range int, base long")
    return placed.join(F.broadcast(starts), "capture_range").select(*names, "url_key", "capture_range", (F.col("base") + F.col("pos")).alias("history_pos"))


def archive_and_index(pages: DataFrame, records_per_file: int = RECORDS_PER_FILE, **columns) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and return the merged index."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, records_per_file, **columns)
    return merge_index(resolve(written(read(spark, path), "capture-runs")))
