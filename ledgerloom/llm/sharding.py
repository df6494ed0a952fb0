"""Shard store with size-tiered compaction and a versioned manifest, in DataFrame functions only.

* **Append.**  An arrival is written as small immutable shards (Parquet files of at most ``shard_rows`` rows), in place of where its
  partitions are: no shuffle.  The shards of one write are a *run*, a folder of its own; a run is live as a whole or not at all.
* **Manifest.**  A version is a table of the live shards (run, path, bytes, rows).  It is written beside the others and renamed into place;
  the rename fails if another writer took the version, so a version is there whole or not at all.  (That a rename is one step holds for HDFS
  and local disks; an object store needs a committer of its own.)  Readers see one version.
* **Compaction.**  Runs are of one *tier* if their bytes lie between the same powers of ``fanout``.  A tier is merged once it has ``fanout`` runs, and
  a single run whose shards are small although they would fill a file of ``target_bytes``.  A merge reads the tier's runs, coalesces them into
  target-sized files without a shuffle, and a new version swaps the runs.  Runs of shards of ``target_bytes`` / 2 or more are left alone.
* **Vacuum** deletes the runs that no kept version lists.

The driver looks at runs only (a few per tier and one per large arrival, as sums over the manifest), never at single shards; documents stay on the
executors.  Rows of a shard are counted from file footers.

Edge cases: nulls, empty and very long texts and repeated rows are kept as they are; an empty arrival adds no shard, and an
empty store reads as an empty table with the columns of its first arrival; columns may have any names, as shards hold nothing else.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_BYTES, SHARD_ROWS, FANOUT, LEAST_BYTES = 64 << 20, 2_000, 4, 64 << 10
MANIFEST = "run string, shard string, bytes bigint, rows bigint, since bigint"


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, shard_rows: int = SHARD_ROWS, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.shard_rows, self.fanout = spark, root.rstrip("/"), target_bytes, shard_rows, fanout
        self._fs = spark._jvm.org.apache.hadoop.fs

    # Manifest versions

    def _path(self, *parts: str):
        return self._fs.Path("/".join([self.root, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at = self._path("manifest")
        files = self._files()
        names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
        return sorted(int(n[2:]) for n in names if n.startswith("v-"))

    def manifest(self, version: int | None = None) -> DataFrame:
        """Live shards of a version (the last one by default)."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v-{version:010d}")

    def _runs(self, version: int | None = None) -> list:
        """Live runs of a version with their shards, bytes and rows."""
        sums = [F.count(F.lit(1)).alias("shards"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")]
        return self.manifest(version).groupBy("run").agg(*sums).orderBy("run").collect()

    def _commit(self, rows: DataFrame, version: int) -> int:
        """Make ``rows`` the manifest of ``version``; raises if that version exists."""
        draft = f"draft-{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(f"{self.root}/{draft}")  # one row per shard
        files = self._files()
        files.mkdirs(self._path("manifest"))
        none = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0)
        context = self._fs.FileContext.getFileContext(self._path().toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._path(draft), self._path("manifest", f"v-{version:010d}"), none)
        return version

    def _folder(self, run: str) -> str:
        return f"{self.root}/data/{run}"

    def _described(self, run: str, version: int) -> DataFrame:
        """Manifest rows of the shards of a run; no column is read, so the rows come from the files' footers."""
        data = self.spark.read.schema(self._schema()).parquet(self._folder(run))
        info = data.metadataColumn("_metadata")
        files = data.select(info["file_path"].alias("shard"), info["file_size"].alias("bytes")).groupBy("shard", "bytes").agg(F.count(F.lit(1)).alias("rows"))
        return files.select(F.lit(run).alias("run"), "shard", "bytes", "rows", F.lit(version).cast("bigint").alias("since"))

    # Operations

    def append(self, docs: DataFrame) -> int:
        """Write an arrival as small shards and commit them."""
        last, run = max(self.versions(), default=0), uuid.uuid4().hex
        docs.write.option("maxRecordsPerFile", self.shard_rows).option("compression", "zstd").parquet(self._folder(run))
        if not self._files().exists(self._path("schema")):
            self.spark.createDataFrame([], docs.schema).coalesce(1).write.parquet(f"{self.root}/schema")
        return self._commit(self.manifest(last).unionAll(self._described(run, last + 1)), last + 1)

    def tier(self, bytes_: int) -> int:
        return int(math.log(max(bytes_, LEAST_BYTES) / LEAST_BYTES, self.fanout) + 1e-9)

    def due(self) -> list[list]:
        """Tiers of similarly sized runs that a compaction merges now, each as its runs."""
        tiers = defaultdict(list)
        for run in self._runs():
            if run.bytes * 2 < self.target * run.shards:
                tiers[self.tier(run.bytes)].append(run)
        fills = lambda runs: sum(r.shards for r in runs) > 1 and sum(r.bytes for r in runs) >= self.target
        return [runs for _, runs in sorted(tiers.items()) if len(runs) >= self.fanout or fills(runs)]

    def compact(self) -> int:
        """Merge tiers that are due until none is; returns the last version."""
        while due := self.due():
            last = max(self.versions(), default=0)
            rows = self.manifest(last)
            for runs in due:
                names, run = [r.run for r in runs], uuid.uuid4().hex
                size = sum(r.bytes for r in runs)
                merged = self.spark.read.schema(self._schema()).parquet(*map(self._folder, names)).coalesce(max(1, math.ceil(size / self.target)))
                merged.write.option("compression", "zstd").parquet(self._folder(run))
                rows = rows.where(~F.col("run").isin(names)).unionAll(self._described(run, last + 1))
            self._commit(rows, last + 1)
        return max(self.versions(), default=0)

    def _schema(self):
        return self.spark.read.parquet(f"{self.root}/schema").schema

    def read(self, version: int | None = None) -> DataFrame:
        """Documents of a version."""
        runs = [self._folder(r.run) for r in self._runs(version)]
        schema = self._schema()
        return self.spark.read.schema(schema).parquet(*runs) if runs else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 1) -> int:
        """Delete the runs that none of the last ``keep`` versions lists; returns how many went."""
        live = {r.run for v in self.versions()[-keep:] for r in self._runs(v)}
        files, data = self._files(), self._path("data")
        runs = [s.getPath() for s in files.listStatus(data)] if files.exists(data) else []
        return sum(bool(files.delete(p, True)) for p in runs if p.getName() not in live)
