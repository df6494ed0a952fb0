"""Readers: statements, reference lists, runs, traces, answers, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import amount, normalise
from ledgerloom.operators import layout
from ledgerloom.schemas import EVENT, JOURNAL_LINE, RUN_SUMMARY

WORDS = "doc string, page int, text string, x0 double, x1 double, top double, bottom double"


def words(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Positioned words, as any PDF tool writes them."""
    return spark.read.format(fmt).schema(WORDS).load(path)


def statements(spark: SparkSession, path: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Parse all documents of a words table; their order is that of their names."""
    return layout.parse(words(spark, path, fmt))


def list_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A reference list from a sheet: columns without a header go, cells are normalised, blank rows go.

    ``columns`` are compared without case; a list none of whose columns is there raises.
    """
    wanted = None if columns is None else {" ".join(c.split()).casefold() for c in columns}
    keep = [c for c in df.columns if c.strip() and not c.startswith("_c") and (wanted is None or " ".join(c.split()).casefold() in wanted)]
    if not keep:
        raise ValueError("the sheet has none of the columns")
    out = df.select(*[normalise(F.col(f"`{c}`")).alias(" ".join(c.split())) for c in keep])
    return out.where(F.greatest(F.lit(0), *[F.length(F.col(f"`{c}`")) for c in out.columns]) > 0)


def reference_lists(spark: SparkSession, sheets: dict[str, dict]) -> dict[str, DataFrame]:
    """Mount lists: ``alias -> {"path", "format", "columns"}``; nothing declared, nothing mounted."""
    out = {}
    for alias, spec in (sheets or {}).items():
        reader = spark.read.format(spec.get("format", "csv"))
        if spec.get("format", "csv") == "csv":
            reader = reader.option("header", True).option("multiLine", True)
        out[alias] = list_table(reader.load(spec["path"]), spec.get("columns"))
    return out


def first_existing(spark: SparkSession, candidates: list[str], pattern: str = "*") -> str:
    """First candidate path that holds a file of the pattern; an empty folder does not count."""
    for path in candidates:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            continue
        if not fs.getFileStatus(p).isDirectory():
            return path
        found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(p, pattern))
        if found:
            return min(f.getPath().toString() for f in found)
    raise FileNotFoundError(", ".join(candidates))


def row_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON files: a list, or an object with ``rows``; items that are no objects go."""
    text = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.col("value"))
    body = F.coalesce(F.get_json_object("value", "$.rows"), F.col("value"))
    items = text.select("file", F.posexplode(F.from_json(body, T.ArrayType(T.StringType()))).alias("row_index", "item"))
    return items.where(F.trim("item").startswith("{")).select("file", "row_index", F.from_json("item", schema).alias("r")).select("file", "row_index", "r.*")


def coerced(rows: DataFrame, money: tuple[str, ...] = ("credit", "debit", "balance")) -> DataFrame:
    """Amounts of agent rows as decimals, page 1 where none is given, and ``problems`` instead of exceptions."""
    bad = F.array(*[F.when((F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "") & amount(c).isNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in money])
    out = rows.withColumn("problems", F.filter(bad, lambda x: x.isNotNull())).withColumns({c: amount(c) for c in money})
    return out.withColumn("page", F.coalesce(F.col("page").try_cast("int"), F.lit(1)) if "page" in rows.columns else F.lit(1))


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Run summaries (one JSON file each), newest first; an unreadable one has only its id."""
    found = spark.read.option("wholetext", True).text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("folder"), F.from_json("value", RUN_SUMMARY).alias("s"))
    return found.select(F.coalesce("s.run_id", "folder").alias("run_id"), *[F.col(f"s.{f.name}").alias(f.name) for f in RUN_SUMMARY.fields if f.name != "run_id"]).orderBy(F.desc("run_id"))


def trace(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON-lines traces with their run (the folder) and ``idx``, their position in it from 0."""
    file = F.col("_metadata.file_path")
    e = spark.read.schema(EVENT).json(path).select("*", file.alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("k"))
    e = e.withColumn("run", F.element_at(F.split("f", "/"), -2)).withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("bigint")))
    place = F.row_number().over(Window.partitionBy("run").orderBy("f", "b", "k")) - 1  # a block's lines are read in order
    return e.withColumn("idx", place.cast("bigint")).drop("f", "b", "k")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Name, SHA-256 and size of each file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def intake(files: DataFrame, largest: int = 40 << 20) -> DataFrame:
    """Uploaded files (``binaryFile`` columns) with ``ok``: a PDF by name and first bytes, and of a fair size."""
    name = F.element_at(F.split("path", "/"), -1)
    ok = name.rlike(r"(?i)^[\w .()-]+\.pdf$") & F.col("length").between(1, largest) & (F.substring("content", 1, 4) == F.lit(b"%PDF"))
    return files.withColumn("ok", ok)


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """Extracted metrics; a line that does not fit the schema raises."""
    from ledgerloom.schemas import EXTRACTED_METRIC

    return spark.read.schema(EXTRACTED_METRIC).option("mode", "FAILFAST").json(path)


def journal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOURNAL_LINE).json(path)
