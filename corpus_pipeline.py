"""Corpus pipeline: quality rules, exact dedup, SimHash near-dedup, substring dedup, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on every row that the stage before it kept.  All stages but the
last return the columns of ``documents``; ``run`` writes each stage's rows to the shared folder and goes on from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm._storage import written
from ledgerloom.llm.exact_dedup import drop_copies
from ledgerloom.llm.packing import pack
from ledgerloom.llm.quality import keep_good
from ledgerloom.llm.queries import tokenizer_path
from ledgerloom.llm.simhash import drop_near_copies
from ledgerloom.llm.substring_dedup import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go from every text; documents that the rules reject go, those without a word among them.

    Repeated rows get the same verdict; an empty table stays empty.
    """
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays.

    Null counts as the empty text and a null id as the largest; of repeated rows one stays; an empty table stays empty.
    """
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the document with the smallest id stays.

    Null and empty texts are near copies of each other; of repeated rows one stays; an empty table stays empty.
    """
    return drop_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that start anywhere else too go; a text that loses nothing is unchanged, but for null, which becomes empty.

    Repeated rows remove each other; other columns pass through, null or not; an empty table stays empty.
    """
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = remove_repeats(docs, carry=carry, keep_layout=True)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    return cut.select(*[new.get(c, F.col(f"`in_{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as pieces of sequences of 1024 tokens.

    A null or empty text is its end id alone; repeated rows are packed each; an empty table gives no piece.
    """
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]

#: XXH64 fingerprints and byte-level token ids have no SQL form; tests/llm compare ``run`` with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
