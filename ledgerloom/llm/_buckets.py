"""Packed key exchange: ask, for every key of every document, what the whole corpus knows about it.

Shuffling one row per n-gram would move several times the corpus.  Here documents are dealt into buckets of a
few megabytes; a bucket sends its *distinct* keys, sorted and packed, to the blocks that own ranges of the key
space, and gets one packed answer per block back in the same order.  A key that a third of all rows hold is
therefore sent once per bucket, and every block owns an even share of the hash space.

The three steps are ordinary grouped Arrow stages (bucket -> block -> bucket), so Spark shuffles, retries and
spills them; nothing passes through the driver but the corpus size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._storage import bounded_batches

U64 = np.uint64
BUCKET_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
ASK = "round int, block int, bucket int, keys binary, extra binary"
REPLY = "round int, block int, bucket int, answer binary"


def corpus_bytes(docs: DataFrame, text: str) -> int:
    """Size of the texts; one number, from one aggregation over the column."""
    bounded_batches(docs.sparkSession)
    return int(docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0)


def grown(size: int, least: int, most: int, parts: int = 20_000) -> int:
    """Bytes of a part: ``least`` as long as that makes ``parts`` parts or fewer, then more, up to ``most``.

    Questions are one row per bucket and block, so neither number may grow with the input for ever.
    """
    return min(most, max(least, size // parts))


def deal(docs: DataFrame, by: list[str], size: int, bucket_bytes: int | None = None) -> tuple[DataFrame, int]:
    """Add ``__bucket`` from the hash of the columns ``by`` and shuffle documents to their buckets."""
    n = max(8, math.ceil(size / (bucket_bytes or grown(size, BUCKET_BYTES, 128 << 20))))
    dealt = docs.withColumn("__bucket", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in by]), F.lit(n)).cast("int"))
    return dealt.repartition(max(n // 3, 8), "__bucket"), n


def block_count(size: int, block_bytes: int | None = None) -> int:
    return max(4, math.ceil(size / (block_bytes or grown(size, BLOCK_BYTES, 256 << 20))))


def bounds(blocks: int) -> np.ndarray:
    """First key of each block but the first: equal ranges of the 64-bit key space."""
    return np.array([(i << 64) // blocks for i in range(1, blocks)], dtype=np.uint64)


def ask(round_: int, bucket: int, keys: np.ndarray, extra: np.ndarray | None, blocks: int) -> pa.RecordBatch:
    """One row per block for a bucket's distinct sorted keys; ``extra`` is a value per key."""
    cut = np.r_[0, np.searchsorted(keys, bounds(blocks)), len(keys)]
    full = np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(full), round_, np.int32)),
            pa.array(full.astype(np.int32)),
            pa.array(np.full(len(full), bucket, np.int32)),
            pa.array([keys[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary()),
            pa.array([extra[cut[i] : cut[i + 1]].tobytes() if extra is not None else b"" for i in full], pa.binary()),
        ],
        names=["round", "block", "bucket", "keys", "extra"],
    )


def answered(asks: DataFrame, answer: Callable[[np.ndarray, bytes, np.ndarray], np.ndarray]) -> DataFrame:
    """Group questions by block and let ``answer(keys, extra, owner)`` reply.

    ``answer`` gets the concatenated keys of all buckets, their concatenated ``extra`` bytes and the bucket of each key, and returns an
    array with one entry per key; it is cut back into one packed reply per bucket.
    """

    def reply(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        parts = [np.frombuffer(k.as_buffer(), U64) for k in table.column("keys")]
        extra = b"".join(x.as_py() for x in table.column("extra"))
        sizes = [len(p) for p in parts]
        out = answer(np.concatenate(parts), extra, np.repeat(table.column("bucket").to_numpy(), sizes))
        ends = np.cumsum(sizes)
        packed = [out[e - len(p) : e].tobytes() for p, e in zip(parts, ends.tolist())]
        return pa.table(
            [table.column("round"), table.column("block"), table.column("bucket"), pa.array(packed, pa.binary())],
            names=["round", "block", "bucket", "answer"],
        )

    return asks.groupBy("block").applyInArrow(reply, REPLY)


def read_answers(table: pa.Table, round_: int, dtype) -> np.ndarray:
    """Answers of one round for one bucket, aligned with the sorted keys it asked for."""
    rounds, blocks = table.column("round").to_numpy(), table.column("block").to_numpy()
    pick = np.flatnonzero(rounds == round_)
    pick = pick[np.argsort(blocks[pick], kind="stable")]
    cells = table.column("answer")
    return np.frombuffer(b"".join(cells[int(i)].as_py() for i in pick), dtype)


def seen_twice(keys: np.ndarray, many: bytes, _: np.ndarray) -> np.ndarray:
    """Per key: does it occur twice or more, in two buckets or (``many``) twice in one?"""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = counts > 1
    twice[inverse[np.frombuffer(many, np.uint8) > 0]] = True
    return twice[inverse].astype(np.uint8)
