"""Exact dedup by composable polynomial fingerprints.

A text is normalised (every run of ``[\\x20\\x09-\\x0D]`` becomes one space) and hashed as a polynomial modulo two
31-bit primes.  Fingerprints compose: ``F(xy) = F(x) * B**len(y) + F(y)``, so chunks are hashed on their own and
combined by length-shifted arithmetic.  A text of more than ``HUGE`` bytes is cut into chunk rows that any tasks hash in parallel; their shares are
added in one partial aggregation (``combine_chunks``, which also takes texts that are stored so).  Shorter ones are hashed chunk by chunk in their task.

Equal fingerprints (and lengths) only nominate: each nominated text is compared with the text of its group's first row, chunk by chunk, leaving at
the first difference.  A text that differs is classed by its SHA-256 instead.

Groups are never gathered: a group is a count and its first row's id and SHA-256 (partial aggregations over rows without text).  Texts are fetched by
id and SHA-256, which spreads the members of a group, and meet the first row's text in salted parts of ``SALTED`` members, each with a copy of it.

Edge cases: null counts as the empty text; empty texts are equal; a null id is larger than any other and stays only
if all ids of its group are null; of repeated rows (equal ids too) one row stays in ``drop_copies``, while the
digest marks all of them kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm._storage import bounded_batches, only, written
from ledgerloom.llm._words import _SPACE, slices, text_bytes

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1299709019)
CHUNK, HUGE, SALTED = 1 << 18, 8 << 20, 500
GAP = r"[\x20\x09-\x0D]+"
_tables: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """``base ** (0..n-1) % prime``, by doubling."""
    have = _tables.get((base, prime))
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), prime)) % np.uint64(prime)])
        _tables[base, prime] = have
    return have[:n]


def normalised(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of the texts with every white-space run as one space."""
    raw, offs = text_bytes(column)
    space = _SPACE[raw]
    again = np.zeros(len(raw), bool)
    again[1:] = space[1:] & space[:-1]
    inner = offs[1:-1]
    again[inner[inner < len(raw)]] = False
    keep = ~again
    out = np.where(space, np.uint8(32), raw)[keep]
    return out, np.r_[0, np.cumsum(keep)][offs]


def chunk_hashes(data: np.ndarray, offs: np.ndarray, base: int, prime: int) -> np.ndarray:
    """Polynomial of each range of ``data``; all ranges together within ``2 * CHUNK`` bytes or one range."""
    n, p = len(data), np.uint64(prime)
    up, down = _powers(base, prime, n + 1), _powers(pow(base, -1, prime), prime, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(data * up[:n][::-1], out=sums[1:])
    part = (sums[offs[1:]] - sums[offs[:-1]]) % p
    return part * down[n - offs[1:]] % p


def combine(left: np.ndarray, right: np.ndarray, right_len, base: int, prime: int):
    """Fingerprint of a concatenation from those of its parts."""
    return (left * np.uint64(pow(base, int(right_len), prime)) + right) % np.uint64(prime)


def fingerprint(data: np.ndarray, offs: np.ndarray, primes=PRIMES, chunk: int = CHUNK) -> np.ndarray:
    """Both polynomials of each text in one 62-bit integer."""
    out = np.zeros(len(offs) - 1, np.uint64)
    for base, prime in zip(BASES, primes):
        base %= prime
        value = np.zeros(len(offs) - 1, np.uint64)
        first = 0
        while first < len(value):
            last = int(np.searchsorted(offs, offs[first] + chunk, "right")) - 1
            if last > first:
                value[first:last] = chunk_hashes(data[offs[first] : offs[last]], offs[first : last + 1] - offs[first], base, prime)
                first = last
                continue
            total = np.zeros(1, np.uint64)  # one long text: chunk by chunk
            for at in range(int(offs[first]), int(offs[first + 1]), chunk):
                piece = data[at : min(at + chunk, int(offs[first + 1]))]
                total = combine(total, chunk_hashes(piece, np.array([0, len(piece)]), base, prime), len(piece), base, prime)
            value[first] = total[0]
            first += 1
        out = (out << np.uint64(31)) | value
    return out


def combine_chunks(chunks: DataFrame, key: str, position: str, chunk: str, primes=PRIMES) -> DataFrame:
    """Fingerprint texts that are stored as rows ``(key, position, chunk)``, however many rows a text has.

    ``position`` is the byte offset of the chunk (string or binary) in its text; chunks are normalised already.  Each chunk's polynomial is
    shifted by its offset (from the start, so chunks need not know the total length) and the shares are added.
    """
    inner = chunks.select(F.col(f"`{key}`").alias("key"), F.col(f"`{position}`").cast("long").alias("position"), F.col(f"`{chunk}`").alias("chunk"))
    bases = [base % prime for base, prime in zip(BASES, primes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "chunk"):
                data, offs = text_bytes(part.column("chunk"))
                ends = part.column("position").to_numpy(zero_copy_only=False) + np.diff(offs)
                shares = []
                for base, prime in zip(bases, primes):
                    back = np.array([pow(base, -int(e), prime) for e in ends], np.uint64)
                    shares.append(chunk_hashes(data, offs, base, prime) * back % np.uint64(prime))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(np.diff(offs)), *[pa.array(s.astype(np.int64)) for s in shares]], names=["key", "n", "s0", "s1"]
                )

    shares = inner.mapInArrow(run, T.StructType().add("key", inner.schema["key"].dataType).add("n", "long").add("s0", "long").add("s1", "long"))
    total = shares.groupBy("key").agg(F.sum("n").alias("n"), *[(F.sum(f"s{i}") % p).alias(f"s{i}") for i, p in enumerate(primes)])

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_pylist()
            out = np.zeros(len(n), np.uint64)
            for i, (base, prime) in enumerate(zip(bases, primes)):
                share = batch.column(f"s{i}").to_pylist()
                out = (out << np.uint64(31)) | np.array([s * pow(base, k, prime) % prime for s, k in zip(share, n)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(out.astype(np.int64))], names=["key", "n_bytes", "fp"])

    return total.mapInArrow(shift, T.StructType().add("key", inner.schema["key"].dataType).add("n_bytes", "long").add("fp", "long")).withColumnRenamed("key", key)


def same(left: memoryview, right: memoryview, chunk: int = CHUNK) -> bool:
    """Chunkwise comparison that stops at the first chunk that differs."""
    return len(left) == len(right) and all(left[i : i + chunk] == right[i : i + chunk] for i in range(0, len(left), chunk))


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), GAP, " ")


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, primes, huge: int) -> DataFrame:
    """One row per document: id, fp, n (bytes of the normalised text) and x, its SHA-256."""
    bounded_batches(docs.sparkSession)
    inner = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offs = normalised(part.column("text"))
                fp = fingerprint(data, offs, primes).astype(np.int64)
                view, cut = memoryview(data), offs.tolist()
                sums = pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(cut, cut[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp), pa.array(np.diff(offs)), sums], names=["id", "fp", "n", "x"])

    short = inner.where(size <= huge).mapInArrow(run, T.StructType().add("id", inner.schema["id"].dataType).add("fp", "long").add("n", "long").add("x", "string"))
    # Rows that repeat both id and text are hashed once.
    long = inner.where(size > huge).select("id", _plain(F.col("text")).alias("text")).withColumn("x", F.sha2("text", 256))
    long = long.groupBy("id", "x").agg(F.count(F.lit(1)).alias("times"), F.first("text").cast("binary").alias("data"))
    chunk = lambda k: F.substring("data", k * CHUNK + 1, F.lit(CHUNK))
    cut = long.select(F.struct("id", "x", "times").alias("key"), F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("data") - 1) / CHUNK).cast("int")), chunk)).alias("k", "chunk"))
    cut = cut.select("key", (F.col("k").cast("long") * CHUNK).alias("position"), "chunk").repartition("key", "position")
    whole = combine_chunks(cut, "key", "position", "chunk", primes)
    whole = whole.select("key.id", "fp", F.col("n_bytes").alias("n"), "key.x", F.explode(F.sequence(F.lit(1).cast("long"), F.col("key.times"))).alias("k")).drop("k")
    return short.unionAll(whole)


def _differing(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, salted: int) -> DataFrame:
    """Rows (id, fp, n, x) whose text differs from that of their group's first row, after comparing all of them."""
    first = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "x"))
    groups = rows.groupBy("fp", "n").agg(F.count(F.lit(1)).alias("c"), first.alias("first")).where("c > 1")
    groups = groups.select("fp", "n", F.ceil(F.col("c") / salted).cast("int").alias("salts"), F.col("first.id").alias("first_id"), F.col("first.x").alias("first_x"))
    wanted = rows.join(groups, ["fp", "n"]).distinct()
    texts = docs.select(F.col(f"`{id_col}`").alias("t_id"), _plain(F.col(f"`{text_col}`")).alias("text")).withColumn("t_x", F.sha2("text", 256))
    same_row = F.col("t_id").eqNullSafe(F.col("id")) & (F.col("t_x") == F.col("x"))
    members = wanted.join(texts.dropDuplicates(["t_id", "t_x"]) if _repeats(rows) else texts, same_row).drop("t_id", "t_x")
    members = written(members.withColumn("salt", F.pmod(F.xxhash64("id", "x"), "salts").cast("int")), "members")
    firsts = members.where(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("x") == F.col("first_x")))
    firsts = firsts.select("fp", "n", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("text").alias("other"))
    pairs = members.select("id", "fp", "n", "x", "salt", "text").join(firsts, ["fp", "n", "salt"]).select("id", "fp", "n", "x", "text", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("text"), batch.column("other")
            odd = [i for i in range(batch.num_rows) if not same(memoryview(x[i].as_buffer()), memoryview(y[i].as_buffer()))]
            yield batch.select(["id", "fp", "n", "x"]).take(pa.array(odd, pa.int64()))

    return pairs.mapInArrow(run, rows.select("id", "fp", "n", "x").schema)


def _repeats(rows: DataFrame) -> bool:
    """Are there rows that repeat both id and text?"""
    return not rows.groupBy("id", "x").count().where("count > 1").isEmpty()


def _classes(docs: DataFrame, id_col: str, text_col: str, primes, huge: int, salted: int) -> DataFrame:
    """One row per document: id, fp, n, x (SHA-256) and variant, which tells apart unequal texts of one fingerprint."""
    rows = written(_fingerprints(docs, id_col, text_col, primes, huge), "fingerprints")
    odd = written(_differing(docs, rows, id_col, text_col, salted), "differing")
    if odd.isEmpty():
        return rows.withColumn("variant", F.lit(""))
    on = F.col("r.id").eqNullSafe(F.col("o.id")) & (F.col("r.fp") == F.col("o.fp")) & (F.col("r.n") == F.col("o.n")) & (F.col("r.x") == F.col("o.x"))
    return rows.alias("r").join(odd.alias("o"), on, "left").select("r.*", F.coalesce("o.x", F.lit("")).alias("variant"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", primes=PRIMES, huge: int = HUGE, salted: int = SALTED) -> DataFrame:
    """One row per document: ``id_col``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    rows = _classes(docs, id_col, text_col, primes, huge, salted)
    key = ["fp", "n", "variant"]
    sizes = rows.groupBy(*key).agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(sizes, key).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("x").alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", primes=PRIMES, huge: int = HUGE, salted: int = SALTED) -> DataFrame:
    """Rows of ``docs``, with all their columns, that stay: of equal texts the one with the smallest id."""
    classes = _classes(docs, id_col, text_col, primes, huge, salted)
    keep = classes.groupBy("fp", "n", "variant").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "x")).alias("k"))
    keep = keep.select("k.id", "k.x")
    return only(docs, keep, [F.col(f"`{id_col}`"), F.sha2(_plain(F.col(f"`{text_col}`")), 256)], _repeats(classes))
