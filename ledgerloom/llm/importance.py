"""Target-distribution importance resampling: draw the documents whose hashed n-grams look most like a target's.

Features are runs of consecutive words, hashed into buckets by CRC-32.  A CRC is linear: the checksum of a span is the exclusive-or of what each
byte adds at its distance from the span's end, and of a constant for the span's length.  So one table lookup per byte and one ``reduceat`` per batch
give the checksums of all spans; spans longer than the table fold block by block.

Plan.  Pass one counts features per bucket, per task, and sums the counts over tasks: as many rows as there are buckets, whatever the input.
Pass two reads the documents again and weighs each by the gains of its buckets (numbers bounded by the bucket parameter).  Gumbel noise from a hash of
the id turns the weights into a draw without replacement: the highest scores.  Scores are whole numbers in a bounded range, so their histogram says
where the draw ends; only rows above that meet in a range-partitioned sort, and ranks come from each partition's place and offset.  No task
sees more than its share, and nothing that grows with the documents is collected or broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm._storage import bounded_batches, only, written
from ledgerloom.llm._words import _LOWER, slices, text_bytes

POLYNOMIAL, ONES = 0xEDB88320, np.uint32(0xFFFFFFFF)
#: Bytes that the position table reaches back; and bytes of spans that are looked up at once.
BLOCK, RUN = 256, 1 << 19


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


def _position_table() -> np.ndarray:
    """``[d, b]``: what byte ``b`` adds to a checksum when ``d`` bytes follow it."""
    out = np.empty((BLOCK, 256), np.uint32)
    out[0] = _byte_table()
    for d in range(1, BLOCK):
        out[d] = (out[d - 1] >> 8) ^ out[0][out[d - 1] & 255]
    return out


PLACE = _position_table()
_FLAT = PLACE.ravel()


def _length_table() -> np.ndarray:
    """What the leading ones of a checksum have become after ``n`` bytes."""
    out = np.empty(BLOCK, np.uint32)
    out[0] = ONES
    for n in range(1, BLOCK):
        out[n] = (out[n - 1] >> 8) ^ PLACE[0][out[n - 1] & 255]
    return out


LENGTH = _length_table()
_steps: list[np.ndarray] = [PLACE[BLOCK - 1 : BLOCK - 5 : -1].copy()]


def _apply(step: np.ndarray, state: np.ndarray) -> np.ndarray:
    return step[0][state & 255] ^ step[1][(state >> 8) & 255] ^ step[2][(state >> 16) & 255] ^ step[3][state >> 24]


def advanced(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Checksums after ``blocks`` further blocks of zero bytes each; one step per binary digit of the number of blocks."""
    k, left = 0, blocks.copy()
    while left.any():
        if k == len(_steps):
            _steps.append(np.stack([_apply(_steps[-1], row) for row in _steps[-1]]))
        state = np.where(left & 1, _apply(_steps[k], state), state)
        left >>= 1
        k += 1
    return state


def crc32_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of ``raw[start:end]`` for each span; spans are not empty, may overlap and may be of any length."""
    if not len(start):
        return np.zeros(0, np.uint32)
    size = end - start
    blocks = -(-size // BLOCK)
    first = np.cumsum(blocks) - blocks
    behind = np.repeat(first + blocks, blocks) - 1 - np.arange(int(blocks.sum()))  # blocks that follow in the span
    close = np.repeat(end, blocks) - behind * BLOCK
    open_ = np.maximum(np.repeat(start, blocks), close - BLOCK)
    width = close - open_
    done, state = np.cumsum(width), np.empty(len(width), np.uint32)
    a = 0
    while a < len(width):
        before = int(done[a] - width[a])
        b = max(a + 1, int(np.searchsorted(done, before + RUN, "right")))
        ends = done[a:b] - before
        place = np.arange(int(ends[-1]))
        byte = raw[place + np.repeat(open_[a:b] - (ends - width[a:b]), width[a:b])]
        after = np.repeat(ends, width[a:b]) - 1 - place
        state[a:b] = np.bitwise_xor.reduceat(_FLAT[(after << 8) | byte], ends - width[a:b])
        a = b
    if len(width) > len(size):
        state = np.bitwise_xor.reduceat(advanced(state, behind), first)
    ones = LENGTH[size % BLOCK]
    return state ^ (ones if int(blocks.max()) == 1 and int(size.max()) < BLOCK else advanced(ones, size // BLOCK)) ^ ONES


def _is_word() -> np.ndarray:
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


_WORD = _is_word()


class Features:
    """Words and runs of ``low`` to ``high`` words of a run of texts, with the checksums of the runs.

    A word is a maximal run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z; splitting bytes equals splitting characters.
    """

    def __init__(self, column: pa.Array, low: int = 1, high: int = 1):
        raw, offs = text_bytes(column)
        raw = _LOWER[raw]
        inside = _WORD[raw]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        cuts = offs[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        opens[cuts], closes[cuts - 1] = inside[cuts], inside[cuts - 1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        first = np.searchsorted(start, offs)
        self.n_words = np.diff(first)
        row = np.repeat(np.arange(len(self.n_words)), self.n_words)
        if high > 1:  # words joined by one space each
            raw, start, end = _joined(raw, start, end)
        crc, rows = [], []
        for n in range(low, high + 1):
            same = row[n - 1 :] == row[: len(row) - n + 1]
            crc.append(crc32_spans(raw, start[: len(same)][same], end[n - 1 :][same]))
            rows.append(row[: len(same)][same])
        self.crc, self.row = np.concatenate(crc), np.concatenate(rows)
        self.n_features = np.bincount(self.row, minlength=len(self.n_words)).astype(np.int64)


def _joined(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = end - start
    to = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), 0x20, np.uint8)
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + step] = raw[np.repeat(start, size) + step]
    return out, to, to + size


def _tally(low: int, high: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(Features(part.column("text"), low, high).crc % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000) -> DataFrame:
    """``bucket, n``: features per bucket over all rows of column ``text``; buckets without features are left out."""
    bounded_batches(texts.sparkSession)
    found = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_tally(low, high, buckets), "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000) -> np.ndarray:
    """Per bucket, a thousand times the log of how much likelier a feature is in the target, floored; add-one counts on both sides."""
    both = bucket_counts(docs, low, high, buckets).select(F.lit(0).alias("side"), "*").unionAll(bucket_counts(target, low, high, buckets).select(F.lit(1), "*"))
    count = np.zeros((2, buckets), np.int64)
    for side, bucket, n in both.collect():  # two rows per bucket at most
        count[side, bucket] = n
    (s, t), (s_all, t_all) = count, count.sum(axis=1)
    ratio = (t + 1).astype(float) * float(s_all + buckets) / ((s + 1).astype(float) * float(t_all + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, low: int = 1, high: int = 1) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the floored mean of the gains of a document's features, 0 if it has none."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", kind), *[T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                f = Features(part.column("text"), low, high)
                order = np.argsort(f.row, kind="stable") if high > low else slice(None)
                sums = np.r_[0, np.cumsum(gain[f.crc[order] % len(gain)])]
                upto = np.r_[0, np.cumsum(f.n_features)]
                total = sums[upto[1:]] - sums[upto[:-1]]
                weight = np.where(f.n_features > 0, total // np.maximum(f.n_features, 1), 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, (f.n_words.astype(np.int64), f.n_features, weight))], names=out.names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, out)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, from a hash of seed and id (a null id: of the seed alone)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def importance_scores(
    docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20
) -> DataFrame:
    """Every document's ``doc_id, n_words, n_features, weight, score, rank``; ``rank`` counts from 1 and is null for those not drawn.

    Of the N documents with ``least_words`` words, the ``floor(percent * N / 100)`` highest scores are drawn.  Ties go to the smaller id, a null id last;
    rows that share an id and a score are ranked one after the other.  A null text has no words.  Repeated rows count and are drawn each; empty
    tables give no row and no gain; other columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    weighed = weights(docs, gains(docs, target, low, high, buckets), low, high)
    base = written(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id()), "importance")
    able = base.where(F.col("n_words") >= least_words)
    # Gains lie within 1000 * ln of a ratio of counts and noise within -3,200 and 22,200: the histogram has some 100,000 rows at most.
    counts = sorted(((r["score"], r["n"]) for r in able.groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    take = percent * sum(n for _, n in counts) // 100
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    undrawn = F.lit(None).cast("bigint").alias("rank")
    if not take:
        return base.select(*names, undrawn)
    seen, cut = 0, 0
    for score, n in counts:
        seen, cut = seen + n, score
        if seen >= take:
            break
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    lead = able.where(F.col("score") >= cut)
    placed = written(lead.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "importance-drawn")
    part = F.shiftright("place", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row per partition
    before, offsets = 0, []
    for p, n in sizes:
        offsets.append((int(p), before))
        before += n
    ranked = placed.withColumn("part", part).join(F.broadcast(spark.createDataFrame(offsets, "part long, before long")), "part")
    ranked = ranked.withColumn("rank", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).where(F.col("rank") <= take)
    last = ranked.where(F.col("rank") == take).select("doc_id", "row").first()
    key = lambda i, r: F.struct(i.isNull().alias("none"), i.alias("id"), r.alias("row"))
    upto = key(F.col("doc_id"), F.col("row")) <= key(F.lit(last["doc_id"]).cast(docs.schema["doc_id"].dataType), F.lit(last["row"]))
    drawn = (F.col("n_words") >= least_words) & ((F.col("score") > cut) | ((F.col("score") == cut) & upto))
    return ranked.select(*names, "rank").unionAll(base.where(~drawn).select(*names, undrawn))


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents with all their columns; documents that share the id of a drawn one come with it."""
    drawn = importance_scores(docs, target, **options).where("rank IS NOT NULL").select("doc_id").distinct()
    return only(docs, drawn, [F.col("doc_id")], repeated=False)
