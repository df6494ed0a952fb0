"""Fill-in-middle: cut documents at line bounds into prefix, middle and suffix, and put the middle last.

Cuts are drawn as ranks (the k-th bound of a document) and have to become places in the text.  A learned index does that: over all bounds of
a run of documents, straight segments predict the place of a rank within a fixed error, and the residual of each rank, two bytes, makes the
prediction exact.  Everything is local to a row; the random numbers are digests of seed and id, so a lost task gives the same rows again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm._storage import bounded_batches
from ledgerloom.llm._words import slices, text_bytes

SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes by which a prediction may be off, before the residual is added; residuals take 16 bits.
ERROR = 8_000


class RankIndex:
    """Places of sorted bounds by rank: error-bounded straight segments, and a residual for each rank."""

    def __init__(self, places: np.ndarray, error: int = ERROR):
        if not 0 <= error < 1 << 15:
            raise ValueError("residuals take 16 bits")
        self.first, self.base, self.slope = [], [], []
        at, n = 0, len(places)
        while at < n:
            last, slope = self._segment(places, at, error)
            self.first.append(at)
            self.base.append(int(places[at]))
            self.slope.append(slope)
            at = last + 1
        self.first, self.base, self.slope = np.array(self.first, np.int64), np.array(self.base, np.int64), np.array(self.slope)
        self.residual = (places - self.predicted(np.arange(n))).astype(np.int16)

    @staticmethod
    def _segment(places: np.ndarray, at: int, error: int) -> tuple[int, float]:
        """Last rank and slope of the longest segment from ``at`` on that some slope keeps within the error (a cone that narrows)."""
        low, high, done, width = -np.inf, np.inf, at, 64
        while done + 1 < len(places):
            y = places[done + 1 : done + 1 + width] - places[at]
            x = np.arange(done + 1 - at, done + 1 - at + len(y))
            lows = np.maximum.accumulate(np.maximum((y - error) / x, low))
            highs = np.minimum.accumulate(np.minimum((y + error) / x, high))
            bad = np.flatnonzero(lows > highs)
            fit = int(bad[0]) if len(bad) else len(y)
            if fit:
                low, high, done = float(lows[fit - 1]), float(highs[fit - 1]), done + fit
            if len(bad):
                break
            width *= 2
        return done, 0.0 if done == at else (low + high) / 2

    def predicted(self, rank: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.first, rank, "right") - 1
        return self.base[s] + np.rint(self.slope[s] * (rank - self.first[s])).astype(np.int64)

    def place(self, rank: np.ndarray) -> np.ndarray:
        return self.predicted(rank) + self.residual[rank]


def line_bounds(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places of all line bounds of a run of texts (each text's start, then the end of each of its lines), and lines per text."""
    ends = np.flatnonzero(raw == 0x0A) + 1
    size = np.diff(offs)
    close = offs[1:][size > 0]
    ends = np.union1d(ends, close)
    lines = np.searchsorted(ends, offs[1:], "right") - np.searchsorted(ends, offs[:-1], "right")
    return np.sort(np.r_[offs[:-1], ends], kind="stable"), lines


def _draws(doc_id: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` per row, and ``in_<c>`` for the columns in ``carry``.

    ``n`` lines; ``rate`` of a hundred documents are cut, ``spm`` of a hundred of those with the suffix first.  A null or empty text, and one that holds a
    sentinel, stays plain, with null lengths.  Repeated rows give the same row each; a null id draws from the seed alone; an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    P, S, M = (x.encode() for x in sentinels)
    read = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), *_draws(F.col("doc_id"), seed), *[F.col(f"`{c}`").alias(f"in_{c}") for c in carry])
    out = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
        *[T.StructField(f"in_{c}", docs.schema[c].dataType) for c in carry],
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offs = text_bytes(part.column("text"))
                bounds, lines = line_bounds(raw, offs)
                index = RankIndex(bounds)
                first = np.arange(len(lines)) + np.cumsum(lines) - lines
                h1, h2, h3, h4 = (part.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "h3", "h4"))
                one, two = h1 % (lines + 1), h2 % (lines + 1)
                cut = index.place(first + np.minimum(one, two)), index.place(first + np.maximum(one, two))
                forms, prefixes, middles, texts = [], [], [], []
                for i, (a, p, m, b) in enumerate(zip(offs[:-1].tolist(), cut[0].tolist(), cut[1].tolist(), offs[1:].tolist())):
                    text = raw[a:b].tobytes()
                    if not text or h3[i] % 100 >= rate or P in text or S in text or M in text:
                        forms.append("plain"), prefixes.append(None), middles.append(None), texts.append(text)
                        continue
                    prefix, middle, suffix = text[: p - a], text[p - a : m - a], text[m - a :]
                    forms.append("spm" if h4[i] % 100 < spm else "psm")
                    prefixes.append(_chars(raw[a:p])), middles.append(_chars(raw[p:m]))
                    texts.append(b"".join((S, suffix, P, prefix, M, middle) if forms[-1] == "spm" else (P, prefix, S, suffix, M, middle)))
                made = [pa.array(lines.astype(np.int64)), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made, *[part.column(f"in_{c}") for c in carry]], names=out.names)

    return read.mapInArrow(run, out)


def _chars(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made from.  Cut texts hold no sentinel, so an output has each once, in the order of its form."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), -1)
    a, b, middle = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(a, middle, b)).when(form == "spm", F.concat(b, middle, a)).otherwise(output)
