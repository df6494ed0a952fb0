"""Substring dedup by relative Lempel-Ziv parsing against hash-blocked references.

The reference is the corpus itself: every repeated window of ``WINDOW`` words has its *homes*, the first two places where it occurs.  (Two, so that
the first place has a source as well.)  Places are numbered ``(bucket, word)``: documents are dealt into buckets, and a bucket's words are numbered
in the order of its rows.  The index of the reference is cut into *blocks*; a block owns a range of the hash space and sorts the windows that fall
into it.  A document is factored greedily, left to right:

1. **Anchors.**  The smallest 12-gram hash of any ``WINDOW`` consecutive words is an anchor.  It depends on those words alone, so a factor shares an
   anchor with its source wherever that source is.  A bucket asks the blocks which of its anchors occur twice; only there can a factor start.
2. **Factors.**  Windows at shared anchors are looked up in the block that owns their hash, which answers with a home of each.  A factor
   ``(first word, end, source bucket, source word)`` starts at the first window that has a source and is extended word by word as long as the next
   window's source is the next place in the reference; there it ends and is emitted.
3. **Boundaries.**  The parse goes on behind a factor, but the windows across its end, which start inside it, are looked up too: where they have a
   source of their own, they begin a factor that overlaps the boundary.  So every window that starts anywhere else too lies in a factor.
4. The words of factors, ``WINDOW`` or longer each, are the duplicate spans; they go.

A window's key is a 64-bit hash of its words; a home is only taken from windows that also agree in a second, 32-bit hash with word hashes of its
own.  Keys travel packed and distinct per bucket (see ``_buckets``), so a passage in a third of all documents costs one key per bucket.  Documents
are dealt by their row numbers, so that repeated rows spread too.

Edge cases: a null or empty text has no words and keeps an empty text; fewer than ``WINDOW`` words are never removed; repeated rows (equal ids too) are
separate documents, so they remove each other; an empty table gives an empty result; columns named in ``carry`` pass through unchanged under any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import _buckets as B
from ledgerloom.llm._words import Words, first_minimum, rolling, slices

WINDOW, GRAM = 35, 12
U64 = np.uint64
NOWHERE = U64((1 << 64) - 1)
#: What a bucket sends with a window: its first place there, and the second hash.
SENT = np.dtype([("first", "<u4"), ("check", "<u4")])


class _Parse:
    """Windows and anchors of a run of texts; ``base`` words of the bucket stand before them."""

    def __init__(self, column: pa.Array, window: int, gram: int, base: int = 0):
        self.words = w = Words(column)
        h = w.hashes()
        grams = rolling(h, gram)
        smallest = first_minimum(grams, window - gram + 1)
        room = np.repeat(w.row[1:], w.per_row) - np.arange(w.n)
        self.at = np.flatnonzero(room[: len(smallest)] >= window)
        self._place = smallest[self.at]
        self.anchor = grams[self._place] if len(self.at) else np.zeros(0, np.uint64)
        self._hashes, self._window, self.base = h, window, base

    def anchor_keys(self) -> np.ndarray:
        """Keys of the anchors, one for each place in a text that some window selects."""
        if not len(self.at):
            return self.anchor
        return self.anchor[np.r_[True, np.diff(self._place) != 0]]

    def windows(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, key and second hash of each window whose anchor is in the sorted array ``shared``."""
        pick = self.at[_within(self.anchor, shared)]
        if not len(pick):
            return pick, np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        return pick, rolling(self._hashes, self._window)[pick], (rolling(self.words.hashes(1), self._window)[pick] >> U64(32)).astype(np.uint32)


class _Index:
    """Distinct windows of a bucket, sorted by key: their second hash, first two places and number."""

    def __init__(self, parses, shared: np.ndarray):
        found = [(p.base + at, keys, check) for p in parses for at, keys, check in [p.windows(shared)]]
        at, keys, check = (np.concatenate([np.zeros(0, t), *x]) for t, x in zip((np.int64, np.uint64, np.uint32), zip(*found) if found else ([], [], [])))
        order = np.argsort(keys, kind="stable")  # places ascend within a key
        keys, check, at = keys[order], check[order], at[order]
        start = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (check[1:] != check[:-1])]) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.check, self.first = keys[start], check[start], at[start]
        self.n = np.diff(np.r_[start, len(keys)])
        self.second = np.full(len(start), -1, np.int64)
        self.second[self.n > 1] = at[start[self.n > 1] + 1]

    def sent(self) -> np.ndarray:
        out = np.empty(len(self.keys), SENT)
        out["first"], out["check"] = self.first, self.check
        return out

    def entry(self, keys: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Entry of each window; those of one key that differ in the second hash stand side by side."""
        i = np.searchsorted(self.keys, keys)
        while (off := np.flatnonzero(self.check[i] != check)).size:
            i[off] += 1
        return i


def homes(keys: np.ndarray, sent: bytes, owner: np.ndarray) -> np.ndarray:
    """Per window that a bucket sent: its first place in another bucket, or ``NOWHERE``."""
    sent = np.frombuffer(sent, SENT)
    place = (owner.astype(np.uint64) << U64(32)) | sent["first"]
    order = np.argsort(keys, kind="stable")
    k, c = keys[order], sent["check"][order]
    same = k[1:] == k[:-1]
    if (same & (c[1:] != c[:-1])).any():
        order = np.lexsort((sent["check"], keys))
        k, c = keys[order], sent["check"][order]
        same = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
    if not len(k):
        return np.zeros(0, np.uint64)
    place, own = place[order], owner[order]
    start = np.flatnonzero(np.r_[True, ~same])
    group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(k)]))
    least = np.minimum.reduceat(place, start)
    others = np.where(own == (least >> U64(32)).astype(own.dtype)[group], NOWHERE, place)
    next_ = np.minimum.reduceat(others, start)
    out = np.empty(len(k), np.uint64)
    out[order] = np.where(others == NOWHERE, next_[group], least[group])
    return out


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def _distinct(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_counts=True)
    return keys, (counts > 1).astype(np.uint8)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    window: int = WINDOW,
    gram: int = GRAM,
    bucket_bytes: int | None = None,
    block_bytes: int | None = None,
    keep_layout: bool = False,
) -> DataFrame:
    """Remove every word covered by a ``window``-word sequence that starts anywhere else too.

    Returns ``id_col``, ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by one space), ``spans`` (removed word ranges, half
    open), ``factors`` (word ranges with their source's bucket and word) and the columns of ``carry`` under their own names, prefixed ``in_``.
    With ``keep_layout`` a text that loses nothing keeps its white space.
    """
    size = B.corpus_bytes(docs, text_col)
    inner = docs.select(
        F.col(f"`{id_col}`").alias("__id"),
        F.col(f"`{text_col}`").cast("string").alias("__text"),
        *[F.col(f"`{c}`").alias(f"in_{c}") for c in carry],
    )
    dealt, _ = B.deal(inner.withColumn("__row", F.monotonically_increasing_id()), ["__row"], size, bucket_bytes)
    blocks = B.block_count(size, block_bytes)

    def parses(table: pa.Table) -> list[tuple[pa.RecordBatch, _Parse]]:
        """The rows of a bucket in the order of their numbers, in slices of bounded size."""
        base = 0
        for batch in table.combine_chunks().sort_by("__row").combine_chunks().to_batches():
            for part in slices(batch, "__text"):
                yield part, (p := _Parse(part.column("__text"), window, gram, base))
                base += p.words.n

    def first_ask(table: pa.Table) -> pa.Table:
        bucket = table.column("__bucket")[0].as_py()
        keys, many = _distinct([p.anchor_keys() for _, p in parses(table)])
        return pa.Table.from_batches([B.ask(1, bucket, keys, many, blocks)])

    def shared_anchors(table: pa.Table, answers: pa.Table) -> np.ndarray:
        keys, _ = _distinct([p.anchor_keys() for _, p in parses(table)])
        return keys[B.read_answers(answers, 1, np.uint8) > 0]

    def second_ask(table: pa.Table, answers: pa.Table) -> pa.Table:
        bucket = table.column("__bucket")[0].as_py()
        index = _Index((p for _, p in parses(table)), shared_anchors(table, answers))
        return pa.Table.from_batches([B.ask(2, bucket, index.keys, index.sent(), blocks)])

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        bucket = table.column("__bucket")[0].as_py()
        shared = shared_anchors(table, answers)
        index = _Index((p for _, p in parses(table)), shared)
        elsewhere = B.read_answers(answers, 2, np.uint64)
        return pa.Table.from_batches([_cut(part, p, *factors(p, shared, index, elsewhere, bucket), keep_layout) for part, p in parses(table)], schema)

    fields = [inner.schema[f"in_{c}"] for c in carry]
    long = lambda *names: T.StructType([T.StructField(n, T.LongType()) for n in names])
    out = T.StructType(
        [
            T.StructField("__id", inner.schema["__id"].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_text", T.StringType()),
            T.StructField("spans", T.ArrayType(long("first", "end"))),
            T.StructField("factors", T.ArrayType(long("first", "end", "source_bucket", "source_first"))),
            *fields,
        ]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(out)
    grouped = dealt.groupBy("__bucket")
    one = B.answered(grouped.applyInArrow(first_ask, B.ASK), B.seen_twice)
    two = B.answered(grouped.cogroup(one.groupBy("bucket")).applyInArrow(second_ask, B.ASK), homes)
    done = grouped.cogroup(one.unionAll(two).groupBy("bucket")).applyInArrow(cut, out)
    return done.withColumnRenamed("__id", id_col)


def factors(p: _Parse, shared: np.ndarray, index: _Index, elsewhere: np.ndarray, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors of a run of texts: first word, end, and place of the source; ``elsewhere`` are the blocks' answers to the index."""
    at, keys, check = p.windows(shared)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    entry = index.entry(keys, check)
    here = np.where(index.first[entry] != p.base + at, index.first[entry], index.second[entry])  # another place in this bucket, or -1
    local = np.where(here >= 0, (U64(bucket) << U64(32)) | here.astype(np.uint64), NOWHERE)
    source = np.minimum(elsewhere[entry], local)
    some = source != NOWHERE
    at, source = at[some], source[some]
    if not len(at):
        return at, at, source
    opens = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (source[1:] - source[:-1] != 1)])
    last = np.r_[opens[1:], len(at)] - 1
    return at[opens], at[last] + p._window, source[opens]


def _ranges(first: np.ndarray, end: np.ndarray, words: Words, **more: np.ndarray) -> pa.ListArray:
    """Per row, its word ranges, counted from the row's first word."""
    base = words.row[np.searchsorted(words.row, first, "right") - 1]
    columns = {"first": first - base, "end": end - base} | more
    each = pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns.values()], list(columns))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, words.row).astype(np.int32)), each)


def _cut(part: pa.RecordBatch, p: _Parse, first: np.ndarray, end: np.ndarray, source: np.ndarray, keep_layout: bool) -> pa.RecordBatch:
    """Cut the words of all factors out of a run of documents."""
    w = p.words
    step = np.zeros(w.n + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, end, -1)
    gone = np.cumsum(step[:-1]) > 0
    total = np.r_[0, np.cumsum(gone)]
    removed = total[w.row[1:]] - total[w.row[:-1]]
    owner = w.row_of()
    split = owner[1:] != owner[:-1]
    opens = np.flatnonzero(gone & np.r_[True, ~gone[:-1] | split]) if w.n else first[:0]
    closes = np.flatnonzero(gone & np.r_[~gone[1:] | split, True]) + 1 if w.n else opens
    kept = [t.decode("utf-8", "replace") for t in w.kept_text(~gone)]
    if keep_layout:
        kept = [(text.as_py() or "") if not n else k for text, n, k in zip(part.column("__text"), removed.tolist(), kept)]
    names = [n for n in part.schema.names if n.startswith("in_")]
    return pa.RecordBatch.from_arrays(
        [
            part.column("__id"),
            pa.array(w.per_row.astype(np.int64)),
            pa.array(removed.astype(np.int64)),
            pa.array(kept, pa.string()),
            _ranges(opens, closes, w),
            _ranges(first, end, w, source_bucket=source >> U64(32), source_first=source & U64(0xFFFFFFFF)),
            *[part.column(n) for n in names],
        ],
        names=["__id", "n_words", "n_removed", "kept_text", "spans", "factors", *names],
    )
