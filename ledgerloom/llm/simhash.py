"""SimHash near-duplicates by tiled exact comparison.

* **Fingerprints.**  Word shingles are hashed with XXH64; a bit of the 64-bit fingerprint is one if it is one in over half of the hashes.
* **Tiles.**  Distinct fingerprints are laid out in tiles by the population counts of their first two 16-bit quarters.  Fingerprints within
  ``radius`` bits differ by at most ``radius`` in the sum of the differences of these counts, so only 13 of the 289 tiles around a tile are
  compared with it (each pair of tiles once).  Inside a pair of tiles the counts of the other two quarters skip in the same way, and what is left
  is compared exactly with numpy exclusive-or and bit counts.
* Tiles with many fingerprints are cut into parts; each task holds ``HOME`` + ``OTHER`` fingerprints at most in expectation, however many there
  are.  A task returns a spanning forest of the links it finds, never all pairs.
* Components come from the links by large-star and small-star rounds (``components``).

``near_duplicates`` does this for a given radius.  ``near_copies`` finds documents by the *similarity* (Jaccard) of their sets of five-word shingles:

* four 64-bit lanes make a 256-bit fingerprint of the distinct shingles; documents of similarity 0.8 differ in 39 bits on average (deviation 6),
  unrelated ones in 128 (deviation 8), so a radius of ``WIDE_RADIUS`` bits takes in nearly all of the former and none of the latter;
* tiles are size classes, steps of 1 / 0.8 in the number of shingles: documents of one similarity class lie in the same or the next one.  Inside
  a pair of tiles only documents whose sizes and population counts allow it are compared;
* a task returns a *minimum* spanning forest (by differing bits) of the pairs that it finds, and each of its links is then held against the
  documents' shingles: links below the similarity are dropped.  So no document goes for a link that does not hold;
* links that hold but lie beyond the radius, or whose way in the forest fails, are found by an exact check that follows: documents of different
  components meet at their rarest shingles, and every pair that meets and may hold is held against its shingles.  So no link that holds is
  missed.  That check is quadratic in the size of a family, but inside tasks of bounded size that return forests, never as rows.

Edge cases: null and empty texts have no words, fingerprint zero, and link like any other (of ``near_copies``, to each other); fewer words than a
shingle are hashed as a whole; repeated rows share a fingerprint, and one of them stays; an empty table gives an empty result; with a null id the
component takes the smallest id that is not null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm._storage import bounded_batches, only, written
from ledgerloom.llm._words import Words, mix, slices
from ledgerloom.llm.components import components

HOME, OTHER = 1 << 15, 1 << 19
LANES, SHINGLE, SIMILARITY, WIDE_RADIUS = 4, 5, 0.8, 58
WIDE_HOME, WIDE_OTHER = 1 << 13, 1 << 16
PLACES = 18
PARITY_BITS, MEET, MEET_BLOCK, HELD, WIDE_HELD, WIDEST = 512, 1 << 11, 1 << 14, 1 << 21, 1 << 23, 15
U64 = np.uint64


def _joined(w: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one space between them, and each word's bounds there."""
    length = w.end - w.start
    start = np.cumsum(length + 1) - (length + 1)
    out = np.full(int(length.sum()) + w.n, 32, np.uint8)
    shift = np.repeat(start - w.start, length)
    at = np.arange(len(shift)) + np.repeat(w.start - (np.cumsum(length) - length), length)
    out[at + shift] = w.raw[at]
    return out.tobytes(), start, start + length


def _shingle_hashes(column: pa.Array, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles, in the order of the texts, and how many each text has."""
    w = Words(column, lower=True)
    text, start, end = _joined(w)
    n = w.per_row
    per = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    first = np.cumsum(per) - per
    row = np.repeat(np.arange(len(n)), per)
    begin = w.row[:-1][row] + np.arange(len(row)) - first[row]
    final = np.minimum(begin + shingle, w.row[1:][row]) - 1
    cuts = map(slice, start[begin].tolist(), end[final].tolist())
    return np.fromiter(map(xxhash.xxh64_intdigest, map(text.__getitem__, cuts), repeat(seed)), np.uint64, len(row)), per


#: Byte value -> its eight bits, one in each byte of a word.
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def majority(hashes: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Per text, the 64 bits that are one in over half of its ``per`` hashes.

    Bits are added eight at a time in the bytes of a word, in groups of 255 hashes at most, so that no byte runs over.
    """
    out = np.zeros((len(per), 8), np.uint8)
    some = np.flatnonzero(per)
    if not len(some):
        return out.view(np.uint64).ravel()
    groups = -(-per[some] // 255)
    first = np.cumsum(per[some]) - per[some]
    inner = np.arange(int(groups.sum())) - np.repeat(np.cumsum(groups) - groups, groups)
    cuts = np.repeat(first, groups) + 255 * inner
    own = np.cumsum(groups) - groups
    each = np.ascontiguousarray(hashes).astype("<u8").view(np.uint8).reshape(-1, 8)
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[each[:, k]], cuts).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(sums.astype(np.int64), own, axis=0)
        out[some, k] = np.packbits(2 * ones > per[some][:, None], axis=1, bitorder="little")[:, 0]
    return out.view("<u8").ravel().astype(np.uint64)


def fingerprints_of(column: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each text as an unsigned 64-bit integer."""
    return majority(*_shingle_hashes(column, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: ``id``, ``text_hash`` (tells rows with equal ids apart) and ``fp``, a signed long."""
    bounded_batches(docs.sparkSession)
    inner = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = fingerprints_of(part.column("text"), shingle, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_hash"), pa.array(fp)], names=["id", "text_hash", "fp"])

    kind = inner.schema["id"].dataType
    return inner.mapInArrow(run, T.StructType().add("id", kind).add("text_hash", "long").add("fp", "long"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star for each component of the links ``a[i] - b[i]``: (node, least node)."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


def compare(home: np.ndarray, other: np.ndarray, spare: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links between ``home`` and ``other``; ``spare[i]``: bits that other[i]'s tile leaves over."""
    counts = lambda x: [np.bitwise_count((x >> U64(s)) & U64(0xFFFF)).astype(np.int64) for s in (32, 48)]
    p, q = counts(home)
    u, v = counts(other)
    place = (spare.astype(np.int64) * 32 + u) * 32 + v
    order = np.argsort(place, kind="stable")
    other, place = other[order], place[order]
    cell = p * 32 + q
    by = np.argsort(cell, kind="stable")
    home, cell = home[by], cell[by]
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, int)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    held = 0
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)]):
        p0, q0 = divmod(int(cell[s]), 32)
        reach = [
            (((b * 32 + p0 + d) * 32) + max(0, q0 - b + abs(d)), ((b * 32 + p0 + d) * 32) + q0 + b - abs(d) + 1)
            for b in range(radius + 1)
            for d in range(-b, b + 1)
            if 0 <= p0 + d <= 16
        ]
        cut = np.searchsorted(place, np.array(reach, np.int64))
        near = np.concatenate([other[i:j] for i, j in cut.tolist()])
        if not len(near):
            continue
        rows = max(1, (1 << 20) // len(near))
        for at in range(s, e, rows):
            mine = home[at : min(e, at + rows)]
            x, y = np.nonzero(np.bitwise_count(mine[:, None] ^ near[None, :]) <= radius)
            apart = mine[x] != near[y]
            left.append(mine[x[apart]])
            right.append(near[y[apart]])
            held += int(apart.sum())
            if held > 1 << 20:
                a, b = forest(np.concatenate(left), np.concatenate(right))
                left, right, held = [a], [b], 0
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return forest(np.concatenate(left), np.concatenate(right))


def links(fps: DataFrame, radius: int = 3, home: int = HOME, other: int = OTHER) -> DataFrame:
    """Links ``(a, b)`` that join all ``fp`` of ``fps`` (distinct longs) at ``radius`` or fewer differing bits."""
    count = lambda shift: F.bit_count(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(0xFFFF)))
    tiled = fps.select("fp", (count(0) * 32 + count(16)).cast("int").alias("tile"))
    size = {r.tile: r.n for r in tiled.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).collect()}  # 289 rows at most
    steps = [(x, y) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1) if abs(x) + abs(y) <= radius and (x, y) >= (0, 0)]
    around = {t: sum(size.get(t - (x * 32 + y), 0) for x, y in steps) for t in size}
    parts = {t: (math.ceil(n / home), math.ceil(around[t] / other)) for t, n in size.items()}
    spark = fps.sparkSession
    table = F.broadcast(spark.createDataFrame([(t, r, q) for t, (r, q) in parts.items()], "tile int, homes int, others int"))
    mine = tiled.join(table, "tile").select(
        "tile", F.pmod(F.hash("fp"), "homes").alias("h"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("o"), "fp", F.lit(-1).alias("spare")
    )
    moves = F.array(*[F.struct(F.lit(x * 32 + y).alias("move"), F.lit(radius - abs(x) - abs(y)).alias("spare")) for x, y in steps])
    theirs = tiled.select("fp", "tile", F.explode(moves).alias("m")).select("fp", (F.col("tile") + F.col("m.move")).alias("tile"), F.col("m.spare").alias("spare"))
    theirs = theirs.join(table, "tile").select("tile", F.explode(F.sequence(F.lit(0), F.col("homes") - 1)).alias("h"), F.pmod(F.xxhash64("fp"), "others").cast("int").alias("o"), "fp", "spare")

    def run(tables: pa.Table) -> pa.Table:
        fp = tables.column("fp").to_numpy().view(np.uint64)
        spare = tables.column("spare").to_numpy()
        at_home = spare < 0
        a, b = compare(fp[at_home], fp[~at_home], spare[~at_home], radius)
        return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return mine.unionAll(theirs).groupBy("tile", "h", "o").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """One row per document: ``id_col``, ``text_hash``, ``fp``, its component's ``root`` fingerprint and ``component_id``, the smallest id reachable."""
    rows = written(fingerprints(docs, id_col, text_col, shingle, seed), "simhash")
    classes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(classes.select("fp"), radius))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.select("fp", "root").join(ids, "root").select("fp", "root", "component_id")
    return rows.join(found, "fp").select(F.col("id").alias(id_col), "text_hash", "fp", "root", "component_id")


def _drop(docs: DataFrame, found: DataFrame, id_col: str, key: Column) -> DataFrame:
    """Of each component the row that stands first by id, then by ``key`` (called so in ``found`` too)."""
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "key")).alias("k")).select("k.id", "k.key")
    repeated = not found.groupBy("id", "key").count().where("count > 1").isEmpty()
    return only(docs, best, [F.col(f"`{id_col}`"), key], repeated)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs``, with all their columns, that stand first (by id, then text hash) in their component; of repeated rows, one."""
    found = near_duplicates(docs, id_col, text_col, **options)
    found = found.select(F.col(f"`{id_col}`").alias("id"), F.col("text_hash").alias("key"), "root")
    return _drop(docs, found, id_col, F.xxhash64(F.col(f"`{text_col}`")))


# Near copies by similarity


def _distinct(hashes: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and how many."""
    row = np.repeat(np.arange(len(per)), per)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    one = np.r_[True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])] if len(row) else np.zeros(0, bool)
    return hashes[one], np.bincount(row[one], minlength=len(per))


def _node(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def size_class(n: np.ndarray, similarity: float) -> np.ndarray:
    """Sets that are ``similarity`` alike have sizes in a ratio of ``similarity`` at least, so classes that are equal or next to each other."""
    return np.where(n > 0, np.floor(np.log(np.maximum(n, 1)) / -np.log(similarity) + 1e-9), -9).astype(np.int32)


def wide_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, seed: int = 42) -> DataFrame:
    """One row per document: ``id``, ``node``, number of distinct shingles ``n``, size class ``c`` and the ``LANES`` lanes of its fingerprint."""
    bounded_batches(docs.sparkSession)
    inner = docs.select(F.col(f"`{id_col}`").alias("id"), _node(F.col(f"`{text_col}`")).alias("node"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, per = _distinct(*_shingle_hashes(part.column("text"), shingle, seed))
                lanes = [majority(hashes if k == 0 else mix(hashes + U64(k) * U64(0x9E3779B97F4A7C15)), per) for k in range(LANES)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("node"), pa.array(per.astype(np.int32)), pa.array(size_class(per, similarity)), *[pa.array(x.view(np.int64)) for x in lanes]],
                    names=["id", "node", "n", "c", *[f"f{k}" for k in range(LANES)]],
                )

    out = T.StructType().add("id", inner.schema["id"].dataType).add("node", "binary").add("n", "integer").add("c", "integer")
    for k in range(LANES):
        out = out.add(f"f{k}", "long")
    return inner.mapInArrow(run, out)


def spanning(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Indices of the links ``a[i] - b[i]`` of a minimum spanning forest by ``d``; equal ones by their place."""
    by = np.argsort(d, kind="stable")
    nodes, flat = np.unique(np.concatenate([a[by], b[by]]), return_inverse=True)
    x, y, place = flat[: len(a)], flat[len(a) :], np.arange(len(a))
    kept = []
    while True:
        apart = x != y
        x, y, place = x[apart], y[apart], place[apart]
        if not len(x):
            break
        first = np.full(len(nodes), len(x))
        np.minimum.at(first, x, np.arange(len(x)))
        np.minimum.at(first, y, np.arange(len(x)))
        chosen = np.unique(first[first < len(x)])
        kept.append(place[chosen])
        label = np.arange(len(nodes))
        node, least = forest(x[chosen].astype(np.uint64), y[chosen].astype(np.uint64))
        label[node.astype(np.int64)] = least.astype(np.int64)
        x, y = label[x], label[y]
    return by[np.concatenate(kept)] if kept else np.zeros(0, np.int64)


def wide_compare(home: np.ndarray, home_n: np.ndarray, other: np.ndarray, other_n: np.ndarray, similarity: float, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs ``(i, j, d)`` within ``radius`` bits whose sizes allow the similarity: a minimum spanning forest of them.

    Fingerprints are rows of lanes; ``i`` and ``j`` are rows of ``home`` and of ``other``.
    """
    count = lambda f: np.bitwise_count(f).sum(axis=1, dtype=np.int64)
    by_home, by_other = np.argsort(home_n, kind="stable"), np.argsort(other_n, kind="stable")
    ones, others, sizes = count(home), count(other)[by_other], other_n[by_other]
    lanes = [np.ascontiguousarray(other[by_other, k]) for k in range(other.shape[1])]
    found = [np.zeros((3, 0), np.int64)]
    held = at = 0
    while at < len(by_home):
        mine = by_home[at : at + 64]
        low = np.searchsorted(sizes, np.floor(home_n[mine[0]] * similarity))
        high = np.searchsorted(sizes, np.ceil(home_n[mine[-1]] / similarity), "right")
        near = low + np.flatnonzero((others[low:high] >= ones[mine].min() - radius) & (others[low:high] <= ones[mine].max() + radius))
        for cut in range(0, len(near), 1 << 14):
            some = near[cut : cut + (1 << 14)]
            bits = np.zeros((len(mine), len(some)), np.uint16)
            for k, lane in enumerate(lanes):
                bits += np.bitwise_count(home[mine, k][:, None] ^ lane[some][None, :])
            x, y = np.nonzero(bits <= radius)
            i, j = mine[x], by_other[some[y]]
            fits = np.minimum(home_n[i], other_n[j]) >= similarity * np.maximum(home_n[i], other_n[j]) - 1e-9
            found.append(np.stack([i, j, bits[x, y].astype(np.int64)])[:, fits])
            held += int(fits.sum())
        at += len(mine)
        if held > 1 << 20:
            all_ = np.concatenate(found, axis=1)
            found = [all_[:, spanning(all_[0], all_[1] + len(home), all_[2])]]
            held = found[0].shape[1]
    all_ = np.concatenate(found, axis=1)
    return tuple(all_[:, spanning(all_[0], all_[1] + len(home), all_[2])])


def wide_links(rows: DataFrame, similarity: float = SIMILARITY, radius: int = WIDE_RADIUS, home: int = WIDE_HOME, other: int = WIDE_OTHER) -> DataFrame:
    """Links ``(a, b)`` between nodes of ``rows`` (one row per node), from the tiles' minimum spanning forests."""
    spark = rows.sparkSession
    size = {r.c: r.m for r in rows.groupBy("c").agg(F.count(F.lit(1)).alias("m")).collect()}  # a row per step of the size: about 100
    parts = [(c, math.ceil(n / home), math.ceil((n + size.get(c + 1, 0)) / other)) for c, n in size.items()]
    table = F.broadcast(spark.createDataFrame(parts, "tile int, homes int, others int"))
    lanes = [f"f{k}" for k in range(LANES)]
    mine = rows.withColumn("tile", F.col("c")).join(table, "tile").select(
        "tile", F.pmod(F.xxhash64("node"), "homes").cast("int").alias("h"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("o"), F.lit(True).alias("at_home"), "node", "n", *lanes
    )
    theirs = rows.withColumn("tile", F.explode(F.array("c", F.col("c") - 1))).join(table, "tile").select(
        "tile", F.explode(F.sequence(F.lit(0), F.col("homes") - 1)).alias("h"), F.pmod(F.hash("node"), "others").cast("int").alias("o"), F.lit(False).alias("at_home"), "node", "n", *lanes
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        at_home = table.column("at_home").to_numpy()
        f = np.stack([table.column(c).to_numpy().view(np.uint64) for c in lanes], axis=1)
        n = table.column("n").to_numpy().astype(np.int64)
        x, y = np.flatnonzero(at_home), np.flatnonzero(~at_home)
        i, j, d = wide_compare(f[x], n[x], f[y], n[y], similarity, radius)
        node = table.column("node")
        a, b = node.take(pa.array(x[i])), node.take(pa.array(y[j]))
        return pa.table([a, b, pa.array(d.astype(np.int32))], names=["a", "b", "d"])

    pairs = mine.unionAll(theirs).groupBy("tile", "h", "o").applyInArrow(run, "a binary, b binary, d int").where("a <> b")
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _sets(docs: DataFrame, linked: DataFrame, text_col: str, shingle: int, seed: int = 42) -> DataFrame:
    """``node`` and ``s``, its sorted distinct shingles, of the nodes in ``linked``: only their texts are read again."""
    texts = docs.select(_node(F.col(f"`{text_col}`")).alias("node"), F.col(f"`{text_col}`").cast("string").alias("text")).join(linked, "node")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, per = _distinct(*_shingle_hashes(part.column("text"), shingle, seed))
                cut, data = (np.r_[0, np.cumsum(per)] * 8).tolist(), hashes.tobytes()
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([data[x:y] for x, y in zip(cut, cut[1:])], pa.binary())], names=["node", "s"])

    return written(texts.mapInArrow(sets, "node binary, s binary").dropDuplicates(["node"]), "shingles")


def are_alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def _alike(docs: DataFrame, links: DataFrame, text_col: str, shingle: int, similarity: float, seed: int = 42) -> DataFrame:
    """Links whose shingle sets are as similar as asked: only texts with a link are read again, and links meet two sets at a time."""
    linked = written(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "linked")
    shingles = _sets(docs, linked, text_col, shingle, seed)
    side = lambda c: shingles.select(F.col("node").alias(c), F.col("s").alias("s" + c))
    pairs = links.join(side("a"), "a").join(side("b"), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column("sa"), batch.column("sb"))
            keep = [i for i, (x, y) in enumerate(sets) if are_alike(*(np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y)), similarity)]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return pairs.mapInArrow(check, "a binary, b binary")


def _bucket_counts(docs: DataFrame, text_col: str, shingle: int, seed: int = 42) -> np.ndarray:
    """How many shingles fall into each of ``1 << PLACES`` hash buckets: a bounded table that tells the frequent ones."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << PLACES, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, _ = _shingle_hashes(part.column("text"), shingle, seed)
                total += np.bincount((hashes >> U64(64 - PLACES)).astype(np.int64), minlength=1 << PLACES)
        some = np.flatnonzero(total)
        for at in range(0, len(some), 1 << 16):
            k = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["k", "n"])

    found = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "k long, n long")
    out = np.zeros(1 << PLACES, np.int64)
    sums = found.groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out[sums.column("k").to_numpy()] = sums.column("n").to_numpy()
    return out


def prefixes(hashes: np.ndarray, per: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set, as many of its rarest members that a set ``similarity`` alike has one of them among its own: members, places, and how many of each set."""
    row = np.repeat(np.arange(len(per)), per)
    order = np.lexsort((hashes, counts[(hashes >> U64(64 - PLACES)).astype(np.int64)], row))
    take = np.where(per > 0, per - np.ceil(similarity * per - 1e-9).astype(np.int64) + 1, 0)
    place = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    some = place < take[row]
    return hashes[order][some], place[some], take


def parities(hashes: np.ndarray, per: np.ndarray, bits: int) -> np.ndarray:
    """Per set, ``bits`` bits (a power of two): whether an odd number of its members falls on a bit.

    A member that only one of two sets has turns one bit, so sets differ in at least as many members as their parities in bits.
    """
    out = np.zeros((len(per), bits // 64), np.uint64)
    cut, rows = np.r_[0, np.cumsum(per)], max(1, (1 << 22) // bits)
    for at in range(0, len(per), rows):
        some = per[at : at + rows]
        place = np.repeat(np.arange(len(some)) * bits, some) + (hashes[cut[at] : cut[at + len(some)]] & U64(bits - 1)).astype(np.int64)
        odd = (np.bincount(place, minlength=len(some) * bits) & 1).astype(np.uint8)
        out[at : at + len(some)] = np.packbits(odd, bitorder="little").view("<u8").reshape(len(some), -1)
    return out


def level_of(n: np.ndarray) -> np.ndarray:
    """Twice the members of a set, as a power of two: how many bits its wide parities have."""
    return np.clip(np.ceil(np.log2(np.maximum(2 * n, 1))), 6, WIDEST).astype(np.int64)


def wide_parities(hashes: np.ndarray, per: np.ndarray) -> list[bytes]:
    """Per set, parities of ``level_of`` its size."""
    level, row, out = level_of(per), np.repeat(np.arange(len(per)), per), [b""] * len(per)
    for one in np.unique(level).tolist():
        mine = level == one
        for k, bits in zip(np.flatnonzero(mine).tolist(), parities(hashes[mine[row]], per[mine], 1 << one)):
            out[k] = bits.tobytes()
    return out


def folded(wide: bytes, level: int) -> np.ndarray:
    """Parities at fewer bits: a bit's place is a hash modulo their number, so halves add up."""
    bits = np.frombuffer(wide, np.uint64)
    while len(bits) > 1 << (level - 6):
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def in_reach(group: np.ndarray, n: np.ndarray, root: np.ndarray, part: np.ndarray | None, bits: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs ``(x, y, d)`` of rows of one group under different roots (and in different parts, if there are any) that may be as similar as asked.

    ``d`` is by how many members they differ at least; no pair that is as similar is left out.  Some million pairs are held at a time.
    """
    apart = (1 - similarity) / (1 + similarity)
    order = np.lexsort((n, group))
    place = (group[order] << 32) + n[order]
    end = np.searchsorted(place, (group[order] << 32) + np.floor(n[order] / similarity + 1e-6).astype(np.int64), "right")
    per = end - np.arange(len(end)) - 1
    total = np.cumsum(per)
    at = 0
    while at < len(per):
        upto = max(at + 1, int(np.searchsorted(total, total[at] - per[at] + (1 << 20), "right")))
        some = per[at:upto]
        i = np.repeat(np.arange(at, upto), some)
        x, y = order[i], order[i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some)]
        other = root[x] != root[y] if part is None else (root[x] != root[y]) & (part[x] != part[y])
        x, y = x[other], y[other]
        step = max(1, (1 << 19) // bits.shape[1])
        for cut in range(0, len(x), step):
            u, v = x[cut : cut + step], y[cut : cut + step]
            d = np.bitwise_count(bits[u] ^ bits[v]).sum(axis=1, dtype=np.int64)
            near = d <= apart * (n[u] + n[v]) + 1e-6
            yield u[near], v[near], d[near]
        at = upto


def _tiles(key: Column, block: Column, weight: Column, most: int, row: Column) -> list[Column]:
    """Columns ``k``, ``p``, ``q`` and ``part``: light keys share the tile of their block; a heavy one is cut into parts, and any two of these have a tile."""
    parts = F.ceil(weight / most).cast("int")
    part = F.pmod(F.xxhash64(row), parts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda q: F.struct(key.alias("k"), F.least(part, q).alias("p"), F.greatest(part, q).alias("q")))
    alone = F.array(F.struct(block.alias("k"), F.lit(-1).alias("p"), F.lit(-1).alias("q")))
    return [F.explode(F.when(parts > 1, pairs).otherwise(alone)).alias("tile"), F.when(parts > 1, part).otherwise(0).alias("part")]


def _meeting(sets: DataFrame, similarity: float, most: int, block: int) -> DataFrame:
    """Links ``(a, b)`` of numbers ``i`` that join all documents which meet at a member under different roots and are in reach: a forest per tile."""
    at = Window.partitionBy("h")
    each = sets.select(F.explode("h").alias("h"), "i", "r").withColumns({"x": F.min("r").over(at), "y": F.max("r").over(at), "m": F.count(F.lit(1)).over(at)})
    each = written(each.where("x <> y").select("h", "i", "m"), "prefixes")
    blocks = max(1, math.ceil(each.count() / block))
    tiled = each.select("h", "i", *_tiles(F.col("h"), F.pmod("h", F.lit(blocks)).cast("long"), F.col("m"), most, F.col("i")))
    rows = tiled.join(sets.select("i", "r", "n", "bits"), "i").select("tile.k", "tile.p", "tile.q", "part", "h", "i", "r", "n", "bits")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        i, h, root, n, part = (table.column(c).to_numpy() for c in ("i", "h", "r", "n", "part"))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(i), -1)
        cross = table.column("p")[0].as_py() != table.column("q")[0].as_py()
        ids, at = np.unique(i, return_inverse=True)
        a = b = np.zeros(0, np.uint64)
        for x, y, _ in in_reach(np.unique(h, return_inverse=True)[1], n.astype(np.int64), root, part if cross else None, bits, similarity):
            if len(x):
                a, b = forest(np.r_[a, at[x].astype(np.uint64)], np.r_[b, at[y].astype(np.uint64)])
        return pa.table([pa.array(ids[a.astype(np.int64)]), pa.array(ids[b.astype(np.int64)])], names=["a", "b"])

    return rows.groupBy("k", "p", "q").applyInArrow(run, "a long, b long")


def _closer(rough: DataFrame, similarity: float, most: int) -> DataFrame:
    """Links ``(a, b)`` of numbers ``i`` that join all documents of a cluster in reach by wide parities: a forest per tile.

    Tiles are levels: a set comes to its own and, if sets of the one below may be alike, folded to that one.
    """
    own = F.log2(F.length("wide") * 8).cast("int")
    below = (own > 6) & (F.col("n") * similarity <= F.pow(F.lit(2.0), own - 2) + 1e-6)
    levels = rough.withColumn("level", F.explode(F.when(below, F.array(own, own - 1)).otherwise(F.array(own))))
    size = levels.groupBy("cluster", "level").agg(F.sum("n").alias("m"))
    blocks = max(1, math.ceil((size.agg(F.sum("m")).first()[0] or 0) / most))
    block = F.pmod(F.xxhash64("cluster"), F.lit(blocks))
    tiled = levels.join(size, ["cluster", "level"]).select("level", "cluster", "i", "r", "n", "wide", *_tiles(F.col("cluster"), block, F.col("m"), most, F.col("i")))
    rows = tiled.select("level", "tile.k", "tile.p", "tile.q", "part", "cluster", "i", "r", "n", "wide")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cluster, i, root, n, part = (table.column(c).to_numpy() for c in ("cluster", "i", "r", "n", "part"))
        level = table.column("level")[0].as_py()
        bits = np.stack([folded(w, level) for w in table.column("wide").to_pylist()])
        cross = table.column("p")[0].as_py() != table.column("q")[0].as_py()
        ids, at = np.unique(i, return_inverse=True)
        a = b = np.zeros(0, np.uint64)
        for x, y, _ in in_reach(np.unique(cluster, return_inverse=True)[1], n.astype(np.int64), root, part if cross else None, bits, similarity):
            if len(x):
                a, b = forest(np.r_[a, at[x].astype(np.uint64)], np.r_[b, at[y].astype(np.uint64)])
        return pa.table([pa.array(ids[a.astype(np.int64)]), pa.array(ids[b.astype(np.int64)])], names=["a", "b"])

    return rows.groupBy("level", "k", "p", "q").applyInArrow(run, "a long, b long")


def _held(shingles: DataFrame, similarity: float, most: int) -> DataFrame:
    """Links ``(a, b)`` of nodes that join all sets of a cluster, under different roots, that are as similar as asked: a forest per tile.

    Every pair that its parities leave in reach is held against its shingles, unless links found before in the tile join it already.
    """
    size = shingles.groupBy("cluster").agg(F.sum("n").alias("m"))
    blocks = max(1, math.ceil((size.agg(F.sum("m")).first()[0] or 0) / most))
    tiled = shingles.join(size, "cluster").select(
        "cluster", "node", "r", "n", "s", *_tiles(F.col("cluster"), F.pmod(F.xxhash64("cluster"), F.lit(blocks)), F.col("m"), most, F.col("node"))
    )
    rows = tiled.select("tile.k", "tile.p", "tile.q", "part", "cluster", "node", "r", "n", "s")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cluster, root, n, part = (table.column(c).to_numpy() for c in ("cluster", "r", "n", "part"))
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("s")]
        per = np.array([len(s) for s in sets])
        bits = parities(np.concatenate(sets), per, 1 << min(15, max(6, int(2 * per.max()).bit_length())))
        cross = table.column("p")[0].as_py() != table.column("q")[0].as_py()
        under = np.unique(root, return_inverse=True)[1]
        label = np.arange(len(under))
        a, b = [], []
        for x, y, d in in_reach(np.unique(cluster, return_inverse=True)[1], n.astype(np.int64), root, part if cross else None, bits, similarity):
            for k in np.argsort(d, kind="stable").tolist():
                i, j = int(x[k]), int(y[k])
                u, v = label[under[i]], label[under[j]]
                if u != v and are_alike(sets[i], sets[j], similarity):
                    label[label == v] = u
                    a.append(i)
                    b.append(j)
        node = table.column("node")
        return pa.table([node.take(pa.array(a, pa.int64())), node.take(pa.array(b, pa.int64()))], names=["a", "b"])

    return rows.groupBy("k", "p", "q").applyInArrow(run, "a binary, b binary")


def _missed(
    docs: DataFrame, named: DataFrame, text_col: str, shingle: int, similarity: float, seed: int = 42, meet: int = MEET, block: int = MEET_BLOCK, held: int = HELD
) -> DataFrame:
    """Links ``(a, b)`` of nodes that join all documents under different roots that are as similar as asked.

    Two sets that are ``similarity`` alike share one of their rarest members (in any order that is the same for all sets; here, by frequency of the
    member's bucket, then by hash), so pairs meet there.  Members cross the shuffle once and only those under several roots are written.  Pairs are
    never rows: tasks hold those that meet against their ``parities``, and tell by a forest which documents belong to one cluster.  Narrow parities
    tell long texts apart no more, so clusters are cut again by parities as wide as the sets need; the sets of what is left are then held against each
    other, cluster by cluster, and again a task returns a forest.  A member that ``meet`` documents share, and a cluster of ``held`` shingles, are cut
    into parts, of which a task sees two.
    """
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(_bucket_counts(docs, text_col, shingle, seed))
    inner = docs.select(_node(F.col(f"`{text_col}`")).alias("node"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, per = _distinct(*_shingle_hashes(part.column("text"), shingle, seed))
                some, place, take = prefixes(hashes, per, counts.value, similarity)
                cut = pa.array(np.r_[0, np.cumsum(take)].astype(np.int32))
                bits = [x.tobytes() for x in parities(hashes, per, PARITY_BITS)]
                wide = wide_parities(hashes, per)
                columns = [part.column("node"), pa.ListArray.from_arrays(cut, pa.array(some.view(np.int64))), pa.array(bits, pa.binary()), pa.array(wide, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "h", "bits", "wide"])

    of = named.select("node", F.xxhash64("node").alias("i"), F.xxhash64("root").alias("r"), "n")
    sets = written(inner.mapInArrow(run, "node binary, h array<long>, bits binary, wide binary").dropDuplicates(["node"]).join(of, "node").drop("node"), "sets")
    met = written(_meeting(sets, similarity, meet, block), "met")
    if met.isEmpty():
        return spark.createDataFrame([], "a binary, b binary")
    cluster = lambda links: components(links).select(F.col("node").alias("i"), F.col("root").alias("cluster"))
    rough = written(cluster(met).join(sets.select("i", "r", "n", "wide"), "i"), "rough")
    closer = written(_closer(rough, similarity, WIDE_HELD), "closer")
    if closer.isEmpty():
        return spark.createDataFrame([], "a binary, b binary")
    clusters = written(cluster(closer).join(of, "i").drop("i"), "clusters")
    shingles = _sets(docs, clusters.select("node"), text_col, shingle, seed).join(clusters, "node")
    return _held(shingles, similarity, held)


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = WIDE_RADIUS, home: int = WIDE_HOME, other: int = WIDE_OTHER
) -> DataFrame:
    """One row per document: ``id``, ``key`` (its text's 128 bits), its component's ``root`` key and ``component_id``, the smallest id reachable."""
    rows = written(wide_fingerprints(docs, id_col, text_col, shingle, similarity), "simhash")
    nodes = written(rows.groupBy("node").agg(F.min("id").alias("least"), *[F.first(c).alias(c) for c in ("n", "c", *[f"f{k}" for k in range(LANES)])]), "nodes")
    links = written(wide_links(nodes.drop("least"), similarity, radius, home, other), "links")
    near = written(_alike(docs, links, text_col, shingle, similarity), "near")
    under = lambda roots: nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least", "n")
    named = written(under(components(near)), "named")
    more = written(_missed(docs, named, text_col, shingle, similarity), "more")
    if not more.isEmpty():
        named = written(under(components(near.unionAll(more))), "named")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.join(ids, "root").select("node", "root", "component_id")
    return rows.join(found, "node").select("id", F.col("node").alias("key"), "root", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs``, with all their columns, that stand first (by id, then key) among their near copies; of repeated rows, one."""
    found = written(near_copies(docs, id_col, text_col, **options), "near-copies")
    return _drop(docs, found, id_col, _node(F.col(f"`{text_col}`")))
