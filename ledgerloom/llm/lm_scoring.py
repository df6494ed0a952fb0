"""Language-model scores by deleted interpolation.

The probability of a token after a context mixes three estimates,

    P(w | v) = a[b] * c(v, w) / c(v)  +  m[b] * c(w) / N  +  u[b] / (V + 1),        b = context-frequency bucket of c(v),

with one weight triple per bucket.  Counts come from all training documents.  The weights are learned by expectation-maximisation on
*deleted* counts: one fold of the training documents is taken out of the counts (its own counts are subtracted), and the weights
are those that make that fold likely.  Scored documents outside the training set take no part in counting or weights.

Counts travel by the packed key exchange of ``_buckets``: a bucket of documents asks for each of its distinct words and
word pairs once, sending its own counts along, and gets the corpus counts back.  Nothing is pruned.  Documents are dealt by their row numbers.

The mixtures of the context buckets do not depend on each other, so each is fitted in a task of its own.  It sees the tokens of the fold in cells of
equal c(v,w)/c(v) and c(w), up to a sixteenth of an octave, with the mean of both in the cell: at most 1,024 x 1,024 cells a bucket, since
counts have 64 bits, however large the corpus is.

Edge cases: a null or empty text is one end token; a null id counts as training; repeated rows are separate documents;
without any document in the fold the weights are ``DEFAULT``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import _buckets as B
from ledgerloom.llm._words import Words, mix, tidy

U64 = np.uint64
END, START = U64(0x51ED270B9F3A7C15), U64(0x3C79AC492BA7B653)
CONTEXTS, STEPS = 17, 16
DEFAULT = (0.3, 0.6, 0.1)
ROUNDS = 2000
_WIDTHS = (np.uint8, np.uint16, np.uint32, np.uint64)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 10 == 0, F.lit(False))


def fold(id_col: Column) -> Column:
    """Training documents that the weights are learned on."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 10 == 1, F.lit(False))


def _pack(*counts: np.ndarray) -> bytes:
    """Arrays of counts, each in the least width that holds it; most counts are 0 or 1, so they are deflated."""
    out = []
    for c in counts:
        top = int(c.max()) if len(c) else 0
        wide = 0 if top < 1 << 8 else 1 if top < 1 << 16 else 2 if top < 1 << 32 else 3
        out += [bytes([wide]), c.astype(_WIDTHS[wide]).tobytes()]
    return zlib.compress(b"".join(out), 1)


def _unpack(data: bytes, n: int, arrays: int) -> list[np.ndarray]:
    out, at, data = [], 0, zlib.decompress(data)
    for _ in range(arrays):
        kind = np.dtype(_WIDTHS[data[at]])
        out.append(np.frombuffer(data, kind, n, at + 1).astype(np.int64))
        at += 1 + n * kind.itemsize
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as differences: the low five bytes as they are, the high three, mostly zero, deflated."""
    steps = np.ascontiguousarray(np.diff(keys, prepend=U64(0))).astype("<u8").view(np.uint8).reshape(-1, 8)
    return steps[:, :5].tobytes() + zlib.compress(np.ascontiguousarray(steps[:, 5:].T).tobytes(), 1) + len(keys).to_bytes(4, "little")


def unpack_keys(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[-4:], "little")
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :5] = np.frombuffer(data, np.uint8, 5 * n).reshape(n, 5)
    steps[:, 5:] = np.frombuffer(zlib.decompress(data[5 * n : -4]), np.uint8).reshape(3, n).T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


class _Tokens:
    """Token and context of every token of a bucket, as indices into its distinct words and pairs."""

    def __init__(self, table: pa.Table):
        w = Words(table.column("text").combine_chunks(), lower=True)
        rows = len(w.row) - 1
        self.first = w.row[:-1] + np.arange(rows)  # first token of each row; every row has an end token
        self.per = w.per_row + 1
        token = np.full(w.n + rows, END, np.uint64)
        body = np.ones(len(token), bool)
        body[self.first + self.per - 1] = False
        token[body] = w.hashes()
        before = np.r_[START, token[:-1]] if len(token) else token
        self.opens = np.zeros(len(token), bool)
        self.opens[self.first] = True
        before[self.opens] = START
        self.words, self.word = np.unique(token, return_inverse=True)
        self.pairs, self.pair = np.unique(np.r_[START, mix(before * U64(0x9E3779B97F4A7C15) + token)], return_inverse=True)
        self.start, self.pair = self.pair[0], self.pair[1:]
        self.row = np.repeat(np.arange(rows), self.per)
        self.train = ~table.column("held_out").to_numpy()
        self.fold = table.column("fold").to_numpy()

    def counts(self, of_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pick = of_rows[self.row]
        pairs = np.bincount(self.pair[pick], minlength=len(self.pairs))
        pairs[self.start] += int(of_rows.sum())  # texts that start: the count of the first token's context
        return np.bincount(self.word[pick], minlength=len(self.words)), pairs


def _asks(table: pa.Table, blocks: int) -> pa.Table:
    tidy()
    t = _Tokens(table)
    bucket = table.column("bucket")[0].as_py()
    train, out = t.counts(t.train), []
    own = t.counts(t.fold)
    for i, keys in enumerate((t.words, t.pairs)):
        cut = np.r_[0, np.searchsorted(keys, B.bounds(blocks)), len(keys)].tolist()
        spans = [(j, a, b) for j, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
        out.append(
            pa.table(
                [
                    pa.array([i + 1] * len(spans), pa.int32()),
                    pa.array([j for j, _, _ in spans], pa.int32()),
                    pa.array([bucket] * len(spans), pa.int32()),
                    pa.array([pack_keys(keys[a:b]) for _, a, b in spans], pa.binary()),
                    pa.array([_pack(train[i][a:b], own[i][a:b]) for _, a, b in spans], pa.binary()),
                ],
                names=["round", "block", "bucket", "keys", "extra"],
            )
        )
    return pa.concat_tables(out)


def _reply(table: pa.Table, fold_from: int | None) -> pa.Table:
    """Sum the counts of a block's keys over all buckets and answer.

    For scores every bucket gets the training counts.  For the weights only buckets from ``fold_from`` on, which hold the fold,
    get training and fold counts, and bucket -1 gets the block's word statistics.
    """
    tidy()
    table = table.combine_chunks()
    rounds, buckets = table.column("round").to_numpy(), table.column("bucket").to_numpy()
    keys = [unpack_keys(k.as_py()) for k in table.column("keys")]
    sent = [_unpack(x.as_py(), len(k), 2) for x, k in zip(table.column("extra"), keys)]
    out: list[tuple[int, int, bytes]] = []
    stats = [0, 0, 0]
    for kind in (1, 2):
        mine = np.flatnonzero(rounds == kind)
        if not len(mine):
            continue
        distinct, inverse = np.unique(np.concatenate([keys[i] for i in mine]), return_inverse=True)
        sums = []
        for j in (0, 1):
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, inverse, np.concatenate([sent[i][j] for i in mine]))
            sums.append(total)
        if kind == 1:
            stats = [int((sums[0] > 0).sum()), int(sums[0].sum()), int(sums[1].sum())]
        at = 0
        for i in mine:
            own = inverse[at : at + len(keys[i])]
            at += len(own)
            if fold_from is None:
                out.append((kind, int(buckets[i]), _pack(sums[0][own])))
            elif buckets[i] >= fold_from:
                out.append((kind, int(buckets[i]), _pack(sums[0][own], sums[1][own])))
    if fold_from is not None:
        out.append((0, -1, np.array(stats, np.int64).tobytes()))
    block = int(table.column("block")[0].as_py())
    return pa.table(
        [pa.array([r for r, _, _ in out], pa.int32()), pa.array([block] * len(out), pa.int32()), pa.array([x for _, x, _ in out], pa.int32()), pa.array([x for _, _, x in out], pa.binary())],
        names=["round", "block", "bucket", "answer"],
    )


def _known(t: _Tokens, answers: pa.Table, blocks: int, arrays: int) -> list[list[np.ndarray]]:
    """Training (and fold) counts of the bucket's words and pairs."""
    rounds, block = answers.column("round").to_numpy(), answers.column("block").to_numpy()
    cells, out = answers.column("answer"), []
    for kind, keys in ((1, t.words), (2, t.pairs)):
        at = {int(block[i]): cells[int(i)].as_py() for i in np.flatnonzero(rounds == kind)}
        cut = np.r_[0, np.searchsorted(keys, B.bounds(blocks)), len(keys)].tolist()
        parts = [_unpack(at[j], b - a, arrays) for j, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
        out.append([np.concatenate([p[i] for p in parts]) for i in range(arrays)])
    return out


def _context(t: _Tokens, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Count of each token's context."""
    of_word = words[t.word]
    before = np.r_[0, of_word[:-1]]
    before[t.opens] = pairs[t.start]
    return before


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(count + 1.0).astype(np.int64), CONTEXTS - 1)


CELLS = "b long, ratio long, level long, n long, r double, w double"


def _cells(t: _Tokens, known) -> pa.Table:
    """Tokens of the fold by cell, with counts that leave the fold out: how many, and sums of c(v,w)/c(v) and of c(w)."""
    words, pairs = known[0][0] - known[0][1], known[1][0] - known[1][1]
    pick = t.fold[t.row]
    over, pair, word = _context(t, words, pairs)[pick], pairs[t.pair][pick], words[t.word][pick]
    share = np.where(over > 0, pair / np.maximum(over, 1), 0.0)
    ratio, level = np.zeros(len(pair), np.int64), np.zeros(len(word), np.int64)
    ratio[share > 0] = 1 + np.floor(-STEPS * np.log2(share[share > 0])).astype(np.int64)
    level[word > 0] = 1 + np.floor(STEPS * np.log2(word[word > 0])).astype(np.int64)
    cell, at = np.unique((context_bucket(over) << 40) | (ratio << 20) | level, return_inverse=True)
    sums = [np.bincount(at, weights=x, minlength=len(cell)) for x in (share, word.astype(float))]
    return pa.table(
        [pa.array(cell >> 40), pa.array((cell >> 20) & 0xFFFFF), pa.array(cell & 0xFFFFF), pa.array(np.bincount(at, minlength=len(cell)).astype(np.int64)), *map(pa.array, sums)],
        names=["b", "ratio", "level", "n", "r", "w"],
    )


def mixture(b: int, n: np.ndarray, share: np.ndarray, word: np.ndarray, total: int, types: int) -> np.ndarray:
    """Weights (pair, word, uniform) of context bucket ``b`` by expectation-maximisation, from cells of ``n`` tokens with c(v,w)/c(v) and c(w)."""
    # An unseen context has no pairs.
    weight = np.array([0.0, DEFAULT[0] + DEFAULT[1], DEFAULT[2]] if b == 0 else DEFAULT)
    if len(n):
        each = np.stack([share, word / max(1, total), np.full(len(n), 1.0 / (types + 1))], axis=1)
        for _ in range(ROUNDS):
            part = each * weight
            part *= (n / part.sum(axis=1))[:, None]
            new = part.sum(axis=0) / n.sum()
            still = np.abs(new - weight).max() < 1e-10
            weight = new
            if still:
                break
    weight = np.maximum(np.round(weight, 9), [0.0 if b == 0 else 1e-9, 1e-9, 1e-9])
    return weight / weight.sum()


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int | None = None, block_bytes: int | None = None) -> DataFrame:
    """One row per document: ``id_col, held_out, n_tokens, n_known, train_tokens, types, base_score, score``."""
    size = B.corpus_bytes(docs, text_col)
    bucket_bytes = bucket_bytes or B.grown(size, B.BUCKET_BYTES, 64 << 20)
    key = F.col(f"`{id_col}`")
    inner = docs.select(key.alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), held_out(key).alias("held_out"), fold(key).alias("fold"), F.monotonically_increasing_id().alias("row"))
    # The fold has buckets of its own, so that only those take part in fitting the weights.
    n = max(8, math.ceil(size / bucket_bytes))
    folds = math.ceil(n / 10)
    h = F.xxhash64("row")
    dealt = inner.withColumn("bucket", F.when(F.col("fold"), n + F.pmod(h, F.lit(folds))).otherwise(F.pmod(h, F.lit(n))).cast("int")).repartition(max((n + folds) // 3, 8), "bucket")
    blocks = B.block_count(size, block_bytes)
    grouped = dealt.groupBy("bucket")
    asked = grouped.applyInArrow(lambda table: _asks(table, blocks), B.ASK).groupBy("block")
    for_weights = asked.applyInArrow(lambda table: _reply(table, n), B.REPLY)
    for_scores = asked.applyInArrow(lambda table: _reply(table, None), B.REPLY)

    def cells(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in CELLS.split(", ")]
        if answers.num_rows and answers.column("bucket")[0].as_py() == -1:
            # Word statistics, for the fit of each context bucket: types, tokens, and tokens of the fold.
            stats = np.sum([np.frombuffer(x.as_py(), np.int64) for x in answers.column("answer")], axis=0)
            b, level = np.divmod(np.arange(3 * CONTEXTS), 3)
            none = np.zeros(len(b))
            return pa.table([pa.array(x) for x in (b, np.full(len(b), -1), level, np.tile(stats, CONTEXTS), none, none)], names=names)
        if not table.num_rows or not answers.num_rows:
            return pa.table([pa.array([], pa.float64() if c in "rw" else pa.int64()) for c in names], names=names)
        t = _Tokens(table)
        return _cells(t, _known(t, answers, blocks, 2))

    def fit(table: pa.Table) -> pa.Table:
        b, ratio, level, count, share, word = (table.column(c).to_numpy() for c in ("b", "ratio", "level", "n", "r", "w"))
        stats = dict(zip(level[ratio < 0].tolist(), count[ratio < 0].tolist()))
        n, share, word = count[ratio >= 0], share[ratio >= 0], word[ratio >= 0]
        types, total, own = stats.get(0, 0), stats.get(1, 0), stats.get(2, 0)
        weights = mixture(int(b[0]), n, share / n, word / n, total - own, types)
        return pa.table([pa.array([int(b[0])], pa.int64()), pa.array([[*weights.tolist(), float(total), float(types)]], pa.list_(pa.float64()))], names=["b", "model"])

    def joined(table: pa.Table) -> pa.Table:
        rows = [m for _, m in sorted(zip(table.column("b").to_pylist(), table.column("model").to_pylist()))]
        return pa.table([pa.array([np.array([x for m in rows for x in m[:3]] + rows[0][3:]).tobytes()], pa.binary())], names=["model"])

    found = grouped.cogroup(for_weights.groupBy("bucket")).applyInArrow(cells, CELLS)
    bounded = found.groupBy("b", "ratio", "level").agg(*[F.sum(c).alias(c) for c in ("n", "r", "w")])
    fitted = bounded.groupBy("b").applyInArrow(fit, "b long, model array<double>")  # CONTEXTS rows
    model = fitted.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(joined, "model binary")
    # The model is 53 numbers; every bucket gets a copy along with its counts.
    copies = model.select(F.lit(9).alias("round"), F.lit(0).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n + folds - 1))).alias("bucket"), F.col("model").alias("answer"))

    def scores(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], schema.field(i).type) for i in range(len(schema))], schema=schema)
        rounds = answers.column("round").to_numpy()
        model = np.frombuffer(answers.column("answer")[int(np.flatnonzero(rounds == 9)[0])].as_py())
        weights, total, types = model[:-2].reshape(CONTEXTS, 3), model[-2], model[-1]
        t = _Tokens(table)
        (words,), (pairs,) = _known(t, answers, blocks, 1)
        word, over = words[t.word], _context(t, words, pairs)
        w = weights[context_bucket(over)]
        p = w[:, 0] * pairs[t.pair] / np.maximum(over, 1) + w[:, 1] * word / max(total, 1) + w[:, 2] / (types + 1)
        base = np.log10((word + 0.1) / (total + 0.1 * (types + 1)))
        add = lambda x: np.add.reduceat(x, t.first)
        rows = table.num_rows
        return pa.table(
            [table.column("id"), table.column("held_out"), pa.array(t.per.astype(np.int64)), pa.array(add((word > 0).astype(np.int64))), pa.array(np.full(rows, int(total))), pa.array(np.full(rows, int(types))), pa.array(add(base)), pa.array(add(np.log10(p)))],
            schema=schema,
        )

    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType().add("id", inner.schema["id"].dataType).add("held_out", "boolean")
    for name in ("n_tokens", "n_known", "train_tokens", "types"):
        out = out.add(name, "long")
    out = out.add("base_score", "double").add("score", "double")
    schema = to_arrow_schema(out)
    done = grouped.cogroup(for_scores.unionAll(copies).groupBy("bucket")).applyInArrow(scores, out)
    return done.withColumnRenamed("id", id_col)
