"""SentencePiece encoding and decoding with N-best segmentations.

Texts are normalised as the model says for identity models: a space in front, every space as ``▁``.  All pieces of the model that spell a
substring are edges of the *piece lattice*; a character that no piece covers is an unknown edge, written as byte pieces.

* **Forward Viterbi** gives every lattice position the best score of its prefix.
* **Backward A-star** starts at the end of the text and extends hypotheses leftward; the Viterbi score of what is left to cover is its
  exact heuristic, so complete hypotheses leave the agenda in order of score.

No piece holds ``▁`` after another character (checked when a model is loaded), so a text falls into chunks that can be segmented on their own.
Viterbi runs over all distinct chunks of a batch at once; it also yields the gap to a chunk's second-best segmentation.  Where that is nothing, A-star's
first segmentation counts as the best, so that ties fall the same way everywhere.  The N best segmentations of a text differ from its best in chunks among the ``N - 1`` smallest gaps, so A-star runs for those chunks only, and
their alternatives are merged into the text's N best.

Scores: a unigram model's own; the scores of a BPE model are merge ranks, no probabilities, so pieces get Zipf's ``-log(rank + 1)``, in
1/1024, which makes all sums exact.

Edge cases: a null or empty text has no pieces, one segmentation of score zero, and decodes to the empty text; ``▁`` in a text
decodes as a space; repeated rows each give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm._storage import bounded_batches
from ledgerloom.llm._words import slices, text_bytes

NBEST, CACHED, WIDE = 4, 400_000, 64
#: Scores that differ by less are equal; sums of a unigram model's scores depend on their order.
TIE = 1e-9
SPACE = "▁"
_MUL = np.uint64(0x9E3779B97F4A7C15)
_loaded: dict[str, "Model"] = {}


def model(path: str) -> "Model":
    if path not in _loaded:
        _loaded[path] = Model(path)
    return _loaded[path]


class Model:
    """Pieces, scores and lookup tables of a model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto.FromString(sp.serialized_model_proto()).normalizer_spec
        if spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("the model normalises texts in another way: only an identity with a space in front and all spaces kept is supported")
        size = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        raw = [sp.get_score(i) for i in range(size)]
        self.byte = [0] * 256
        self.piece: dict[str, tuple[int, float]] = {}
        self.surface = [b""] * size
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        ranked = all(raw[i] <= 0 and raw[i] == round(raw[i]) for i in plain)
        for i in range(size):
            if sp.is_byte(i):
                self.byte[int(names[i][1:-1], 16)] = i
                self.surface[i] = bytes([int(names[i][1:-1], 16)])
        for i in plain:
            self.piece[names[i]] = (i, -round(1024 * math.log(1 - raw[i])) / 1024 if ranked else raw[i])
            self.surface[i] = names[i].encode()
        if any(SPACE in n.lstrip(SPACE) for n in self.piece):
            raise ValueError("pieces that cross spaces are not supported")
        self.longest = max(map(len, self.piece))
        self.unknown = min(s for _, s in self.piece.values()) - 10
        self._tables()
        self.cache: dict[str, tuple[bytes, float, float]] = {}
        self.lists: dict[tuple[str, int], list[tuple[float, bytes]]] = {}

    def _tables(self) -> None:
        """Per length, sorted hashes of all prefixes of pieces, and the piece that each spells (or -1)."""
        ids: list[dict[str, int]] = [{} for _ in range(self.longest + 1)]
        for name, (i, _) in self.piece.items():
            for n in range(1, len(name)):
                ids[n].setdefault(name[:n], -1)
            ids[len(name)][name] = i
        self.keys, self.ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for n in range(1, self.longest + 1):
            names = list(ids[n])
            codes = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).reshape(-1, n).astype(np.uint64)
            h = np.zeros(len(names), np.uint64)
            for k in range(n):
                h = h * _MUL + codes[:, k] + np.uint64(1)
            order = np.argsort(h)
            self.keys.append(h[order])
            self.ids.append(np.array([ids[n][x] for x in names], np.int64)[order])
        self.score = np.zeros(len(self.surface))
        for i, s in self.piece.values():
            self.score[i] = s

    def ids_of(self, text: str, piece: int) -> list[int]:
        """Ids of an edge: its piece, or the bytes of an unknown character."""
        return [piece] if piece >= 0 else [self.byte[b] for b in text.encode()]

    def edges(self, chunk: str) -> list[list[tuple[int, int, float]]]:
        """Lattice of one chunk: for each end position, edges (start, piece or -1, score)."""
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(len(chunk) + 1)]
        for s in range(len(chunk)):
            for e in range(s + 1, min(len(chunk), s + self.longest) + 1):
                found = self.piece.get(chunk[s:e])
                if found:
                    into[e].append((s, *found))
                elif e == s + 1:
                    into[e].append((s, -1, self.unknown))
        return into

    def forward(self, into) -> list[float]:
        best = [0.0]
        for edges in into[1:]:
            best.append(max(best[s] + w for s, _, w in edges))
        return best

    def nbest(self, chunk: str, n: int) -> list[tuple[float, bytes]]:
        """Up to ``n`` best segmentations of a chunk as (score, ids), by backward A-star."""
        known = self.lists.get((chunk, n))
        if known is not None:
            return known
        into = self.edges(chunk)
        ahead = self.forward(into)
        # Of equal scores the hypothesis nearest to the start goes first: ties are followed down, not fanned out.
        agenda = [(-ahead[-1], len(chunk), 0, 0.0, None)]
        out: list[tuple[float, bytes]] = []
        count = 0
        while agenda and len(out) < n:
            _, at, _, done, path = heapq.heappop(agenda)
            if at == 0:
                ids: list[int] = []
                while path:
                    ids += self.ids_of(chunk[path[0] : path[1]], path[2])
                    path = path[3]
                out.append((done, np.array(ids, "<u4").tobytes()))
                continue
            for s, piece, w in into[at]:
                count += 1
                heapq.heappush(agenda, (-(done + w + ahead[s]), s, count, done + w, (s, at, piece, path)))
        if len(self.lists) > CACHED // 4:
            self.lists.clear()
        if len(chunk) <= WIDE:
            self.lists[chunk, n] = out
        return out

    def segment(self, chunks: list[str]) -> list[tuple[bytes, float, float]]:
        """Best ids, score, and gap to the second-best score (infinite if there is none) of each chunk."""
        out = [self.cache.get(c) for c in chunks]
        missing = [i for i, x in enumerate(out) if x is None]
        short = [i for i in missing if len(chunks[i]) <= WIDE]
        for i, found in zip(short, self._viterbi([chunks[i].replace(" ", SPACE) for i in short])):
            out[i] = found if found[2] > TIE else (self.nbest(chunks[i].replace(" ", SPACE), NBEST)[0][1], *found[1:])
        for i in missing:
            if out[i] is None:
                two = self.nbest(chunks[i].replace(" ", SPACE), 2)
                out[i] = (two[0][1], two[0][0], two[0][0] - two[1][0] if len(two) > 1 else math.inf)
        if len(self.cache) >= CACHED and 2 * len(missing) > len(chunks):
            self.cache.clear()
        for i in short[: max(0, CACHED - len(self.cache))]:
            self.cache[chunks[i]] = out[i]
        return out

    def _viterbi(self, chunks: list[str]) -> list[tuple[bytes, float, float]]:
        """Forward and backward Viterbi over many chunks at once."""
        if not chunks:
            return []
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        code = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).astype(np.uint64)
        first = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(chunks)), size)
        room = (first + size)[owner] - np.arange(len(code))
        node = np.arange(len(code)) + owner  # lattice position of a character; each chunk has one more at its end
        live, h = np.arange(len(code)), np.zeros(len(code), np.uint64)
        start, length, piece = [], [], []
        for n in range(1, self.longest + 1):
            fits = room[live] >= n
            live, h = live[fits], h[fits]
            if not len(live):
                break
            h = h * _MUL + code[live + n - 1] + np.uint64(1)
            at = np.searchsorted(self.keys[n], h)
            at[at == len(self.keys[n])] = 0
            hit = self.keys[n][at] == h
            found = np.where(hit, self.ids[n][at], -1)
            take = found >= 0 if n > 1 else np.ones(len(live), bool)
            start.append(live[take])
            length.append(np.full(int(take.sum()), n))
            piece.append(found[take])
            live, h = live[hit], h[hit]
        s, n, piece = np.concatenate(start), np.concatenate(length), np.concatenate(piece)
        weight = np.where(piece >= 0, self.score[piece], self.unknown)
        begin, end = node[s], node[s] + n
        chunk = owner[s]
        # Edges by how far into the chunk they end; at most one edge of a length ends at a position.
        key = ((s - first[chunk] + n) * (self.longest + 1) + n).astype(np.uint16)
        order = np.argsort(key, kind="stable")
        key = key[order]
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        nodes = len(code) + len(chunks)
        ahead = np.full(nodes, -np.inf)
        ahead[first + np.arange(len(chunks))] = 0
        best = np.full(nodes, -1)
        for a, b in zip(cut[:-1], cut[1:]):
            e = order[a:b]
            value = ahead[begin[e]] + weight[e]
            more = value > ahead[end[e]]
            ahead[end[e][more]] = value[more]
            best[end[e][more]] = e[more]
        behind = np.full(nodes, -np.inf)
        last = first + size + np.arange(len(chunks))
        behind[last] = 0
        key = ((WIDE - (s - first[chunk])) * (self.longest + 1) + n).astype(np.uint16)
        left = np.argsort(key, kind="stable")
        key = key[left]
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        for a, b in zip(cut[:-1], cut[1:]):
            e = left[a:b]
            behind[begin[e]] = np.maximum(behind[begin[e]], weight[e] + behind[end[e]])
        on_best = np.zeros(len(s), bool)
        at, active, head = last.copy(), np.arange(len(chunks)), first + np.arange(len(chunks))
        while len(active):
            e = best[at[active]]
            on_best[e] = True
            at[active] = begin[e]
            active = active[at[active] > head[active]]
        through = np.where(on_best, -np.inf, ahead[begin] + weight + behind[end])
        second = np.full(len(chunks), -np.inf)
        np.maximum.at(second, chunk, through)
        score = ahead[last]
        path = np.flatnonzero(on_best)
        path = path[np.argsort(begin[path], kind="stable")]
        data = piece[path].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(chunk[path], minlength=len(chunks))) * 4).tolist()
        found = [data[a:b] for a, b in zip([0, *ends], ends)]
        for c in np.unique(chunk[path[piece[path] < 0]]).tolist():  # chunks with unknown characters
            edges = path[(ends[c - 1] if c else 0) // 4 : ends[c] // 4]
            ids = [i for x in edges.tolist() for i in self.ids_of(chunks[c][s[x] - first[c] : s[x] - first[c] + n[x]], int(piece[x]))]
            found[c] = np.array(ids, "<u4").tobytes()
        return list(zip(found, score.tolist(), (score - second).tolist()))

    def decode(self, ids) -> bytes:
        """Text of a segmentation, in UTF-8."""
        return b"".join(map(self.surface.__getitem__, ids)).replace(SPACE.encode(), b" ")[1:]


def _chunks(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of chunks: row starts, line feeds and what follows them, and spaces after other bytes."""
    opens = np.zeros(len(raw) + 1, bool)
    opens[1:-1] = (raw[1:] == 32) & (raw[:-1] != 32)
    feed = np.flatnonzero(raw == 10)
    opens[feed] = True
    opens[feed + 1] = True
    opens[offs[:-1][np.diff(offs) > 0]] = True
    return np.flatnonzero(opens[:-1])


def merge(gaps: list[tuple[float, int]], lists: list[list[tuple[float, bytes]]], n: int) -> list[tuple[float, tuple]]:
    """The ``n`` least losses of choosing one alternative for each place: (loss, ((place, alternative), ...))."""
    out: list[tuple[float, tuple]] = [(0.0, ())]
    for (_, place), options in zip(gaps, lists):
        out = sorted(
            ((loss + options[0][0] - score, chosen + (((place, k),) if k else ())) for loss, chosen in out for k, (score, _) in enumerate(options)),
            key=lambda x: x[0],
        )[:n]
    return out


def encode_column(column: pa.Array, m: Model, nbest: int = NBEST) -> list[tuple[bytes, list[float], list[bytes]]]:
    """Per text: best ids, scores of its N best segmentations, and their ids (the first is the best)."""
    raw, offs = text_bytes(column)
    some = np.diff(offs) > 0
    raw = np.insert(raw, offs[:-1][some], 32)
    offs = offs + np.r_[0, np.cumsum(some)]
    cut = _chunks(raw, offs)
    coded = pc.dictionary_encode(pa.LargeStringArray.from_buffers(len(cut), pa.py_buffer(np.r_[cut, len(raw)].astype(np.int64)), pa.py_buffer(raw)))
    names = coded.dictionary.to_pylist()
    found = m.segment(names)
    ids, scores, gap = [f[0] for f in found], np.array([f[1] for f in found]), np.array([f[2] for f in found])
    code = coded.indices.to_numpy(zero_copy_only=False)
    size = np.array([len(x) for x in ids], np.int64)
    first = np.searchsorted(cut, offs).tolist()
    out = []
    for a, b in zip(first, first[1:]):
        mine = code[a:b]
        data = b"".join([ids[c] for c in mine.tolist()])
        total = float(scores[mine].sum())
        if b == a or nbest < 2:
            out.append((data, [total], [data]))
            continue
        g = gap[mine]
        near = np.argsort(g, kind="stable")[: nbest - 1] if len(g) < 64 else _least(g, nbest - 1)
        places = [(float(g[i]), int(i)) for i in near if np.isfinite(g[i])]
        lists = [m.nbest(names[mine[i]].replace(" ", SPACE), nbest) for _, i in places]
        at = np.r_[0, np.cumsum(size[mine])]
        options = {i: x for (_, i), x in zip(places, lists)}
        losses, alternatives = [], []
        for loss, chosen in merge(places, lists, nbest):
            parts, done = [], 0
            for i, k in sorted(chosen):
                parts += [data[done : at[i]], options[i][k][1]]
                done = int(at[i + 1])
            losses.append(total - loss)
            alternatives.append(b"".join([*parts, data[done:]]))
        out.append((data, losses, alternatives))
    return out


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Indices of the ``n`` least values, by value and then position."""
    limit = np.partition(values, n - 1)[n - 1]
    below, equal = np.flatnonzero(values < limit), np.flatnonzero(values == limit)
    pick = np.r_[below, equal[: n - len(below)]]
    return pick[np.argsort(values[pick], kind="stable")]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", nbest: int = NBEST, with_ids: bool = False) -> DataFrame:
    """One row per document: ``id_col, n_pieces, ids_crc32, nbest_scores, nbest_crc32, decoded_sha256`` (and ``ids, nbest_ids``)."""
    bounded_batches(docs.sparkSession)
    inner = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = T.StructType().add("id", inner.schema["id"].dataType).add("n_pieces", "long").add("ids_crc32", "long")
    out = out.add("nbest_scores", T.ArrayType(T.DoubleType())).add("nbest_crc32", T.ArrayType(T.LongType())).add("decoded_sha256", "string")
    if with_ids:
        out = out.add("ids", T.ArrayType(T.IntegerType())).add("nbest_ids", T.ArrayType(T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        ints = lambda data: np.frombuffer(data, "<u4").astype(np.int32)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                found = encode_column(part.column("text"), m, nbest)
                columns = [
                    part.column("id"),
                    pa.array([len(d) // 4 for d, _, _ in found], pa.int64()),
                    pa.array([zlib.crc32(d) for d, _, _ in found], pa.int64()),
                    pa.array([s for _, s, _ in found], pa.list_(pa.float64())),
                    pa.array([[zlib.crc32(x) for x in a] for _, _, a in found], pa.list_(pa.int64())),
                    pa.array([hashlib.sha256(m.decode(np.frombuffer(d, "<u4").tolist())).hexdigest() for d, _, _ in found]),
                ]
                if with_ids:
                    columns += [pa.array([ints(d) for d, _, _ in found], pa.list_(pa.int32())), pa.array([[ints(x) for x in a] for _, _, a in found], pa.list_(pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return inner.mapInArrow(run, out).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Add the text that the pieces of ``ids_col`` spell; null ids give a null text."""

    def spell(ids):
        m = model(path)
        return ids.map(lambda x: None if x is None else m.decode(x).decode("utf-8", "replace"))

    return tokens.withColumn(text_col, F.pandas_udf(spell, "string", F.PandasUDFType.SCALAR)(F.col(f"`{ids_col}`")))
