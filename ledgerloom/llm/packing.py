"""Packing by concatenate-and-cut.

All documents, each followed by an end id, form one stream that is cut every ``length`` ids:

1. **First pass.**  Documents are tokenised once; each partition numbers its documents' ids from zero, and the token ids
   are written to the shared folder with that local offset.
2. **Prefix sums.**  Partition totals (one small row per partition, summed in groups of 1,000 partitions and then
   over the groups) give each partition its global offset.
3. **Second pass.**  Global offset modulo ``length`` gives the cuts; a document gives one *boundary record* per
   sequence that it reaches into.  No token moves between partitions.

Only the last sequence is shorter than ``length``.

Tokenising splits texts at single spaces where the byte-level pre-tokeniser always splits too (see ``_cuts``), so each
distinct piece is encoded once and its ids are copied; a worker remembers a bounded number of pieces.  Where the
tokenizer file is a byte-level BPE whose merges are in the order of their ids (checked when it is loaded), plain pieces
are encoded by rank, which gives the same ids faster; all others go through the tokenizer itself.

Edge cases: a null text is empty; an empty text is its end id alone; null ids pass through; repeated rows are
separate documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm._storage import bounded_batches, written
from ledgerloom.llm._words import slices, text_bytes

LENGTH = 1024
#: Bytes of texts that are tokenised together: the more, the fewer distinct pieces are looked up in all.
TOGETHER = 8 << 20
_loaded: dict[str, "_Encoder"] = {}
#: Bytes that never are, or start, white space: printable ASCII, and lead bytes of no white-space character.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SOLID[0xC3:0xE1] = True
_SOLID[0xE4:0xF5] = True


#: The byte-level pre-tokeniser's pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED = 200_000


class _Encoder:
    """Ids of pieces, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked, self.newline = self._by_rank(path)

    def _by_rank(self, path: str):
        """An encoder by merge rank, if the file allows it, and the id of a line feed."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        pairs = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer"):
            return None, -1
        vocab = {k: v for k, v in model["vocab"].items() if k not in self.added}
        if model.get("ignore_merges") or [vocab.get(x) for x in pairs] != list(range(256, 256 + len(pairs))) or len(vocab) != 256 + len(pairs):
            return None, -1
        printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(printed)]
        byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(rest)}
        import tiktoken

        ranks = {bytes(byte[c] for c in k): v for k, v in vocab.items()}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks[b"\n"]

    def _plain(self, piece: str) -> bool:
        words = piece.split()
        return len(words) == 1 and piece in (words[0], " " + words[0]) and not any(a in piece for a in self.added)

    def __call__(self, pieces: list[str]) -> list[bytes]:
        out = [self.cache.get(p) for p in pieces]
        missing = [i for i, x in enumerate(out) if x is None]
        plain = [i for i in missing if self._plain(pieces[i])] if self.ranked else []
        for at in range(0, len(plain), 500):
            some = plain[at : at + 500]  # a line feed between words is a token of its own
            ids = np.array(self.ranked.encode_ordinary("\n".join([pieces[i] for i in some]) + "\n"), "<u4")
            data, ends = ids.tobytes(), (np.flatnonzero(ids == self.newline) * 4).tolist()
            for i, a, b in zip(some, [0, *[e + 4 for e in ends]], ends):
                out[i] = data[a:b]
        others = [i for i in missing if out[i] is None]
        for i, e in zip(others, self.tokenizer.encode_batch_fast([pieces[i] for i in others], add_special_tokens=False)):
            out[i] = np.array(e.ids, "<u4").tobytes()
        if len(self.cache) >= CACHED and 2 * len(missing) > len(pieces):
            self.cache.clear()
        for i in missing[: max(0, CACHED - len(self.cache))]:
            if len(pieces[i]) < 64:
                self.cache[pieces[i]] = out[i]
        return out


def _encoder(path: str) -> _Encoder:
    if path not in _loaded:
        _loaded[path] = _Encoder(path)
    return _loaded[path]


def _cuts(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of pieces: row starts, and single spaces between bytes that are not white space.

    A byte-level pattern (an optional space, then letters, digits or symbols; or white space up to its last character)
    never joins what stands left of such a space with it, so pieces can be encoded on their own.
    """
    space = np.flatnonzero(raw == 32)
    space = space[(space > 0) & (space < len(raw) - 1)]
    opens = np.zeros(len(raw), bool)
    opens[space] = _SOLID[raw[space + 1]] & (raw[space - 1] > 32)
    opens[offs[:-1][np.diff(offs) > 0]] = True
    return np.flatnonzero(opens)


def encode(column: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text with ``end_id`` behind it: all ids, and each row's offset in them."""
    raw, offs = text_bytes(column)
    cut = _cuts(raw, offs)
    bounds = np.r_[cut, len(raw)].astype(np.int64)
    pieces = pa.LargeStringArray.from_buffers(len(cut), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw)))
    coded = pc.dictionary_encode(pieces)
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    distinct = _encoder(path)(coded.dictionary.to_pylist())
    code = coded.indices.to_numpy(zero_copy_only=False)
    size = np.array([len(x) for x in distinct], np.int64) // 4
    flat = np.frombuffer(b"".join(distinct), "<u4")
    base = np.cumsum(size) - size
    per = size[code] if len(code) else size
    total = np.r_[0, np.cumsum(per)]
    first = np.searchsorted(cut, offs)  # first piece of each row
    row_at = total[first] + np.arange(len(offs))
    out = np.full(int(total[-1]) + len(offs) - 1, end_id, np.uint32)
    body = np.ones(len(out), bool)
    body[row_at[1:] - 1] = False
    start = np.cumsum(per) - per
    out[body] = flat[np.repeat(base[code] - start, per) + np.arange(int(total[-1]))]
    return out, row_at


def tokenised(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """Rows ``part, id, at, n, ids``: a partition's documents with their ids and local offsets."""
    bounded_batches(docs.sparkSession)
    inner = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            for part in slices(batch, "text", TOGETHER):
                ids, offs = encode(part.column("text"), tokenizer, end_id)
                wide = 4 if len(ids) and int(ids.max()) > 0xFFFF else 2
                data, cut = ids.astype(f"<u{wide}").tobytes(), (offs * wide).tolist()
                yield pa.RecordBatch.from_arrays(
                    [part.column("part"), part.column("id"), pa.array(offs[:-1] + at), pa.array(np.diff(offs)), pa.array([data[a:b] for a, b in zip(cut, cut[1:])], pa.binary())],
                    names=["part", "id", "at", "n", "ids"],
                )
                at += int(offs[-1])

    out = T.StructType().add("part", T.IntegerType()).add("id", inner.schema["id"].dataType).add("at", "long").add("n", "long").add("ids", "binary")
    return inner.mapInArrow(run, out)


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """One row per piece of a document: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``)."""
    rows = written(tokenised(docs, tokenizer, id_col, text_col, end_id), "tokens")
    totals = rows.groupBy("part").agg(F.sum("n").alias("n")).withColumn("bunch", F.floor(F.col("part") / 1000))
    bunches = totals.groupBy("bunch").agg(F.sum("n").alias("m"))
    before = lambda part, order: Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = bunches.select("bunch", F.coalesce(F.sum("m").over(before([], "bunch")), F.lit(0)).alias("ahead"))
    offsets = totals.join(ahead, "bunch").select("part", (F.col("ahead") + F.coalesce(F.sum("n").over(before(["bunch"], "part")), F.lit(0))).alias("base"))
    # One row per partition of the input: 24 bytes for each of its read splits.
    placed = rows.join(F.broadcast(offsets), "part").select("id", (F.col("base") + F.col("at")).alias("at"), "n", "ids")
    kind = rows.schema["id"].dataType
    out = T.StructType().add("id", kind).add("start", "long").add("length", "long").add("ids_crc32", "long").add("doc_tokens", "long").add("sequence_id", "long").add("offset", "long")
    out = out.add("ids", T.ArrayType(T.IntegerType())) if with_ids else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "n"))
            first = at // length
            per = (at + n - 1) // length - first + 1
            row = np.repeat(np.arange(len(n)), per)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
            begin = np.maximum(sequence * length, at[row])
            size = np.minimum((sequence + 1) * length, (at + n)[row]) - begin
            start = begin - at[row]
            cells = batch.column("ids")
            crc, lists, held, ids = np.empty(len(row), np.int64), [], -1, np.zeros(0, np.uint32)
            for i, (r, s, k) in enumerate(zip(row.tolist(), start.tolist(), size.tolist())):
                if r != held:
                    data, held = cells[r].as_buffer(), r
                    ids = np.frombuffer(data, f"<u{len(data) // int(n[r])}").astype("<u4")
                crc[i] = zlib.crc32(ids[s : s + k])
                if with_ids:
                    lists.append(ids[s : s + k].astype(np.int32))
            cols = [batch.column("id").take(pa.array(row)), *map(pa.array, (start, size, crc, n[row], sequence, begin - sequence * length))]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(lists, pa.list_(pa.int32()))] if with_ids else []), names=out.names)

    return placed.mapInArrow(run, out).withColumnRenamed("id", id_col)
