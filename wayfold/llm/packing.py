"""Best-fit packing, planned on the histogram of lengths.

The plan treats counts, not documents: at most one entry for each length and
group of like sequences. Pieces then take the slots planned for their length
by their rank within it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import _shared as S

SIZE = 2048
#: Pieces of one length that are ranked in one task at most, about.
RANKED = 1 << 10
#: Words whose ids a worker keeps.
CACHED = 1 << 20
PIECES = "piece int, start long, length long, ids_crc32 long"


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[k for k in range(33, 127) if not chr(k).isalnum() and chr(k) != "'"]] = True


def units(data: np.ndarray, offsets: np.ndarray):
    """The bytes to encode and the starts, ends and row offsets of what is encoded by itself.

    The tokenizer lowers case and divides at white space and between a letter or
    digit and the marks behind it, so a word and its closing marks are two units.
    Text that may hold a special token's string is left as it is.
    """
    starts, ends, bounds = S.word_bounds(data, offsets)
    if b"<|" in memoryview(np.ascontiguousarray(data)).tobytes():
        return data, starts, ends, bounds
    data = _LOWER[data]
    other = np.maximum.accumulate(np.where(_MARK[data], -1, np.arange(len(data))))
    core = other[ends - 1] + 1
    two = (core > starts) & (core < ends)
    two[two] = _ALNUM[data[core[two] - 1]]
    at = np.arange(len(starts)) + np.cumsum(two) - two
    n = len(starts) + int(two.sum())
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    a[at], b[at] = starts, np.where(two, core, ends)
    a[at[two] + 1], b[at[two] + 1] = core[two], ends[two]
    return data, a, b, np.r_[at, n][bounds]


class WordIds:
    """Ids of units, which the tokenizer never joins, so each distinct one is encoded once."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self):
        self.keys, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        ids, counts = [], []
        for k in range(0, len(words), 8192):
            part = words[k : k + 8192]
            found = self.tokenizer.encode("\n".join(part), add_special_tokens=False)
            size = np.fromiter(map(len, part), np.int64, len(part)) + 1
            begin = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
            counts.append(np.bincount(np.searchsorted(np.cumsum(size), begin, side="right"), minlength=len(part)))
            ids.append(np.array(found.ids, np.uint32))
        return np.concatenate(ids), np.concatenate(counts)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each closed by a 0, and the rows' offsets in them."""
        data, starts, ends, bounds = units(data, offsets)
        hashes = np.concatenate([np.zeros(0, np.uint64), *(S.span_hashes(data[offsets[a] : offsets[b]], starts[bounds[a] : bounds[b]] - offsets[a], ends[bounds[a] : bounds[b]] - offsets[a]) for a, b in S.chunks(offsets))])
        keys, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > CACHED:
            self.clear()
        slot = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(slot, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            words = [data[a:b].tobytes().decode() for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)]
            ids, count = self._encode(words)
            first = len(self.ids) + np.cumsum(count) - count
            self.ids = np.r_[self.ids, ids]
            self.first, self.count = np.insert(self.first, slot[new], first), np.insert(self.count, slot[new], count)
            self.keys = np.insert(self.keys, slot[new], keys[new])
            slot = np.searchsorted(self.keys, keys)
        word = slot[inverse]
        count = self.count[word]
        total = np.r_[0, np.cumsum(count)]
        rows = np.arange(len(offsets) - 1)
        out = np.zeros(int(total[-1]) + len(rows), np.uint32)
        place = total[:-1] + np.repeat(rows, np.diff(bounds))
        out[S.ranges(place, count)] = self.ids[S.ranges(self.first[word], count)]
        return out, total[bounds] + np.arange(len(offsets))


_WORDS: dict[str, WordIds] = {}


def _cut(path: str, size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WORDS.setdefault(path, WordIds(path))
        for batch in batches:
            data, offsets = S.text_column(batch.column(1))
            ids, bounds = words.encode(data, offsets)
            n = np.diff(bounds)
            pieces = (n + size - 1) // size
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * size
            length = np.minimum(n[row] - start, size)
            a = bounds[row] + start
            view = memoryview(ids.astype("<u4")).cast("B")
            crc = np.fromiter((zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(a.tolist(), (a + length).tolist(), strict=True)), np.int64, len(a))
            yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, on counts: rows (length, rank, pieces, per_sequence, sequence, offset).

    A row gives `pieces` pieces of a length, from that rank on, to sequences from
    `sequence` on, `per_sequence` to each, from `offset` on. A group holds like
    sequences: its first, how many, and the tokens used; a length splits one
    group at most, so there are few groups however many pieces there are.
    """
    groups: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by room left: (first, how many)
    rows, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        room = length
        while left:
            while room <= size and not groups[room]:
                room += 1
            if room > size:
                room, per = size, size // length
                groups[room].append((sequences, -(-left // per)))
                sequences += -(-left // per)
            first, many = groups[room].pop()
            per = room // length
            full = min(many, left // per)
            if full:
                rows.append((length, rank, full * per, per, first, size - room))
                groups[room - per * length].append((first, full))
                rank, left = rank + full * per, left - full * per
            rest = many - full
            if rest and left:  # fewer than fill a sequence are left
                rows.append((length, rank, left, left, first + full, size - room))
                groups[room - left * length].append((first + full, 1))
                rank, left, full, rest = rank + left, 0, full + 1, rest - 1
            if rest:
                groups[room].append((first + full, rest))
    return rows


def _place(table):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        keys = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(names.index("rank")).to_numpy()
            at = rows[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            k = rank - at[:, 1]
            keep = [(c, x) for c, x in zip(batch.columns, names, strict=True) if x != "rank"]
            yield pa.record_batch([*(c for c, _ in keep), pa.array(at[:, 4] + k // at[:, 3]), pa.array(at[:, 5] + k % at[:, 3] * length)], names=[*(x for _, x in keep), "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """Pack the documents' tokens into sequences of at most `size`.

    docs has doc_id and text; other columns are not read. Returns a row for each
    piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null
    or empty text is one piece with the closing id 0 alone. Rows that share a
    doc_id are packed each for itself. An empty table gives no rows.
    """
    spark = docs.sparkSession
    S.prepare(spark)
    path = path or public_tokenizers.path("word_bpe_49k.json")
    kind = dict(docs.dtypes)["doc_id"]
    pieces = S.staged(docs.select("doc_id", "text").mapInArrow(_cut(path, size), f"doc_id {kind}, {PIECES}"), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `size` rows at most
    rows = np.array(sorted(plan(counts, size)), np.int64).reshape(-1, 6)
    table = spark.sparkContext.broadcast(rows)
    # rank within a length: a length with many pieces is ranked in parts, by a hash
    parts = F.element_at(F.array(*(F.lit(-(-counts.get(k, 0) // RANKED) or 1) for k in range(1, size + 1))), F.col("length").cast("int"))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), parts))
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("length", "part", F.coalesce("before", F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("own", own).join(before, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("before")).cast("long").alias("rank"))
    return ranked.mapInArrow(_place(table), f"doc_id {kind}, {PIECES}, sequence_id long, offset long")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
