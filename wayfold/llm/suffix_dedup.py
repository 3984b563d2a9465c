"""Suffix-array dedup: remove bytes of repeated substrings, by two-stage suffix sorting.

Sorting: only suffixes smaller than their successor (type S) are sorted
directly; a scan over the buckets of first bytes, in order, induces the place
of all others (type L) from the suffixes behind them. Common prefixes of
neighbours in the order then show which windows repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _repeats as R
from . import _shared as S

GRAM = 8


def words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one big-endian number; a view, so index it."""
    return np.ndarray((max(0, len(data) - 7),), ">u8", buffer=data, strides=(1,))


def byte_units(data: np.ndarray, offsets: np.ndarray):
    grams = S.mix(words8(np.ascontiguousarray(data)).astype(np.uint64))
    at = np.arange(len(data))
    return grams, offsets, at, at + 1


def sort_suffixes(eight: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes at `at` by their first `depth` bytes and more, 8 at a time; only ties are looked at again."""
    at = at[np.argsort(eight[at].astype(np.uint64), kind="stable")]
    key = eight[at].astype(np.uint64)
    head = np.r_[True, key[1:] != key[:-1]] if len(at) else np.zeros(0, bool)
    for k in range(8, depth, 8):
        tied = np.flatnonzero(~head | ~np.r_[head[1:], True])
        if not len(tied):
            break
        group = np.cumsum(head[tied] | np.r_[True, np.diff(tied) > 1])
        key = eight[at[tied] + k].astype(np.uint64)
        order = np.argsort(key)
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
        both = group * (rank.max() + 1) + rank
        order = np.argsort(both)
        at[tied] = at[tied][order]
        head[tied] |= np.r_[True, np.diff(both[order]) != 0]
    return at


def two_stage_order(symbols: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes in order. symbols: int16, each string ended by a 0; ties beyond `depth` symbols may stand in any order.

    wanted: places to order at least (all, by default); besides them, only the suffixes that induce them are ordered.
    """
    n = len(symbols)
    change = np.flatnonzero(symbols[1:] != symbols[:-1])
    small = np.ones(n, bool)  # type S; a run of equal symbols has the type of its last one
    small[: change[-1] + 1 if len(change) else 0] = np.repeat(symbols[change + 1] > symbols[change], np.diff(np.r_[-1, change]))
    padded = np.zeros(n + depth + 16, np.uint8)
    padded[:n] = np.maximum(symbols - 1, 0)
    eight = words8(padded)
    need = np.ones(n, bool) if wanted is None else wanted.copy()
    if wanted is not None:  # a type-L suffix is induced by the next one, and so on up to a type S
        stops = np.where(small, np.arange(n), n)
        stops = np.minimum.accumulate(stops[::-1])[::-1]
        last = np.flatnonzero(wanted & ~np.r_[wanted[1:], False])
        need[S.ranges(last, stops[last] - last + 1)] = True
    direct = sort_suffixes(eight, np.flatnonzero(need & small & (symbols > 0)), depth)
    first = symbols[direct]
    waiting: dict[int, list[np.ndarray]] = {}
    out = []

    def scan(placed: np.ndarray, bucket: int) -> np.ndarray:
        """Put the type-L suffixes before these in their buckets; return those of this bucket."""
        out.append(placed)
        before = placed[placed > 0] - 1
        before = before[~small[before] & need[before]]
        if not len(before):
            return before
        to = symbols[before]
        order = np.argsort(to, kind="stable")
        before, to = before[order], to[order]
        names, at = np.unique(to, return_index=True)
        here = before[:0]
        for name, part in zip(names.tolist(), np.split(before, at[1:]), strict=True):
            if name == bucket:
                here = part
            else:
                waiting.setdefault(name, []).append(part)
        return here

    scan(np.flatnonzero(need & (symbols == 0)), 0)
    for bucket in range(1, 257):
        level = np.concatenate(waiting.pop(bucket)) if bucket in waiting else direct[:0]
        while len(level):
            level = scan(level, bucket)
        lo, hi = np.searchsorted(first, [bucket, bucket + 1])
        if hi > lo:
            scan(direct[lo:hi], bucket)
    return np.concatenate(out)


def common_prefix(eight: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to `most` bytes."""
    out = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    for k in range(0, most, 8):
        differ = eight[a[open_] + k] ^ eight[b[open_] + k]
        same = differ == 0
        out[open_[same]] = k + 8
        other = differ[~same].astype(np.uint64)
        lead = np.zeros(len(other), np.int64)
        for bits in range(8, 64, 8):
            lead += other < np.uint64(1) << np.uint64(64 - bits)
        out[open_[~same]] = k + lead
        open_ = open_[same]
    return np.minimum(out, most)


class ByteWindows:
    """Compares stretches of bytes: which can repeat at all, and which of their windows do."""

    def __init__(self, length: int):
        self.length = length

    def candidates(self, text, left, size, windows, place):
        """A window holds its gram and half the rest on one side: two stretches that share a window share that side."""
        half = (self.length - GRAM) // 2
        eight = words8(np.r_[text, np.zeros(64, np.uint8)])
        free = place >= R.LOOSE
        at = left + np.where(free, place - R.LOOSE, place)
        seed = eight[at].astype(np.uint64)
        alive = np.isin(seed, seed[free])  # a loose stretch has no side of its own: keep all that share its gram
        steps = [*range(GRAM, half + GRAM - 8, 8), half + GRAM - 8]
        for has, offsets in (((place >= half) & ~free, [-half, *(k - half - GRAM + 8 for k in steps), 0]), ((place + GRAM + half <= size) & ~free, [0, *steps])):
            x = np.flatnonzero(has)
            if not len(x):
                continue
            key = np.zeros(len(x), np.uint64)
            for k in offsets:
                key = S.mix(key * np.uint64(S._BASE) + eight[at[x] + k].astype(np.uint64))
            order = np.argsort(key, kind="stable")
            twin = key[order][1:] == key[order][:-1]
            twin = np.r_[twin, False] | np.r_[False, twin]
            alive[x[order[twin]]] = True
        keep = np.flatnonzero(alive)
        if not len(keep):
            return keep, keep.astype(np.uint64), keep.astype(np.uint64)
        size, left = size[keep], left[keep]
        data = text[S.ranges(left, size)]
        at = np.cumsum(size) - size
        step = np.arange(len(data)) - np.repeat(at, size)
        hashes = [S.mix(np.add.reduceat(S._BYTE[data] * S.powers(base, int(size.max()))[step], at) + size.astype(np.uint64)) for base in (S._BASE, 0xC2B2AE3D27D4EB4F)]
        return keep, *hashes

    def repeated(self, text, left, size, windows, place, doc):
        ends = np.cumsum(size + 1)
        at = ends - size - 1
        symbols = np.zeros(int(ends[-1]), np.int16)
        symbols[S.ranges(at, size)] = text[S.ranges(left, size)].astype(np.int16) + 1
        real = np.zeros(len(symbols), np.int64)
        places = S.ranges(at, windows)
        real[places] = np.repeat(doc, windows) + 1 - doc.min()
        order = two_stage_order(symbols, self.length, real > 0)
        order = order[real[order] > 0]  # starts of windows
        padded = np.zeros(len(symbols) + 64, np.uint8)
        padded[: len(symbols)] = np.maximum(symbols - 1, 0)
        lcp = common_prefix(words8(padded), order[:-1], order[1:], self.length)
        head = np.r_[True, lcp < self.length]
        least = np.minimum.reduceat(real[order], np.flatnonzero(head))[np.cumsum(head) - 1]
        flags = np.zeros(len(symbols), bool)
        flags[order] = least < real[order]
        return flags[places]


def cut_bytes(data, begin, end, bounds, mask) -> dict[str, pa.Array]:
    taken = np.r_[0, np.cumsum(mask)]
    first = mask & ~np.r_[False, mask[:-1]]
    cuts = bounds[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = mask[cuts]  # a run ends with its row
    runs = np.r_[0, np.cumsum(first)]
    at = bounds - taken[bounds]
    kept = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data[~mask].tobytes())])
    return {"kept": kept.cast(pa.binary()), "n_bytes": pa.array(np.diff(bounds)), "n_removed": pa.array(np.diff(taken[bounds])), "n_spans": pa.array(np.diff(runs[bounds]))}


def dedup_bytes(docs: DataFrame, length: int = 50, carry: list[str] | None = None) -> DataFrame:
    """Remove each byte that a `length`-byte string covers which also starts in a document with a smaller doc_id.

    docs has doc_id and text; `carry` names further columns to return. Returns
    doc_id, the carried columns, kept (binary: the remaining bytes), n_bytes,
    n_removed and n_spans. A null text is empty; a row with a null doc_id is
    returned whole and removes nothing; rows that share a doc_id do not remove
    each other's bytes. An empty table gives an empty table.
    """
    made = "kept binary, n_bytes long, n_removed long, n_spans long"
    return R.without_repeats(docs, byte_units, ByteWindows(length), cut_bytes, made, length, GRAM, carry or [])


def _cut_text(data, begin, end, bounds, mask) -> dict[str, pa.Array]:
    kept = cut_bytes(data, begin, end, bounds, mask)["kept"]
    return {"text": pa.array([x.as_buffer().to_pybytes().decode("utf-8", "ignore") for x in kept], pa.string())}


def dedup_texts(docs: DataFrame, length: int = 50, carry: list[str] | None = None) -> DataFrame:
    """dedup_bytes() with the remaining text in place of bytes: what is left of a character that was cut is dropped.

    Returns doc_id, the carried columns and text; a null text becomes empty.
    """
    return R.without_repeats(docs, byte_units, ByteWindows(length), _cut_text, "text string", length, GRAM, carry or [])


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
