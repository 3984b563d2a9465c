"""Substring dedup: seed and extend on word sequences.

Seeds are the winnowed grams of GRAM words that two stretches share. From each
seed, matches are extended both ways, set-at-a-time: the words left and right of
the seed name a class for each extent, and stretches in the same left and right
class share that window. Runs of such windows are the maximal repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _repeats as R
from . import _shared as S

GRAM = 8


def word_units(data: np.ndarray, offsets: np.ndarray):
    starts, ends, bounds = S.word_bounds(data, offsets)
    return S.gram_hashes(S.span_hashes(data, starts, ends), GRAM), bounds, starts, ends


class WordWindows:
    def __init__(self, length: int):
        self.length = length

    def _words(self, text, left, size):
        """Hashes of the words of the stretches, one stretch after another, and where each begins."""
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        offsets = np.r_[0, np.cumsum(size)]
        for a, b in S.chunks(offsets):
            data = text[S.ranges(left[a:b], size[a:b])]
            starts, ends, bounds = S.word_bounds(data, offsets[a : b + 1] - offsets[a])
            hashes.append(S.span_hashes(data, starts, ends))
            counts.append(np.diff(bounds))
        return np.concatenate(hashes), np.cumsum(np.concatenate(counts))

    def candidates(self, text, left, size, windows, place):
        words, bounds = self._words(text, left, size)
        first, n = bounds[:-1], np.diff(bounds)
        free = place >= R.LOOSE
        seed = np.zeros(len(left), np.uint64)
        at = first + np.where(free, place - R.LOOSE, place)
        for k in range(GRAM):
            seed = seed * np.uint64(S._BASE) + words[at + k]
        order = np.argsort(seed, kind="stable")
        twin = seed[order][1:] == seed[order][:-1]
        twin = np.r_[twin, False] | np.r_[False, twin]
        keep = np.sort(order[twin])
        sums = [self._prefix(words, base) for base in (S._BASE, 0xC2B2AE3D27D4EB4F)]
        return keep, *(self._span(s, base, first[keep], first[keep] + n[keep]) for s, base in zip(sums, (S._BASE, 0xC2B2AE3D27D4EB4F), strict=True))

    @staticmethod
    def _prefix(words, base):
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * S.powers(base, len(words)), out=sums[1:])
        return sums

    @staticmethod
    def _span(sums, base, a, b):
        inverse = S.powers(pow(base, -1, 2**64), len(sums))
        return S.mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))

    def repeated(self, text, left, size, windows, place, doc):
        words, bounds = self._words(text, left, size)
        sums = self._prefix(words, S._BASE)
        at = S.ranges(bounds[:-1], windows)
        # the seed lies within every window of its stretch, except in text that repeats within itself
        free = np.repeat(place >= R.LOOSE, windows)
        seed = np.where(free, at, np.repeat(bounds[:-1] + place, windows))
        to_left = self._span(sums, S._BASE, at, seed)
        to_right = self._span(sums, S._BASE, seed, at + self.length)
        if free.any():  # such windows are compared whole, with those of ordinary stretches as well
            other = self._prefix(words, 0xC2B2AE3D27D4EB4F)
            to_left = self._span(other, 0xC2B2AE3D27D4EB4F, at, at + self.length)
            to_right = self._span(sums, S._BASE, at, at + self.length)
        order = np.lexsort((to_left, to_right))
        head = np.r_[True, (to_right[order][1:] != to_right[order][:-1]) | (to_left[order][1:] != to_left[order][:-1])]
        owner = np.repeat(doc, windows)
        least = np.minimum.reduceat(owner[order], np.flatnonzero(head))[np.cumsum(head) - 1]
        flags = np.zeros(len(at), bool)
        flags[order] = least < owner[order]
        return flags


def cut_words(data, begin, end, bounds, mask) -> dict[str, pa.Array]:
    taken = np.r_[0, np.cumsum(mask)]
    a, b = begin[~mask], end[~mask]
    size = b - a + 1  # with a space after each word but a row's last
    kept = np.full(int(size.sum()), 32, np.uint8)
    after = np.cumsum(size)
    kept[S.ranges(after - size, size - 1)] = data[S.ranges(a, size - 1)]
    at = np.r_[0, after][bounds - taken[bounds]]
    rows = [kept[x : max(x, y - 1)].tobytes().decode() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return {"kept": pa.array(rows, pa.string()), "n_words": pa.array(np.diff(bounds)), "n_removed": pa.array(np.diff(taken[bounds]))}


def dedup_words(docs: DataFrame, length: int = 50, carry: list[str] | None = None) -> DataFrame:
    """Remove each word that a window of `length` words covers whose sequence also starts in a document with a smaller doc_id.

    docs has doc_id and text; `carry` names further columns to return. Returns
    doc_id, the carried columns, kept (the remaining words, joined by one
    space), n_words and n_removed. A null or empty text has no words; a row with
    a null doc_id is returned whole and removes nothing; rows that share a
    doc_id do not remove each other's words. An empty table gives an empty table.
    """
    made = "kept string, n_words long, n_removed long"
    return R.without_repeats(docs, word_units, WordWindows(length), cut_words, made, length, GRAM, carry or [])


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
