"""Finding repeated windows across documents, exactly, with bounded tasks.

A window is `length` consecutive units (bytes or words) of one document. Each
window is dealt by its least gram, so that equal windows meet in one bucket and
a run of neighbouring windows with the same least gram travels as one stretch
of text. What keeps a bucket bounded when one passage stands in a third of all
documents: a pass over all documents counts grams by hash cell, and those of
heavy cells come last in the order; a window that holds nothing but such grams
is dealt by its least and its greatest gram together. Both depend on a window's
own text only, so they route and cannot change a result. Equal stretches of one
load travel once, and a bucket collapses equal stretches before it compares
anything. The number of buckets follows from the bytes of text. What a bucket
finds leaves it as one row for each run, so rows grow with what is removed and
not with the number of buckets.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S

#: Hash cells in which grams are counted, and the parts in which the counts travel.
CELLS = 1 << 18
CELL_PARTS = 16
#: Bytes of stretches in a bucket, about, and bytes of stretches for a byte of text.
BUCKET = 8 << 20
SPREAD = 3.2
#: Added to the place of a gram that stands in a stretch more than once, so that not all windows hold it there.
LOOSE = 128
#: Bytes of text that one task compares and sends at a time.
LOAD = 1 << 24
SENT = "bucket int, payload binary"
RUNS = "bucket int, doc_id long, text_key long, start int, span int"
#: The column that tells apart the texts of a doc_id while they travel.
KEY = "_text_key_"

Stretch = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: From a chunk's bytes and row offsets: the symbols' grams, unit offsets of rows, byte starts and ends of the units.
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _count_cells(units: Units) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, size = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            data, offsets = S.text_column(batch.column(0))
            size += len(data)
            for a, b in S.chunks(offsets):
                grams = units(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[0]
                counts += np.bincount((grams >> np.uint64(46)).astype(np.int64), minlength=CELLS)
        parts = [pack(x) for x in np.split(counts, CELL_PARTS)]
        yield pa.record_batch([pa.array(range(CELL_PARTS), pa.int32()), pa.array([size] + [0] * (CELL_PARTS - 1), pa.int64()), pa.array(parts, pa.binary())], names=["part", "size", "counts"])

    return count


def _sum_cells(table: pa.Table) -> pa.Table:
    total = sum(unpack(x.as_py())[0] for x in table.column("counts"))
    size = sum(table.column("size").to_pylist())
    return pa.table([table.column("part").slice(0, 1), pa.array([size], pa.int64()), pa.array([pack(total)], pa.binary())], names=["part", "size", "counts"])


def heavy_cells(docs: DataFrame, units: Units) -> tuple[np.ndarray, int]:
    """Which of CELLS hash cells hold far more grams of all documents than others, and the bytes of text in all."""
    form = "part int, size long, counts binary"
    counted = docs.select("text").mapInArrow(_count_cells(units), form).groupBy("part").applyInArrow(_sum_cells, form)
    counts, size = np.zeros((CELL_PARTS, CELLS // CELL_PARTS), np.int64), 0
    for row in counted.toLocalIterator():  # of a fixed size
        counts[row["part"]] = unpack(row["counts"])[0]
        size += row["size"]
    counts = counts.ravel()
    return counts > max(16, 5 * counts.mean()), size


def stretches(grams: np.ndarray, bounds: np.ndarray, common: np.ndarray, length: int, gram: int):
    """Runs of windows with the same least gram (and greatest, if all are common): row, first unit, windows, place of the least, key."""
    width = length - gram + 1
    order = (grams >> np.uint64(1)) | (common[(grams >> np.uint64(46)).astype(np.int64)].astype(np.uint64) << np.uint64(63))
    least = S.sliding(order, width)
    n = len(least)
    if not n:
        return None
    bad = np.zeros(n + 1, np.int32)
    np.add.at(bad, np.clip(bounds[1:] - length + 1, 0, n), 1)
    np.add.at(bad, np.clip(bounds[1:], 0, n), -1)
    valid = np.cumsum(bad[:n]) == 0
    only = least >> np.uint64(63) != 0  # windows of common grams alone
    change = least[1:] != least[:-1]
    if only.any():
        most = S.sliding(order, width, np.maximum)
        change |= only[1:] & (most[1:] != most[:-1])
    first, last = valid.copy(), valid.copy()
    first[1:] &= change | ~valid[:-1]
    last[:-1] &= change | ~valid[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    if not len(start):
        return None
    windows = end - start + 1
    place = np.full(len(start), width - 1, np.int64)
    other = np.flatnonzero(order[start + width - 1] != least[start])
    for k in range(0, len(other), 1 << 14):
        some = other[k : k + (1 << 14)]
        place[some] = (order[start[some][:, None] + np.arange(width)] == least[start[some]][:, None]).argmax(1)
    # where a window holds its gram twice, copies after other contexts may have the other one as their place
    around = S.sliding(np.pad(least, width - 1), width, np.maximum)
    at = np.flatnonzero(order == around)  # places that are the least of some window; equal ones within a window are neighbours here
    again = np.flatnonzero((order[at[1:]] == order[at[:-1]]) & (np.diff(at) < width))
    twice = np.searchsorted(at[again + 1], start + windows + width - 2, side="right") > np.searchsorted(at[again], start)
    loose = twice | (windows > place + 1)
    if loose.any():  # text that repeats within itself: cut, and mark that windows may hold the gram elsewhere
        pieces = np.where(loose, (windows + width - 1) // width, 1)
        at = np.repeat(np.arange(len(start)), pieces)
        k = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        loose, place = loose[at], place[at]
        windows, start = np.where(loose, np.minimum(windows[at] - k * width, width), windows[at]), start[at] + k * width
        x = np.flatnonzero(loose)
        place[x] = LOOSE + (order[start[x][:, None] + np.arange(width)] == least[start[x]][:, None]).argmax(1)
    row = np.searchsorted(bounds, start, side="right") - 1
    key = least[start]
    both = np.flatnonzero(only[start])
    if len(both):
        key[both] ^= S.mix(most[start[both]])
    return row, start, windows, place, key


def pack(*arrays: np.ndarray) -> bytes:
    """Flat arrays as bytes: their number, kinds and lengths, then what they hold."""
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<cI", a.dtype.char.encode(), len(a)) for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(a.tobytes() for a in arrays))


def unpack(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    at, out = 1 + 5 * data[0], []
    for k in range(data[0]):
        kind, n = struct.unpack_from("<cI", data, 1 + 5 * k)
        out.append(np.frombuffer(data, kind.decode(), n, at))
        at += out[-1].nbytes
    return out


def run_rows(ids: np.ndarray, keys: np.ndarray, start: np.ndarray, span: np.ndarray, n_buckets: int) -> pa.Table:
    """A row for each run of removed units, with the bucket that its document is dealt to."""
    bucket = (S.mix(ids.astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int32)
    return pa.table([pa.array(x) for x in (bucket, ids, keys, start.astype(np.int32), span.astype(np.int32))], names=["bucket", "doc_id", "text_key", "start", "span"])


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a+size] equals data[b:b+size], for each pair."""
    differ = data[S.ranges(a, size)] != data[S.ranges(b, size)]
    return np.add.reduceat(differ, np.cumsum(size) - size) == 0 if len(size) else np.zeros(0, bool)


def merged(ids: np.ndarray, start: np.ndarray, length: np.ndarray):
    """Union of ranges that touch or overlap, within each id."""
    if not len(ids):
        return ids, start, length
    order = np.lexsort((start, ids))
    ids, start, end = ids[order], start[order], (start + length)[order]
    base = np.r_[0, np.cumsum(ids[1:] != ids[:-1])].astype(np.int64) << 40
    reach = np.maximum.accumulate(end + base)
    new = np.r_[True, start[1:] + base[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    last = np.r_[at[1:] - 1, len(ids) - 1]
    return ids[at], start[at], reach[last] - base[last] - start[at]


def loads(batches: Iterator[pa.RecordBatch], limit: int = LOAD) -> Iterator[pa.RecordBatch]:
    """The batches joined to about `limit` bytes each."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def steps(x: np.ndarray) -> np.ndarray:
    """Differences from one value to the next, which compress well; np.cumsum undoes it."""
    return np.diff(x, prepend=x.dtype.type(0))


def dealt(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket, the buckets that occur, and where each begins (and the last ends)."""
    bucket = (S.mix(keys.astype(np.uint64)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    names, at = np.unique(bucket[order], return_index=True)
    return order, names, np.r_[at, len(order)]


def _send(units: Units, common, length: int, gram: int, n_buckets: int) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = common.value
        for batch in loads(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = S.text_column(batch.column(2))
            got = []
            for a, b in S.chunks(offsets):
                low = offsets[a]
                part = data[low : offsets[b]]
                grams, bounds, begin, end = units(part, offsets[a : b + 1] - low)
                if (found := stretches(grams, bounds, table, length, gram)) is None:
                    continue
                row, start, windows, place, order = found
                left, right = begin[start], end[start + windows + length - 2]
                got.append((row + a, start - bounds[row], windows.astype(np.uint8), place.astype(np.uint8), order, left + low, (right - left).astype(np.int32), S.span_hashes(part, left, right)))
            if not got:
                continue
            row, start, windows, place, order, left, size, content = map(np.concatenate, zip(*got, strict=True))
            del got
            by = np.lexsort((ids[row], content))  # equal stretches: the one of the least document travels
            head = np.r_[True, content[by][1:] != content[by][:-1]]
            lead = by[np.flatnonzero(head)[np.cumsum(head) - 1]]
            again = np.flatnonzero((ids[row[by]] > ids[row[lead]]) & (size[by] == size[lead]) & (windows[by] == windows[lead]))
            again = again[same_bytes(data, left[by[again]], left[lead[again]], size[by[again]].astype(np.int64))]
            known = by[again]
            sent = np.ones(len(row), bool)
            sent[known] = False
            known = merged(row[known], start[known], windows[known].astype(np.int64) + length - 1)
            sent = np.flatnonzero(sent)
            by, names, at = dealt(order[sent], n_buckets)
            sent = sent[by]
            k_by, k_names, k_at = dealt(ids[known[0]], n_buckets)
            k_row, k_start, k_length = (x[k_by] for x in known)
            nothing = np.zeros(0, np.int64)
            for part in range(0, len(names), 32):
                out = []
                for k in range(part, min(part + 32, len(names))):
                    x = sent[at[k] : at[k + 1]]
                    text = data[S.ranges(left[x], size[x].astype(np.int64))]
                    out.append(pack(steps(ids[row[x]]), keys[row[x]], steps(start[x].astype(np.int32)), windows[x], place[x], size[x] - windows[x] - (length - 1), text, nothing, nothing, nothing, nothing))
                yield pa.record_batch([pa.array(names[part : part + 32], pa.int32()), pa.array(out, pa.binary())], names=["bucket", "payload"])
            out = []
            for k in range(len(k_names)):
                y = slice(k_at[k], k_at[k + 1])
                out.append(pack(nothing, nothing, nothing.astype(np.int32), nothing.astype(np.uint8), nothing.astype(np.uint8), nothing.astype(np.int32), nothing.astype(np.uint8), ids[k_row[y]], keys[k_row[y]], k_start[y], k_length[y]))
            yield pa.record_batch([pa.array(k_names, pa.int32()), pa.array(out, pa.binary())], names=["bucket", "payload"])

    return send


def _resolve(compare, length: int, n_buckets: int) -> Callable:
    def resolve(table: pa.Table) -> pa.Table:
        parts = []
        for x in table.column("payload"):
            ids, keys, start, windows, place, more, text, *known = unpack(x.as_py())
            parts.append((np.cumsum(ids), keys, np.cumsum(start), windows.astype(np.int64), place.astype(np.int64), more.astype(np.int64) + windows + (length - 1), text, *known))
        ids, keys, start, windows, place, size, text, *known = map(np.concatenate, zip(*parts, strict=True))
        del parts
        out = [tuple(known)]
        left = np.cumsum(size) - size
        keep, content, check = compare.candidates(text, left, size, windows, place) if len(ids) else (np.zeros(0, np.int64),) * 3
        if len(keep):  # stretches that may repeat
            windows, ids, keys, start = windows[keep], ids[keep], keys[keep], start[keep]
            by = np.lexsort((keys, ids, check, content))
            head = np.r_[True, (content[by][1:] != content[by][:-1]) | (check[by][1:] != check[by][:-1])]
            lead = by[head]  # of each class of equal stretches, one of the least document
            of = np.empty(len(by), np.int64)
            of[by] = np.cumsum(head) - 1
            least = ids[lead][of]
            whole = np.flatnonzero(ids > least)
            out.append((ids[whole], keys[whole], start[whole], windows[whole] + length - 1))
            x = keep[lead]
            flags = compare.repeated(text, left[x], size[x], windows[lead], place[x], ids[lead])
            if flags.any():
                first = np.cumsum(windows[lead]) - windows[lead]
                cls = np.repeat(np.arange(len(lead)), windows[lead])
                begins = flags & np.r_[True, ~flags[:-1] | (cls[1:] != cls[:-1])]
                ends = flags & np.r_[~flags[1:] | (cls[1:] != cls[:-1]), True]
                b, e = np.flatnonzero(begins), np.flatnonzero(ends)
                cls = cls[b]
                some = np.flatnonzero(ids == least)
                some = some[np.argsort(of[some], kind="stable")]
                lo, hi = np.searchsorted(of[some], cls), np.searchsorted(of[some], cls, side="right")
                members = some[S.ranges(lo, hi - lo)]
                run = np.repeat(np.arange(len(b)), hi - lo)
                out.append((ids[members], keys[members], start[members] + b[run] - first[cls[run]], (e - b + length)[run]))
        return run_rows(*map(np.concatenate, zip(*out, strict=True)), n_buckets)

    return resolve


def keyed(docs: DataFrame) -> DataFrame:
    """docs with KEY: 0 where ids are unique, else it tells apart the texts of an id."""
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1)
    key = S.text_key(docs).bitwiseAND(0x7FFFFFFF) if twice.head() else F.lit(0).cast("long")
    return docs.withColumn(KEY, key)


def _rows(n_buckets: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in loads(batches):
            ids = batch.column(0).cast(pa.int64()).fill_null(0).to_numpy()
            by, names, at = dealt(ids, n_buckets)
            batch = batch.take(pa.array(by))
            for part in range(0, len(names), 32):
                out = []
                for k in range(part, min(part + 32, len(names))):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema) as writer:
                        writer.write_batch(pa.Table.from_batches([batch.slice(at[k], at[k + 1] - at[k])]).combine_chunks().to_batches()[0])
                    out.append(zstandard.ZstdCompressor(level=3).compress(sink.getvalue()))
                yield pa.record_batch([pa.array(names[part : part + 32], pa.int32()), pa.array(out, pa.binary())], names=["bucket", "payload"])

    return rows


def _join(units: Units, cut: Callable) -> Callable:
    """cut(data, begin, end, bounds, mask) -> columns by name; mask: the units to remove."""

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = [pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(x.as_py())).read_all() for x in left.column("payload")]
        rows = pa.concat_tables(tables).combine_chunks()
        ids, keys, start, span = (right.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "text_key", "start", "span"))
        data, offsets = S.text_column(rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string()))
        _, bounds, begin, end = units(data, offsets)
        step = np.zeros(len(begin) + 1, np.int32)
        if len(ids) and rows.num_rows:
            valid = rows.column("doc_id").is_valid().to_numpy()
            own = rows.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy()
            own_keys = rows.column(KEY).to_numpy()
            pair = lambda a, b: np.rec.fromarrays([a, b])
            order = np.lexsort((keys, ids))
            table = pair(ids[order], keys[order])
            need = np.flatnonzero(valid)
            lo = np.searchsorted(table, pair(own[need], own_keys[need]))
            hi = np.searchsorted(table, pair(own[need], own_keys[need]), side="right")
            x = order[S.ranges(lo, hi - lo)]
            base = np.repeat(bounds[need], hi - lo)
            np.add.at(step, base + start[x], 1)
            np.add.at(step, base + start[x] + span[x], -1)
        made = cut(data, begin, end, bounds, np.cumsum(step[:-1]) > 0)
        rows = rows.drop_columns(["text", KEY])
        return pa.table([*rows.columns, *made.values()], names=[*rows.column_names, *made])

    return join


def without_repeats(docs: DataFrame, units: Units, compare, cut: Callable, made: str, length: int, gram: int, carry: list[str]) -> DataFrame:
    """docs' rows with what cut() makes of the units that no repeated window covers.

    A window is repeated if it also starts in a document with a smaller doc_id.
    A carried column that has the name of a made one gives way to it.
    """
    spark = docs.sparkSession
    S.prepare(spark)
    names = {"doc_id", "text", KEY, *(c.split()[0] for c in made.split(", "))}
    carry = [c for c in carry if c not in names]
    docs = keyed(docs.select("doc_id", "text", *carry))
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), KEY, "text")
    heavy, size = heavy_cells(rows, units)
    n = max(S.buckets(spark, 1), int(SPREAD * size / BUCKET))
    common = spark.sparkContext.broadcast(heavy)
    sent = rows.mapInArrow(_send(units, common, length, gram, n), SENT)
    found = sent.groupBy("bucket").applyInArrow(_resolve(compare, length, n), RUNS)
    dealt_rows = docs.mapInArrow(_rows(n), SENT)
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in ("doc_id", *carry)), made])
    return dealt_rows.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(_join(units, cut), schema)
