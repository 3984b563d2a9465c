"""Language-model scores by online logistic context mixing.

Every token is coded by binary decisions. The first name the class of its count
among training tokens (a Huffman code over classes; the end and unknown words
have classes of their own). The next name the word within its class: those bits
of its hash that tell it from other training words of the class. An unknown
word is spelled, eight bits for each byte. Each bit is predicted by several
predictors, each a table of counts by a hashed context (none, the groups of the
last two words, the last word, the last two words; for bytes the last one to
four bytes). Predictions are mixed in the logistic domain by weights that a gate
selects, and an adaptive table refines the result. Weights and table are learned
online, bit by bit ahead of each update, from all training documents, within
lots that a hash of the documents makes up, in the order of doc_id; lots are
averaged by how often each was taught. Nothing depends on how a table is dealt.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S
from ._repeats import pack, unpack
from .near_dedup import _LOWER

GROUPS, CLASSES = 8, 32
END, UNKNOWN = 0, 1
_END_WORD = np.array([0x5EEDF00D], np.uint64)
#: Bytes of text in a lot, and bytes of text for each bucket of words.
LOT, SHARE = 6 << 20, 8 << 20
#: Bits of the hashed tables of each kind of decision, one for each predictor.
TABLES = {"word": (20, 19, 20, 20), "byte": (8, 16, 19, 20, 20)}
#: Sets of weights: for a word one for each node of the class code and each bit of a hash, for a byte one for each node.
SETS = {"word": 64 + 32, "byte": 256}
#: Stretched predictions are whole numbers of 1/_FINE, with _GATE_BITS bits below them for what the gate takes.
_FINE, _GATE_BITS = 128, 3
_SEEN = 1 << _GATE_BITS
_GATES = 2 * _SEEN  # by how often the last predictor has seen its context, and whether the first has seen one bit only
_BINS = 33
_CHUNK, _STEP = 1 << 15, 1 << 14
_AFTER = (GROUPS + 1) ** 2
_SLICE = 1 << 17  # counts of a table that travel in one row
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Learned values travel as whole numbers of this size, so that their sums are the same in any order.
_UNIT = float(1 << 24)


def class_code(weights: dict[int, int]) -> list[list[tuple[int, int]]]:
    """Huffman code over the classes: for each class its decisions, as (node, bit); ties go by class."""
    heap = [(w, c, ("leaf", c)) for c, w in sorted(weights.items())]
    heapq.heapify(heap)
    nodes = 0
    while len(heap) > 1:
        (w0, c0, a), (w1, c1, b) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (w0 + w1, min(c0, c1), ("node", nodes, a, b)))
        nodes += 1
    out: list[list[tuple[int, int]]] = [[] for _ in range(CLASSES)]

    def walk(tree, path):
        if tree[0] == "leaf":
            out[tree[1]] = path
        else:
            walk(tree[2], [*path, (tree[1], 0)])
            walk(tree[3], [*path, (tree[1], 1)])

    walk(heap[0][2], [])
    return out


class Code:
    """class_code() as arrays: the length for each class, and by decision and class its node and bit."""

    def __init__(self, weights: dict[int, int]):
        paths = class_code(weights)
        self.size = np.array([len(p) for p in paths], np.int64)
        longest = max(1, int(self.size.max()))
        self.node, self.bit = (np.array([[p[j][k] if j < len(p) else 0 for p in paths] for j in range(longest)], np.int64) for k in (0, 1))


def identity(names: np.ndarray) -> np.ndarray:
    """The bits that tell a word within its class, first bit on top."""
    return (S.mix(names * _M1) >> np.uint64(32)).astype(np.uint32)


def _before(x: np.ndarray, first: np.ndarray, start) -> np.ndarray:
    """x one place back; `start` at a document's beginning."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first] = start
    return out


def contexts(words: np.ndarray, group: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """A hash of the context of each predictor but the first, for each token; a document's first token has none before it."""
    first = at[:-1][np.diff(at) > 0]
    w1 = _before(words, first, 0)
    w2 = _before(w1, first, 0)
    return [_take(_after_hash(np.arange(_AFTER)), after_groups(group, at)), S.mix(w1 + np.uint64(2)), S.mix(w1 * _M1 + w2 + np.uint64(3))]


def after_groups(group: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The groups of the two words before each token, as one number under _AFTER."""
    first = at[:-1][np.diff(at) > 0]
    g1 = _before(group, first, GROUPS)
    return g1 * np.uint8(GROUPS + 1) + _before(g1, first, GROUPS)


def _after_hash(after: np.ndarray) -> np.ndarray:
    return S.mix(after.astype(np.uint64) + np.uint64(1))


def _slots(bits: tuple[int, ...], node: np.ndarray, hashes: list) -> list[np.ndarray]:
    """A place in the table of each predictor, of so many bits; hashes are those of their contexts, None for none."""
    key = (node + np.uint64(1)) * _M1
    out = []
    for b, h in zip(bits, hashes, strict=True):
        x = key.copy() if h is None else h ^ key
        x *= _M2
        x >>= np.uint64(64 - b)
        out.append(x.view(np.int64))
    return out


def _at(hashes: list, at: np.ndarray) -> list:
    return [None if h is None else _take(h, at) for h in hashes]


def word_bits(code: Code, cls: np.ndarray, own: np.ndarray, ident: np.ndarray, mask: np.ndarray, hashes: list, a: int, b: int, bits: tuple[int, ...] = TABLES["word"]) -> Iterator[tuple]:
    """Decisions of tokens a to b: bit, slots, set of weights and token (or a slice of all), a set for each step.

    The class is cls; the word is told within its class own, if mask has bits.
    hashes and bits are those of the predictors wanted. What all tokens are
    asked is not gathered.
    """
    c = cls[a:b].astype(np.int64)
    size = _take(code.size, c)
    near = [None if h is None else h[a:b] for h in hashes]
    least = int(size.min(initial=64))
    for j in range(int(size.max(initial=0))):
        at, of, some = slice(a, b), c, near
        if j >= least:
            at = np.flatnonzero(size > j)
            of, some = _take(c, at), _at(near, at)
            at += a
        node = _take(code.node[j], of)
        yield _take(code.bit[j], of), _slots(bits, node.astype(np.uint64), some), node, at
    m, x = mask[a:b], ident[a:b].astype(np.uint64)
    top = (own[a:b].astype(np.uint64) + np.uint64(1)) << np.uint64(40)
    asked: slice | np.ndarray = slice(a, b)
    if not m.all():
        pick = np.flatnonzero(m)
        m, x, top, near = _take(m, pick), _take(x, pick), _take(top, pick), _at(near, pick)
        asked = pick + a
    every, any_ = int(np.bitwise_and.reduce(m)), int(np.bitwise_or.reduce(m))
    for j in range(32):
        if not len(m) or not any_ >> j & 1:
            continue
        at, y, high, some = asked, x, top, near
        if not every >> j & 1:
            pick = np.flatnonzero(m & np.uint32(1 << j))
            y, high, some = _take(x, pick), _take(top, pick), _at(near, pick)
            at = pick + a if isinstance(asked, slice) else _take(asked, pick)
        node = y >> np.uint64(32 - j)
        node |= high
        node |= np.uint64(j << 33)
        yield ((y >> np.uint64(31 - j)) & np.uint64(1)).view(np.int64), _slots(bits, node, some), np.full(len(y), 64 + j), at


def byte_contexts(data: np.ndarray) -> list[np.ndarray]:
    """The same for words that are each closed by a space."""
    x = data.astype(np.uint64)
    first = np.flatnonzero(np.r_[True, data[:-1] == 32]) if len(data) else np.zeros(0, np.int64)
    c = [x]
    for _ in range(4):
        c.append(_before(c[-1], first, 32))
    out, key = [], np.zeros(len(x), np.uint64)
    for k in range(1, 5):
        key = key * np.uint64(256) + c[k]
        out.append(S.mix(key + np.uint64(k << 40)))
    return out


def byte_bits(data: np.ndarray, hashes: list[np.ndarray], a: int, b: int) -> Iterator[tuple]:
    x = data[a:b].astype(np.int64)
    near = [h[a:b] for h in hashes]
    at, node = slice(a, b), np.ones(b - a, np.int64)
    for j in range(7, -1, -1):
        bit = (x >> j) & 1
        yield bit, _slots(TABLES["byte"], node.astype(np.uint64), [None, *near]), node, at
        node = node * 2 + bit


def decisions(block: Block, teach: bool = False) -> Iterator[tuple]:
    """(kind, decisions) of a block, chunk by chunk; tokens are in the order of Block.by_word.

    teach: for the mixer, of its training documents as they stand, with the
    class that each word would have had it not been counted, and of words that
    are counted twice or more.
    """
    pick = block.taught() if teach else block.by_word
    index, hashes = _take(block.index, pick), _at(contexts(block.words, block.group, block.at), pick)
    cls, mask = (block.name_less, np.where(block.name_count > 1, block.name_mask, np.uint32(0))) if teach else (block.name_cls, block.name_mask)
    columns = [_take(x, index) for x in (cls, block.name_cls, block.name_ident, mask)]
    n = len(index)
    for a in range(0, n, _CHUNK):
        yield from (("word", d) for d in word_bits(block.code, *columns, [None, *hashes], a, min(a + _CHUNK, n)))
    yield from _spelling(block.rare if teach else block.unknown)


def tallied(block: Block) -> Iterator[tuple]:
    """(kind, first predictor, bit, slots, times) of what a block's training documents teach the tables.

    As decisions() for the mixer, but of all words, and whatever the first two
    predictors see the same of (a word after the same groups) together.
    """
    pick = block.by_word[_take(np.repeat(block.train, np.diff(block.at)), block.by_word)]
    index, after = _take(block.index, pick), _take(after_groups(block.group, block.at), pick)
    both = index * _AFTER + after
    both = np.sort(both.astype(np.int32) if len(block.names) * _AFTER < 2**31 else both)
    head = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
    times = np.diff(np.r_[head, len(both)]).astype(np.uint32)
    both = both[head].astype(np.int64)
    contexts_ = contexts(block.words, block.group, block.at)[1:]
    for first, index, hashes, times in ((0, both // _AFTER, [None, _after_hash(both % _AFTER)], times), (2, index, _at(contexts_, pick), None)):
        columns = [_take(x, index) for x in (block.name_less, block.name_cls, block.name_ident, block.name_mask)]
        bits = TABLES["word"][first : first + 2]
        for a in range(0, len(index), _CHUNK):
            for bit, slots, _, at in word_bits(block.code, *columns, hashes, a, min(a + _CHUNK, len(index)), bits):
                yield "word", first, bit, slots, None if times is None else times[at]
    for kind, (bit, slots, *_) in _spelling(block.rare):
        yield kind, 0, bit, slots, None


def _spelling(data: np.ndarray) -> Iterator[tuple]:
    hashes = byte_contexts(data)
    for a in range(0, len(data), _CHUNK):
        yield from (("byte", d) for d in byte_bits(data, hashes, a, min(a + _CHUNK, len(data))))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _take(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return table.take(at, mode="clip")


class Mixer:
    """Count tables by kind and predictor, mixing weights by kind, predictor, set and gate, and the refining tables."""

    def __init__(self, counts: dict[str, np.ndarray]):
        """counts: by "kind/predictor", zeros and ones seen, two for each slot."""
        self.weights = {k: np.full((len(TABLES[k]), n * _GATES), 0.3, np.float32) for k, n in SETS.items()}
        edges = _squash(np.linspace(-8, 8, _BINS))
        self.refine = {k: np.tile(edges, n).astype(np.float32) for k, n in SETS.items()}
        self.taught = {f"weights/{k}": np.zeros(n * _GATES, np.int64) for k, n in SETS.items()} | {f"refine/{k}": np.zeros(n * _BINS, np.int64) for k, n in SETS.items()}
        self.counts = counts
        self.ready: dict[str, np.ndarray] = {}

    def freeze(self, without_own: bool = False) -> Mixer:
        """Stretched predictions in place of counts; without_own: for each slot and bit, without the one that the counts hold of it."""
        for name, c in self.counts.items():
            kind, k = name.split("/")
            zeros, ones = (c.reshape(-1, 2)[:, b].astype(np.float32) for b in (0, 1))
            if without_own:
                zeros, ones = np.stack((zeros - (zeros > 0), zeros), 1).ravel(), np.stack((ones, ones - (ones > 0)), 1).ravel()
            n = zeros + ones
            gate = np.zeros(len(n), np.int16)
            if int(k) == len(TABLES[kind]) - 1:
                gate = np.minimum(_SEEN - 1, np.ceil(np.log2(n + 1))).astype(np.int16)
            if int(k) == 0:
                gate = ((n > 0) & (np.minimum(zeros, ones) == 0)).astype(np.int16)
            stretched = np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4)))
            self.ready[name] = (np.rint(stretched * np.float32(_FINE)).astype(np.int16) << _GATE_BITS) | gate
        self.counts = {}
        return self

    def predict(self, kind: str, slots: list[np.ndarray], sets: np.ndarray):
        """Inputs, cell of weights, mixed logit, and place in the refining table."""
        packed = [_take(self.ready[f"{kind}/{k}"], s) for k, s in enumerate(slots)]
        cell = sets * _GATES + ((packed[0] & 1) * np.int16(_SEEN) + (packed[-1] & np.int16(_SEEN - 1)))
        inputs = [(x >> _GATE_BITS).astype(np.float32) * np.float32(1 / _FINE) for x in packed]
        weights = self.weights[kind]
        logit = inputs[0] * _take(weights[0], cell)
        for k in range(1, len(inputs)):
            logit += inputs[k] * _take(weights[k], cell)
        np.clip(logit, -7.99, 7.99, out=logit)
        return inputs, cell, logit, (logit + np.float32(8)) * np.float32((_BINS - 1) / 16)

    def learn(self, kind: str, bit: np.ndarray, slots: list[np.ndarray], sets: np.ndarray, rate: float = 0.02) -> None:
        """Online: each step is predicted with what the earlier ones taught, then teaches."""
        for a in range(0, len(bit), _STEP):
            b, s = bit[a : a + _STEP], sets[a : a + _STEP]
            inputs, cell, logit, place = self.predict(kind, [(x[a : a + _STEP] << 1) | b for x in slots], s)
            error = b.astype(np.float32) - _squash(logit)
            w, taught = self.weights[kind], self.taught[f"weights/{kind}"]
            times = np.bincount(cell, minlength=w.shape[1])
            speed = rate / np.sqrt(np.maximum(1, times))
            for k, x in enumerate(inputs):
                x *= error
                w[k] += (speed * np.bincount(cell, x, w.shape[1])).astype(np.float32)
            taught += times
            near = s * _BINS + (place + np.float32(0.5)).astype(np.int64)
            table = self.refine[kind]
            both = np.bincount(near * 2 + b, minlength=2 * len(table)).reshape(-1, 2)
            ones = both[:, 1]
            hits = both[:, 0] + ones
            self.taught[f"refine/{kind}"] += hits
            some = np.flatnonzero(hits)
            table[some] += (hits[some] / (hits[some] + 50.0) * (ones[some] / hits[some] - table[some])).astype(np.float32)

    def chances(self, kind: str, bit: np.ndarray, slots: list[np.ndarray], sets: np.ndarray) -> np.ndarray:
        """The chance of each bit."""
        _, _, logit, place = self.predict(kind, slots, sets)
        low = place.astype(np.int64)
        part = place - low
        at = sets * _BINS + low
        table = self.refine[kind]
        under = _take(table, at)
        p = np.float32(0.5) * (_squash(logit) + under + part * (_take(table, at + 1) - under))
        return np.maximum(np.abs(p - (1 - bit).astype(np.float32)), np.float32(1e-6))

    def learned(self) -> dict[str, np.ndarray]:
        """Weights and refining tables times how often each was taught, in whole numbers, and those times."""
        out = {}
        for kind in TABLES:
            n = self.taught[f"weights/{kind}"]
            out |= {f"weights/{kind}/{k}": np.rint(w.astype(np.float64) * n * _UNIT).astype(np.int64) for k, w in enumerate(self.weights[kind])}
            out[f"refine/{kind}"] = np.rint(self.refine[kind].astype(np.float64) * self.taught[f"refine/{kind}"] * _UNIT).astype(np.int64)
        return out | {f"taught/{k}": n for k, n in self.taught.items()}

    def average(self, sums: dict[str, np.ndarray]) -> None:
        """The mean of what lots have learned; what none was taught keeps its start."""
        for kind in TABLES:
            n = sums[f"taught/weights/{kind}"]
            for k, w in enumerate(self.weights[kind]):
                w[n > 0] = sums[f"weights/{kind}/{k}"][n > 0] / _UNIT / n[n > 0]
            n = sums[f"taught/refine/{kind}"]
            self.refine[kind][n > 0] = sums[f"refine/{kind}"][n > 0] / _UNIT / n[n > 0]


def _block(table: pa.Table) -> pa.Table:
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids, train, kind = (table.column(c).combine_chunks() for c in ("doc_id", "train", "kind"))
    text = table.column("text").combine_chunks()
    data, offsets = S.text_column(text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks))
    row = pack(ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), train.to_numpy(zero_copy_only=False), kind.to_numpy(), offsets, _LOWER[data])
    return pa.table([pa.array([table.column("lot")[0].as_py()], pa.int64()), pa.array([row], pa.binary())], names=["block", "payload"])


def _distinct(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in the order of identity(), and the place of each token among them."""
    low = np.uint64(len(tokens).bit_length())
    key = S.mix(tokens * _M1) >> low << low
    key |= np.arange(len(tokens), dtype=np.uint64)
    key.sort()
    at = (key & ((np.uint64(1) << low) - np.uint64(1))).view(np.int64)
    key >>= low
    found = _take(tokens, at)
    new = np.r_[True, found[1:] != found[:-1]][: len(at)]
    if (new[1:] & (key[1:] == key[:-1])).any():  # words that the upper bits do not tell apart may be mixed up
        names, index = np.unique(tokens, return_inverse=True)
        order = np.argsort(identity(names), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return names[order], place[index]
    index = np.empty(len(at), np.int64)
    index[at] = np.cumsum(new) - 1
    return found[new], index


def _words(data: np.ndarray, offsets: np.ndarray):
    """Distinct hashes of all tokens (the end's too) in the order of identity(), each token's place among them, token offsets, and word bounds."""
    starts, ends, bounds = S.word_bounds(data, offsets)
    parts = [S.span_hashes(data[offsets[a] : offsets[b]], starts[bounds[a] : bounds[b]] - offsets[a], ends[bounds[a] : bounds[b]] - offsets[a]) for a, b in S.chunks(offsets)]
    hashes = np.concatenate([np.zeros(0, np.uint64), *parts])
    n = len(offsets) - 1
    tokens = np.full(len(hashes) + n, _END_WORD[0])
    of = np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(bounds))
    tokens[of] = hashes
    names, index = _distinct(tokens)
    return names, index, bounds + np.arange(n + 1), starts, ends, of


def _ask(bits: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, _, train, group, offsets, data = unpack(payload.as_py())
                names, index, at, *_ = _words(data, offsets)
                size = np.diff(at)
                learn = np.repeat(train, size)
                counts = np.bincount(index[learn] * GROUPS + np.repeat(group, size)[learn], minlength=len(names) * GROUPS).reshape(-1, GROUPS).astype(np.uint32)
                buckets, cut = np.unique(identity(names) >> np.uint32(32 - bits), return_index=True)
                cut = np.r_[cut, len(names)]
                rows = [pack(names[a:b], counts[a:b].ravel()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.record_batch([pa.array(buckets.astype(np.int32)), pa.array([block] * len(rows), pa.int64()), pa.array(rows, pa.binary())], names=["bucket", "block", "payload"])

    return ask


REPLY = "block long, bucket int, payload binary, cells array<struct<cell:int,types:long,total:long>>"


def _classes(count: np.ndarray, names: np.ndarray) -> np.ndarray:
    known = np.minimum(CLASSES - 1, 2 + np.floor(np.log2(np.maximum(count, 1))).astype(np.int64))
    return np.where(names == _END_WORD[0], END, np.where(count > 0, known, UNKNOWN))


def branches(cls: np.ndarray, ident: np.ndarray, count: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bits (bit j for the j-th) that tell a word from others of its class, the first `bits` in any case, and its share among those that none tells apart."""
    order = np.lexsort((ident, cls))
    c, x, n = cls[order].astype(np.int64), ident[order].astype(np.uint64), count[order].astype(np.float64)
    mask = np.full(len(x), (1 << bits) - 1, np.uint32)
    if not len(x):
        return mask, n
    for j in range(bits, 32):
        node = (c.astype(np.uint64) << np.uint64(32)) | (x >> np.uint64(32 - j))
        head = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        if len(head) == len(x):
            break
        bit = (x >> np.uint64(31 - j)) & np.uint64(1)
        both = np.minimum.reduceat(bit, head) != np.maximum.reduceat(bit, head)
        mask[np.repeat(both, np.diff(np.r_[head, len(x)]))] |= np.uint32(1 << j)
    head = np.r_[True, (c[1:] != c[:-1]) | (x[1:] != x[:-1])]
    whole = np.add.reduceat(n, np.flatnonzero(head))[np.cumsum(head) - 1]
    out, share = np.empty_like(mask), np.empty(len(order))
    out[order], share[order] = mask, n / np.maximum(whole, 1)
    return out, share


def _reply(bits: int):
    def reply(table: pa.Table) -> pa.Table:
        blocks, bucket = table.column("block").to_pylist(), table.column("bucket")[0].as_py()
        parts = [unpack(x.as_py()) for x in table.column("payload")]
        size = [len(p[0]) for p in parts]
        names, index = _distinct(np.concatenate([p[0] for p in parts]))
        each = np.concatenate([p[1] for p in parts])
        some = np.flatnonzero(each)
        counts = np.zeros(len(names) * GROUPS, np.int64)
        np.add.at(counts, _take(index, some // GROUPS) * GROUPS + some % GROUPS, each[some].astype(np.int64))
        counts = counts.reshape(-1, GROUPS)
        total = counts.sum(1)
        group = np.where((total > 0) & (names != _END_WORD[0]), counts.argmax(1), 0).astype(np.uint8)
        cls = _classes(total, names)
        mask, share = np.zeros(len(names), np.uint32), np.ones(len(names))
        known = np.flatnonzero(cls > UNKNOWN)
        mask[known], share[known] = branches(cls[known], identity(names[known]), total[known], bits)
        some = total > 0
        types, sums = np.bincount(cls[some], minlength=CLASSES), np.zeros(CLASSES, np.int64)
        np.add.at(sums, cls[some], total[some])
        cells = [{"cell": int(k), "types": int(types[k]), "total": int(sums[k])} for k in np.flatnonzero(types)]
        cuts = np.r_[0, np.cumsum(size)]
        rows = [pack(total[i], group[i], mask[i], share[i].astype(np.float32)) for i in (index[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))]
        return pa.table(
            [pa.array(blocks, pa.int64()), pa.array([bucket] * len(rows), pa.int32()), pa.array(rows, pa.binary()), pa.array([cells] + [None] * (len(rows) - 1), pa.list_(pa.struct([("cell", pa.int32()), ("types", pa.int64()), ("total", pa.int64())])))],
            names=["block", "bucket", "payload", "cells"],
        )

    return reply


class Block:
    """The documents of a lot: tokens with what is known of their words, and the spelling of those that are not known."""

    def __init__(self, payload: bytes, code: Code):
        valid, ids, train, at, index, names, count, group, mask, share, unknown, cut, rare = unpack(payload)
        self.code, self.valid, self.ids, self.train, self.at, self.cut = code, valid, ids, train, at, cut
        self.unknown, self.rare = unknown, rare
        self.index, self.names, self.name_count, self.name_group, self.name_mask, self.name_share = index.astype(np.int64), names, count, group, mask, share
        self.name_ident, self.name_cls = identity(names), _classes(count, names).astype(np.uint8)

    def __getattr__(self, name: str) -> np.ndarray:
        """words, group, mask, share, count, ident, cls, less: of each token, gathered when first asked for."""
        if name.startswith("name_") or name not in ("words", "group", "mask", "share", "count", "ident", "cls", "less"):
            raise AttributeError(name)
        out = _take(self.names if name == "words" else getattr(self, f"name_{name}"), self.index)
        setattr(self, name, out)
        return out

    @cached_property
    def name_less(self) -> np.ndarray:
        """What a training document teaches is how its tokens would be coded had it not been counted."""
        return np.where(self.names == _END_WORD[0], END, _classes(np.maximum(self.name_count - 1, 0), self.names)).astype(np.uint8)

    @cached_property
    def by_word(self) -> np.ndarray:
        """All tokens, those of a class and of a word side by side: they are asked the same, and read the same places of tables."""
        n = np.uint64(len(self.index).bit_length())
        key = (_take(self.name_cls, self.index).astype(np.uint64) << (n + n)) | (self.index.astype(np.uint64) << n) | np.arange(len(self.index), dtype=np.uint64)
        key.sort()
        return (key & ((np.uint64(1) << n) - np.uint64(1))).view(np.int64)

    def taught(self) -> np.ndarray:
        """The tokens of training documents."""
        return np.flatnonzero(np.repeat(self.train, np.diff(self.at)))


def _code(table: pa.Table, right: pa.Table) -> pa.Table:
    replies = [unpack(p.as_py()) for _, p in sorted(zip(right.column("bucket").to_pylist(), right.column("payload"), strict=True), key=lambda x: x[0])]
    valid, ids, train, _, offsets, data = unpack(table.column("payload")[0].as_py())
    names, index, at, starts, ends, of = _words(data, offsets)
    count, group, mask, share = (np.concatenate([r[k] for r in replies]) for k in range(4))
    c = count[index]
    row = np.repeat(np.arange(len(ids)), np.diff(at) - 1)

    def spelled(pick):
        size = ends[pick] - starts[pick] + 1
        text = np.full(int(size.sum()), 32, np.uint8)
        end = np.cumsum(size)
        text[S.ranges(end - size, size - 1)] = data[S.ranges(starts[pick], size - 1)]
        return text, np.r_[0, end][np.searchsorted(row[pick], np.arange(len(ids) + 1))]

    unknown, cut = spelled(np.flatnonzero(c[of] == 0))
    rare, _ = spelled(np.flatnonzero((c[of] == 1) & train[row]))
    payload = pack(valid, ids, train, at, index.astype(np.uint32), names, count, group, mask, share, unknown, cut.astype(np.int64), rare)
    return pa.table([table.column("block").slice(0, 1), pa.array([payload], pa.binary())], names=["block", "payload"])


def _blocks_of(batches: Iterator[pa.RecordBatch], code: Code) -> Iterator[Block]:
    for batch in batches:
        for payload in batch.column(0):
            yield Block(payload.as_py(), code)


_NAMED = "name string, start int, counts binary"


def _named(arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each slice of each array, so that no task sums whole tables of all tasks."""
    parts = ((name, a, x[a : a + _SLICE]) for name, x in arrays.items() for a in range(0, len(x), _SLICE))
    rows = [(name, a, pack(x.astype(np.min_scalar_type(x.max())) if x.dtype == np.uint32 else x)) for name, a, x in parts]
    names, starts, parts = zip(*rows, strict=True)
    return pa.record_batch([pa.array(names), pa.array(starts, pa.int32()), pa.array(parts, pa.binary())], names=["name", "start", "counts"])


def _tally(code: Code):
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {f"{kind}/{k}": np.zeros(2 << b, np.uint32) for kind, bits in TABLES.items() for k, b in enumerate(bits)}
        for block in _blocks_of(batches, code):
            for kind, first, bit, slots, times in tallied(block):
                for k, x in enumerate(slots, first):
                    x <<= 1
                    x |= bit
                    np.add.at(tables[f"{kind}/{k}"], x, np.uint32(1) if times is None else times)
        yield _named(tables)

    return tally


def _learn(model, code: Code):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for block in _blocks_of(batches, code):
            mixer = Mixer({})
            mixer.ready = model.value
            for kind, (bit, slots, sets, _) in decisions(block, teach=True):
                mixer.learn(kind, bit, slots, sets)
            for name, x in mixer.learned().items():
                sums[name] = sums[name] + x if name in sums else x
        if sums:
            yield _named(sums)

    return learn


def _sum_tables(table: pa.Table) -> pa.Table:
    total = 0
    for x in table.column("counts"):
        total = total + unpack(x.as_py())[0].astype(np.int64)
    return pa.table([table.column("name").slice(0, 1), table.column("start").slice(0, 1), pa.array([pack(total)], pa.binary())], names=["name", "start", "counts"])


def _collected(df: DataFrame) -> dict[str, np.ndarray]:
    """The sums of _named() rows, on the driver: of a fixed size."""
    parts = {(r["name"], r["start"]): unpack(r["counts"])[0] for r in df.groupBy("name", "start").applyInArrow(_sum_tables, _NAMED).toLocalIterator()}
    names = sorted({name for name, _ in parts})
    return {name: np.concatenate([parts[k] for k in sorted(k for k in parts if k[0] == name)]) for name in names}


def token_scores(mixer: Mixer, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """log10 chances of a block's tokens, and of the bytes of its unknown words."""
    out = {"word": np.log(_take(block.name_share, _take(block.index, block.by_word)).astype(np.float64)), "byte": np.zeros(len(block.unknown))}
    for kind, (bit, slots, sets, at) in decisions(block):
        out[kind][at] += np.log(mixer.chances(kind, bit, slots, sets))
    words = np.empty_like(out["word"])
    words[block.by_word] = out["word"]
    return words / np.log(10), out["byte"] / np.log(10)


def _each(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of x between neighbouring places; each depends on its own values alone."""
    out = np.zeros(len(at) - 1)
    some = np.flatnonzero(np.diff(at) > 0)
    if len(some):
        out[some] = np.add.reduceat(x, at[some])
    return out


def _score(model, code: Code, floor: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = model.value
        for block in _blocks_of(batches, code):
            tokens, letters = token_scores(mixer, block)
            n = np.diff(block.at)
            known = _each((block.count > 0).astype(np.float64), block.at).astype(np.int64)
            base = _each(np.log10(block.count + 0.5), block.at) - n * floor
            total = _each(tokens, block.at) + _each(letters, block.cut)
            yield pa.record_batch([pa.array(block.ids, mask=~block.valid), pa.array(n), pa.array(known), pa.array(base), pa.array(total)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return score


def lm_scores(docs: DataFrame, group: str | None = "lang") -> DataFrame:
    """Scores of whole texts under a model of the documents whose crc32(doc_id as text) mod 5 is not 1.

    docs has doc_id and text; values of the column `group`, if given, name the
    groups of training documents (the seven commonest, the rest and nulls
    together); it is not used where a text is scored. Returns doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score and score. A null or empty text
    is the end token alone. A null doc_id is scored and not learned from. Rows
    that share a doc_id are learned from and scored each. An empty table gives
    no rows. Scores depend on the rows alone, not on their order or partitions.
    """
    spark = docs.sparkSession
    S.prepare(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    lots, bits = max(1, -(-size // LOT)), max(4, int(np.ceil(np.log2(max(1, size / SHARE)))))
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    train = F.coalesce(rest != 1, F.lit(False))
    kind = F.lit(0)
    if group is not None and group in docs.columns:
        top = [r[0] for r in docs.where(train & F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(GROUPS - 1).collect()]
        for k, value in enumerate(top, 1):
            kind = F.when(F.col(group) == value, k).otherwise(kind)
    rows = docs.select(F.col("doc_id").cast("long"), train.alias("train"), kind.alias("kind"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(lots)).alias("lot"))
    blocks = S.staged(rows.groupBy("lot").applyInArrow(_block, "block long, payload binary"), "lm-blocks")
    asked = blocks.mapInArrow(_ask(bits), "bucket int, block long, payload binary")
    replies = S.staged(asked.groupBy("bucket").applyInArrow(_reply(bits), REPLY), "lm-replies")
    cells = replies.select(F.explode("cells").alias("c")).groupBy("c.cell").agg(F.sum("c.types").alias("types"), F.sum("c.total").alias("total")).collect()  # a row for each class at most
    train_tokens, types = sum(r["total"] for r in cells), sum(r["types"] for r in cells)
    # a word that is counted once is unknown to all documents but its own
    once = next((r["types"] for r in cells if r["cell"] == UNKNOWN + 1), 0)
    code = Code({END: 1, UNKNOWN: 1 + once} | {r["cell"]: r["total"] for r in cells})
    coded = blocks.groupBy("block").cogroup(replies.select("block", "bucket", "payload").groupBy("block")).applyInArrow(_code, "block long, payload binary")
    coded = S.staged(coded, "lm-coded").select("payload")
    tables = _collected(coded.mapInArrow(_tally(code), _NAMED))
    for name, b in ((f"{k}/{j}", b) for k, bs in TABLES.items() for j, b in enumerate(bs)):
        tables[name] = np.minimum(tables.get(name, np.zeros(2 << b, np.int64)), 2**32 - 1).astype(np.uint32)
    # frozen once here, not in each task
    taught = spark.sparkContext.broadcast(Mixer(dict(tables)).freeze(without_own=True).ready)
    mixer = Mixer(tables)
    sums = _collected(coded.mapInArrow(_learn(taught, code), _NAMED))
    if sums:
        mixer.average(sums)
    floor = float(np.log10(train_tokens + 0.5 * (types + 1)))
    model = spark.sparkContext.broadcast(mixer.freeze())
    out = coded.mapInArrow(_score(model, code, floor), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(int(train_tokens)).cast("long").alias("train_tokens"), "base_score", "score")


def bits_per_byte(scores: DataFrame, docs: DataFrame) -> DataFrame:
    """One row for each held_out: total bits of the scores over the bytes of the texts."""
    size = docs.groupBy("doc_id").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"))
    rows = scores.groupBy("doc_id", "held_out").agg(F.sum("score").alias("score")).join(size, "doc_id")
    return rows.groupBy("held_out").agg((-F.sum("score") * float(np.log2(10)) / F.sum("bytes")).alias("bits_per_byte"))


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
