"""Near-duplicate documents by SetSketch registers.

A register holds, on an exponential scale, the truncated minimum of one hash
over a document's shingles; the larger of two registers is that of the union,
so sketches merge. Documents that agree in a band of registers are candidates.
The likelihood of a pair's larger, smaller and equal registers, given both set
sizes, estimates their Jaccard similarity; what may reach the threshold is
verified on the full sets, and the links' components name the groups.

Documents with the same set are one node from the start. A band value that few
nodes share is compared pair by pair; of a hot one, all nodes are compared with
the least document's. Where that leaves a hot value with several components,
their nodes are joined by prefix and position: two sets that meet the threshold
share a shingle among their rarest ones, and enough stands behind the first that
they share. That is exact and needs no bound on the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _shared as S

BANDS, ROWS = 32, 5
M = BANDS * ROWS
#: Registers are floor(1 - log_B(x)) within 0..Q+1 of minima x of exponentials with rate RATE for each shingle.
B, RATE, Q = 1.08, 20.0, 254
#: Band values that up to so many nodes share are compared pair by pair.
SMALL = 8
#: Nodes (three numbers each) that are sent to all tasks to pick their texts; for more, the texts are dealt by a shuffle.
WANTED_SENT = 1_000_000
#: Estimates further below the threshold are not verified: five standard errors.
MARGIN = 0.16

_FACTORS = np.random.default_rng(11).integers(0, 2**63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each row's shingles of `size` words; fewer words are one shingle."""
    for a, b in S.chunks(offsets):
        part = _LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, bounds = S.word_bounds(part, offsets[a : b + 1] - offsets[a])
        words = S.span_hashes(part, starts, ends)
        for k in range(b - a):
            own = words[bounds[k] : bounds[k + 1]]
            if 0 < len(own) < size:
                yield S.mix(S.gram_hashes(own, len(own)) + np.uint64(len(own)))
            else:
                yield np.unique(S.gram_hashes(own, size))


def sketch(shingles: np.ndarray) -> np.ndarray:
    least = np.full(M, np.iinfo(np.uint64).max)
    for a in range(0, len(shingles), 4096):
        part = shingles[a : a + 4096, None]
        for j in range(0, M, 40):
            least[j : j + 40] = np.minimum(least[j : j + 40], (part * _FACTORS[j : j + 40]).min(0))
    x = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64 * (1 - 1e-12)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, Q + 1).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of each pair, from their registers and the sizes of their sets."""
    larger, smaller = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    like = larger * np.log(up + tiny) + smaller * np.log(down + tiny) + (a.shape[1] - larger - smaller) * np.log(np.maximum(1 - up - down, tiny))
    return j[np.arange(len(j)), like.argmax(1)]


def _sketches(size: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = S.text_column(batch.column(2))
            count, first, second, regs = [], [], [], []
            for x in shingle_sets(data, offsets, size):
                count.append(len(x))
                first.append(int(np.add.reduce(S.mix(x + np.uint64(1)))) if len(x) else 0)
                second.append(int(np.add.reduce(S.mix(x * np.uint64(S._BASE)))) if len(x) else 0)
                regs.append(sketch(x) if len(x) else None)
            node = S.mix(np.array(first, np.uint64) ^ S.mix(np.array(second, np.uint64)) + np.array(count, np.uint64)).view(np.int64)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(count, pa.int64()), pa.array([n if c else None for n, c in zip(node.tolist(), count, strict=True)], pa.int64()), pa.array([None if r is None else r.tobytes() for r in regs], pa.binary())],
                names=["doc_id", "text_key", "n_shingles", "node", "sketch"],
            )

    return make


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, doc_id, band: a row for each band of a sketch, named by a hash of the band's place and registers."""
    for batch in batches:
        table = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, BANDS, ROWS).astype(np.uint64)
        keys = np.zeros((len(table), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
        for j in range(ROWS):
            keys = S.mix(keys * np.uint64(S._BASE) + table[:, :, j] + np.uint64(1))
        at = pa.array(np.repeat(np.arange(len(table)), BANDS))
        yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(keys.view(np.int64).ravel())], names=["node", "doc_id", "band"])


def _sets(size: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = S.text_column(batch.column(1))
            sets = list(shingle_sets(data, offsets, size))
            yield pa.record_batch([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "shingles"])

    return make


def _possible(least: float):
    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, M) for k in (2, 3))
                j = estimate(a, b, *(batch.column(k).to_numpy().astype(float) for k in (4, 5)))
                keep = pa.array(np.flatnonzero(j >= least))
                yield pa.record_batch([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return possible


def _linked(percent: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(k)
            keep = pa.array(keep, pa.int64())
            yield pa.record_batch([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return linked


def _explode_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
        at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], names=["node", "shingle"])


def components(links: DataFrame) -> DataFrame:
    """node, label: the nodes of the links (a, b), and for each component one label, its least node.

    In each round a node takes the least label of its neighbours and itself, and
    then its label's label; rounds go on until nothing changes.
    """
    both = S.staged(links.union(links.select("b", "a")).toDF("node", "other").distinct(), "links")
    labels = S.staged(both.select("node").distinct().withColumn("label", F.col("node")), "labels")
    while True:
        near = both.join(labels.toDF("other", "near"), "other").groupBy("node").agg(F.min("near").alias("near"))
        new = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        new = S.staged(new, "labels")
        jump = new.select(F.col("node").alias("new"), F.col("new").alias("far"))
        new = new.join(jump, "new", "left").select("node", "label", F.least("new", "far").alias("new"))
        new = S.staged(new, "labels")
        labels = new.select("node", F.col("new").alias("label"))
        if not new.where("new <> label").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of `percent` or more of their sets of `size`-word shingles.

    docs has doc_id and text; other columns are not read. Returns a row for each
    row: doc_id, text_key (a hash of the text), n_shingles, component_id (the
    smallest doc_id that links reach, its own included), kept (doc_id is the
    component's). A null text or one without words has an empty set and no
    links. Rows that repeat a doc_id are linked each by its own text. A null
    doc_id is no part of any group: component_id is null and kept is true.
    """
    spark = docs.sparkSession
    S.prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), S.text_key(docs).alias("text_key"), "text")
    kinds = "doc_id long, text_key long, n_shingles long, node long, sketch binary"
    rows = S.staged(docs.mapInArrow(_sketches(size), kinds), "sketches")
    known = rows.where("doc_id is not null and node is not null")
    # one node for each distinct set: its least document, its sketch
    nodes = S.staged(known.groupBy("node").agg(F.min(F.struct("doc_id", "text_key", "n_shingles")).alias("x"), F.first("sketch").alias("sketch")).select("node", "x.*", "sketch"), "nodes")
    dealt = nodes.select("node", "doc_id", "sketch").mapInArrow(_bands, "node long, doc_id long, band long")
    shared = S.staged(dealt.groupBy("band").agg(F.count("*").alias("many"), F.min(F.struct("doc_id", "node")).alias("lead")).where("many > 1").select("band", "many", F.col("lead.node").alias("lead")), "bands")
    members = S.staged(dealt.join(shared, "band").select("band", "many", "lead", "node"), "members")
    few = members.where(F.col("many") <= SMALL).select("band", "node")
    pairs = few.toDF("band", "a").join(few.toDF("band", "b"), "band").where("a < b").select("a", "b")
    hot = members.where((F.col("many") > SMALL) & (F.col("lead") != F.col("node")))
    pairs = pairs.union(hot.select(F.least("lead", "node"), F.greatest("lead", "node"))).distinct()
    about = nodes.select("node", "sketch", F.col("n_shingles").alias("n"))
    pairs = pairs.join(about.toDF("a", "sketch_a", "n_a"), "a").join(about.toDF("b", "sketch_b", "n_b"), "b")
    pairs = pairs.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b")
    pairs = S.staged(pairs.mapInArrow(_possible(percent / 100 - MARGIN), "a long, b long"), "pairs")
    # full sets of the nodes that are to be verified, or that stand in a hot band value
    wanted = pairs.select("a").union(pairs.select("b")).union(members.where(F.col("many") > SMALL).select("node")).toDF("node").distinct()
    wanted = S.staged(wanted.join(nodes.select("node", "doc_id", "text_key"), "node"), "wanted")
    few_rows = wanted.limit(WANTED_SENT + 1).count() <= WANTED_SENT
    texts = docs.where("doc_id is not null").join(F.broadcast(wanted) if few_rows else wanted, ["doc_id", "text_key"]).select("node", "text")
    sets = S.staged(texts.mapInArrow(_sets(size), "node long, shingles binary").dropDuplicates(["node"]), "sets")

    def verified(these: DataFrame) -> DataFrame:
        full = these.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
        return S.staged(full.select("a", "b", "set_a", "set_b").mapInArrow(_linked(percent), "a long, b long"), "verified")

    links = verified(pairs)
    labels = components(links)
    of = lambda df: df.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = of(members.where(F.col("many") > SMALL)).groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    left = S.staged(of(members.join(mixed.select("band"), "band", "left_semi").select("node").distinct()), "residual")
    if left.limit(1).count():
        links = S.staged(links.union(verified(_by_prefix(left, sets, percent))), "links")
        labels = components(links)
    named = S.staged(nodes.select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
    least = S.staged(named.groupBy("label").agg(F.min("doc_id").alias("component_id")), "components")
    named = S.staged(named.join(least, "label").select("node", "component_id"), "named")
    out = rows.select("doc_id", "text_key", "n_shingles", "node").join(named, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates() keeps: of each group that of the smallest doc_id.

    Rows that repeat both doc_id and text are kept or dropped together.
    """
    kept = near_duplicates(docs, size, percent).where("kept and doc_id is not null").select("doc_id", "text_key").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), S.text_key(docs).alias("text_key"))
    nameless = rows.where("doc_id is null").select("row.*")
    return rows.join(S.staged(kept, "kept"), ["doc_id", "text_key"], "left_semi").select("row.*").union(nameless)


def _by_prefix(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes (node, label) with different labels that share one of their rarest shingles, as linked ones must."""
    tokens = S.staged(sets.join(nodes, "node", "left_semi").mapInArrow(_explode_set, "node long, shingle long"), "tokens")
    often = S.staged(tokens.groupBy("shingle").agg(F.count("*").alias("often")), "often")
    ranked = tokens.join(often, "shingle")
    own = Window.partitionBy("node")
    ranked = ranked.withColumns({"rank": F.row_number().over(own.orderBy("often", "shingle")), "n": F.count("*").over(own)})
    prefix = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).where("often > 1")
    prefix = S.staged(prefix.select("shingle", "node", "n", "rank").join(nodes, "node"), "prefix")
    # at each shingle, one of a pair is outside the label that most nodes there have
    most = prefix.groupBy("shingle", "label").agg(F.count("*").alias("many")).groupBy("shingle").agg(F.max_by("label", F.struct("many", "label")).alias("most"))
    most = S.staged(most, "most")  # so that the join below is one that Spark can split where a shingle is hot
    minor = S.staged(prefix.join(most, "shingle").where("label <> most"), "minor")
    own = ("node", "label", "n", "rank")
    x, y = minor.select("shingle", *(F.col(c).alias(f"{c}_x") for c in own)), prefix.select("shingle", *(F.col(c).alias(f"{c}_y") for c in own))
    # from their first common shingle on, two sets share no more than the shorter rest
    enough = f"{100 + percent} * (1 + least(n_x - rank_x, n_y - rank_y)) >= {percent} * (n_x + n_y)"
    pairs = x.join(y, "shingle").where(f"label_x <> label_y and 100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y) and {enough}")
    return S.staged(pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct(), "pairs")


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_shingles", "component_id", "kept")
