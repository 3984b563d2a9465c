"""The public road graph: successors, best parallel edges, hop distances."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import staged

#: Edges of a graph that each task may hold for a breadth-first search; a larger graph is searched by joins.
EDGES_HELD = 2_000_000


def line_graph(roads: DataFrame) -> DataFrame:
    """segment, successors: each road (src, dst, key) is a segment src__dst__key; its successors are all roads from dst, sorted.

    U-turns and self-loops count; a dead end has an empty list.
    """
    name = F.concat_ws("__", "src", "dst", F.col("key").cast("string"))
    roads = roads.select("src", "dst", name.alias("segment")).distinct()
    nexts = roads.select(F.col("src").alias("dst"), F.col("segment").alias("next"))
    return roads.join(nexts, "dst", "left").groupBy("segment").agg(F.array_sort(F.collect_set("next")).alias("successors"))


def best_parallel(roads: DataFrame) -> DataFrame:
    """src, dst, key, length: the shortest of parallel roads; a missing or negative length counts as 1, ties go to the least key."""
    length = F.coalesce(F.when(F.col("length") >= 0, F.col("length")), F.lit(1.0))
    return roads.groupBy("src", "dst").agg(F.min(F.struct(length.alias("length"), "key")).alias("x")).select("src", "dst", "x.key", "x.length")


def domains(edges: DataFrame) -> DataFrame:
    """u, v, pos (from 0, in the order of v), d: the public successor domains."""
    own = Window.partitionBy("u")
    return edges.select("u", "v").distinct().withColumns({"pos": F.row_number().over(own.orderBy("v")) - 1, "d": F.count("*").over(own).cast("int")})


def hop_distances(pairs: DataFrame, edges: DataFrame, bound: int = 29) -> DataFrame:
    """a, b, hops of the given pairs (a, b): the fewer of the ways there and back, null beyond the bound.

    Each source is searched once, for all its partners together.
    """
    both = pairs.select("a", "b").union(pairs.select("b", "a")).distinct()
    if edges.limit(EDGES_HELD + 1).count() <= EDGES_HELD:
        found = _search(both, edges, bound)
    else:
        found = _frontiers(both, edges, bound)
    there, back = found.toDF("a", "b", "h1"), found.toDF("b", "a", "h2")
    return pairs.select("a", "b").distinct().join(there, ["a", "b"], "left").join(back, ["a", "b"], "left").select("a", "b", F.least("h1", "h2").alias("hops"))


def _search(pairs: DataFrame, edges: DataFrame, bound: int) -> DataFrame:
    out: dict[str, list[str]] = {}
    for row in edges.select("u", "v").toLocalIterator():
        out.setdefault(row["u"], []).append(row["v"])
    held = pairs.sparkSession.sparkContext.broadcast(out)

    def search(batches):
        graph = held.value
        for batch in batches:
            a, b, hops = [], [], []
            for source, goals in batch.itertuples(index=False):
                want, seen, queue = set(goals), {source: 0}, deque([source])
                want.discard(source)
                while queue and want:
                    x = queue.popleft()
                    if seen[x] == bound:
                        break
                    for y in graph.get(x, ()):
                        if y not in seen:
                            seen[y] = seen[x] + 1
                            want.discard(y)
                            queue.append(y)
                for goal in goals:
                    if goal in seen:
                        a.append(source)
                        b.append(goal)
                        hops.append(seen[goal])
            yield pd.DataFrame({"a": a, "b": b, "hops": pd.Series(hops, dtype="int32")})

    grouped = pairs.groupBy("a").agg(F.collect_set("b").alias("goals"))  # of the graph's segments, those that an observed path joins
    return grouped.mapInPandas(search, "a string, b string, hops int")


def _frontiers(pairs: DataFrame, edges: DataFrame, bound: int) -> DataFrame:
    """Breadth-first search by joins: in each round the frontier of every source moves one hop, and sources with no open goal drop out."""
    reached = staged(pairs.select("a").distinct().select("a", F.col("a").alias("b"), F.lit(0).alias("hops")), "reached")
    frontier = reached
    for h in range(1, bound + 1):
        open_ = pairs.join(reached, ["a", "b"], "left_anti").select("a").distinct()
        step = frontier.join(open_, "a", "left_semi").select("a", F.col("b").alias("u")).join(edges, "u").select("a", F.col("v").alias("b")).distinct()
        frontier = staged(step.join(reached, ["a", "b"], "left_anti").withColumn("hops", F.lit(h)), "frontier")
        if not frontier.limit(1).count():
            break
        reached = staged(reached.union(frontier), "reached")
    return reached.join(pairs, ["a", "b"], "left_semi")
