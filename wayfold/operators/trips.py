"""Raw trips: parsing, point times, and matching to a road graph."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Why a trip was not matched.
REASONS = ("too_few_points", "no_near_node", "one_node", "no_path", "too_few_segments")
#: Paths that a task keeps, to search a pair of nodes once.
WAYS_HELD = 100_000
MATCHED = "traj_id string, taxi_id string, start_timestamp long, segments array<string>, segment_times array<long>, reason string"


def parse_trips(raw: DataFrame, min_points: int = 10, max_points: int | None = None, drop_missing: bool = True) -> DataFrame:
    """traj_id, taxi_id, start_timestamp, points of the valid rows of TRIP_ID, TAXI_ID, TIMESTAMP, MISSING_DATA, POLYLINE (a JSON list of [lon, lat])."""
    points = F.from_json("POLYLINE", "array<array<double>>")
    rows = raw.select(F.col("TRIP_ID").alias("traj_id"), F.col("TAXI_ID").alias("taxi_id"), F.col("TIMESTAMP").try_cast("long").alias("start_timestamp"), points.alias("points"), F.lower(F.trim("MISSING_DATA")).alias("missing"))
    good = F.col("points").isNotNull() & F.col("start_timestamp").isNotNull() & (F.size("points") >= min_points)
    good &= F.forall("points", lambda p: F.coalesce((F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull(), F.lit(False)))
    if max_points:
        good &= F.size("points") <= max_points
    if drop_missing:
        good &= F.coalesce(F.col("missing") != "true", F.lit(True))
    return rows.where(good).drop("missing")


def point_times(trips: DataFrame, seconds: int = 15) -> DataFrame:
    """trips with point_times: the start and one step for each point."""
    return trips.withColumn("point_times", F.transform("points", lambda p, i: F.col("start_timestamp") + i * seconds))


def match(trips: DataFrame, nodes: DataFrame, roads: DataFrame, spark: SparkSession, cell: float = 0.01, min_segments: int = 2) -> DataFrame:
    """Map each trip to road segments: the nearest node of each point, then the direct road or the shortest path.

    nodes: node, lon, lat. roads: src, dst, key, length, one for each pair
    (best_parallel()). The public graph is held by each task. A segment's time is
    spread evenly between its points'. A trip that cannot be matched as a whole
    has null segments and a reason.
    """
    where, grid, out = {}, {}, {}
    for r in nodes.toLocalIterator():
        where[r["node"]] = (r["lon"], r["lat"])
        grid.setdefault((math.floor(r["lon"] / cell), math.floor(r["lat"] / cell)), []).append(r["node"])
    for r in roads.toLocalIterator():
        out.setdefault(r["src"], {})[r["dst"]] = (r["length"], r["key"])
    held = spark.sparkContext.broadcast((where, {k: sorted(v) for k, v in grid.items()}, out, cell))

    def match_all(batches):
        where, grid, out, cell = held.value

        cells = [*grid] or [(0, 0)]
        (x0, x1), (y0, y1) = ((min(c[k] for c in cells), max(c[k] for c in cells)) for k in (0, 1))

        def nearest(lon, lat):
            x, y = math.floor(lon / cell), math.floor(lat / cell)
            best = None
            outside = max(x0 - x, x - x1, y0 - y, y - y1, 0)  # rings that hold no node
            for ring in range(outside, max(abs(x - x0), abs(x - x1), abs(y - y0), abs(y - y1)) + 1):
                for i in range(max(x - ring, x0), min(x + ring, x1) + 1):
                    side = range(max(y - ring, y0), min(y + ring, y1) + 1) if abs(i - x) == ring else (j for j in {y - ring, y + ring} if y0 <= j <= y1)
                    for j in side:
                        for n in grid.get((i, j), ()):
                            d = (where[n][0] - lon) ** 2 + (where[n][1] - lat) ** 2
                            if best is None or (d, n) < best:
                                best = (d, n)
                if best is not None and best[0] <= (ring * cell) ** 2:
                    break
            return None if best is None else best[1]

        ways: dict = {}

        def path(a, b):
            """The shortest path, searched once for a pair of nodes in a task."""
            if (a, b) not in ways:
                if len(ways) >= WAYS_HELD:
                    ways.clear()
                ways[a, b] = search(a, b)
            return ways[a, b]

        def search(a, b):
            if b in out.get(a, {}):
                return [a, b]
            seen, queue, back = {a: 0.0}, [(0.0, a)], {}
            while queue:
                d, x = heapq.heappop(queue)
                if x == b:
                    way = [b]
                    while way[-1] != a:
                        way.append(back[way[-1]])
                    return way[::-1]
                if d > seen[x]:
                    continue
                for y, (length, _) in sorted(out.get(x, {}).items()):
                    if d + length < seen.get(y, math.inf):
                        seen[y], back[y] = d + length, x
                        heapq.heappush(queue, (d + length, y))
            return None

        def one(points, times):
            if len(points) < 2:
                return None, None, REASONS[0]
            steps = []
            for (lon, lat), t in zip(points, times, strict=True):
                n = nearest(lon, lat)
                if n is None:
                    return None, None, REASONS[1]
                if not steps or steps[-1][0] != n:
                    steps.append((n, t))
            if len(steps) < 2:
                return None, None, REASONS[2]
            segments, taus = [], []
            for (a, t0), (b, t1) in zip(steps, steps[1:], strict=False):
                way = path(a, b)
                if way is None:
                    return None, None, REASONS[3]
                m = len(way) - 1
                for j, (x, y) in enumerate(zip(way, way[1:], strict=False)):
                    name = f"{x}__{y}__{out[x][y][1]}"
                    if not segments or segments[-1] != name:
                        segments.append(name)
                        taus.append(round(t0 + j / m * max(1, t1 - t0)))
            return (segments, taus, None) if len(segments) >= min_segments else (None, None, REASONS[4])

        for batch in batches:
            made = [one(p, t) for p, t in zip(batch["points"], batch["point_times"], strict=True)]
            yield pd.DataFrame({"traj_id": batch["traj_id"], "taxi_id": batch["taxi_id"], "start_timestamp": batch["start_timestamp"], "segments": [m[0] for m in made], "segment_times": [m[1] for m in made], "reason": [m[2] for m in made]})

    return trips.select("traj_id", "taxi_id", "start_timestamp", "points", "point_times").mapInPandas(match_all, MATCHED)


def failures(matched: DataFrame) -> DataFrame:
    """reason, n: why trips were not matched."""
    return matched.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
