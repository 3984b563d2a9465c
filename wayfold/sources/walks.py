"""Walks on a fixed public graph, read from the events table: one for each user.

The graph has SEGMENTS segments; segment s has 1 + s % 4 successors, the j-th
of them (3s + 7j + 1) % SEGMENTS. An event's k chooses the next successor, so a
walk is legal by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = 64


def segment_id(s):
    return F.concat(F.lit("s"), F.lpad(s.cast("string"), 2, "0"))


def public_edges(spark: SparkSession) -> DataFrame:
    """u, v: every legal successor of every segment."""
    s = spark.range(SEGMENTS).select(F.col("id").alias("s"))
    both = s.select("s", F.explode(F.sequence(F.lit(0), (F.col("s") % 4).cast("int"))).alias("j"))
    return both.select(segment_id(F.col("s")).alias("u"), segment_id((3 * F.col("s") + 7 * F.col("j") + 1) % SEGMENTS).alias("v"))


def walks(events: DataFrame) -> DataFrame:
    """traj_id, segments, segment_times (epoch seconds), in the order of (ts, event_id); a fold over each user's events."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = events.select("user_id", F.struct("ts", "event_id", k.alias("k")).alias("e"))
    users = rows.groupBy("user_id").agg(F.array_sort(F.collect_list("e")).alias("events"))
    first = F.array(F.get("events", F.lit(0))["k"] % SEGMENTS)

    def step(path, e):
        s = F.element_at(path, -1)
        return F.concat(path, F.array((3 * s + 7 * (e["k"] % (1 + s % 4)) + 1) % SEGMENTS))

    path = F.aggregate(F.slice("events", 2, F.greatest(F.size("events") - 1, F.lit(0))), first, step)
    return users.select(
        F.concat(F.lit("u"), F.col("user_id")).alias("traj_id"),
        F.transform(path, segment_id).alias("segments"),
        F.transform("events", lambda e: F.unix_timestamp(e["ts"])).alias("segment_times"),
    )
