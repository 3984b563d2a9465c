"""Local randomisers: what a client reports of a piece."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PrivacyConfig
from ..functions.columns import keep_chance, respond, uniform
from .graph import domains

# A seed for each mechanism and split.
SEEDS = {"riskaware": (101, 202, 303), "uniform": (1101, 1202, 1303), "degree": (5101, 5202, 5303)}
SPLITS = ("train", "valid", "test")
#: What a server report may hold, and nothing else.
START, COUNT, TRANSITION = ("split", "x_noisy"), ("split", "x_noisy"), ("split", "u", "y", "k_noisy")


def seed_of(method: str, split: Column, seed: int = 42) -> Column:
    out = F.lit(None).cast("long")
    for name, offset in zip(SPLITS, SEEDS[method], strict=True):
        out = F.when(split == name, F.lit(seed * 10000 + offset)).otherwise(out)
    return out


def start_and_count(sbs: DataFrame, edges: DataFrame, cfg: PrivacyConfig, method: str, seed: int = 42) -> DataFrame:
    """split, sbs_id, start, start_noisy, cnt, cnt_noisy: the piece's first segment over all segments, its length over 1 to max_segments."""
    every = edges.select(F.col("u").alias("segment")).union(edges.select("v")).distinct()
    ranked = every.select("segment", (F.row_number().over(Window.orderBy("segment")) - 1).alias("pos"))  # the public segments
    size = ranked.agg(F.count("*").cast("int").alias("_d"))  # one row
    key = lambda draw: uniform(seed_of(method, F.col("split"), seed), F.col("sbs_id"), draw)
    rows = sbs.select("split", "sbs_id", F.get("segments", F.lit(0)).alias("start"), F.size("segments").alias("cnt")).crossJoin(F.broadcast(size))
    rows = rows.join(ranked.select(F.col("segment").alias("start"), "pos"), "start", "left")
    noisy = respond(F.col("pos"), F.col("_d"), F.lit(cfg.eps_start), key("start0"), key("start1"))
    counts = respond(F.col("cnt") - 1, F.lit(cfg.max_segments), F.lit(cfg.eps_count), key("count0"), key("count1")) + 1
    rows = rows.select("split", "sbs_id", "start", "cnt", noisy.alias("at"), counts.cast("int").alias("cnt_noisy"))
    rows = rows.join(ranked.select(F.col("segment").alias("start_noisy"), F.col("pos").alias("at")), "at", "left")
    return rows.select("split", "sbs_id", "start", "start_noisy", "cnt", "cnt_noisy")


def successors(rows: DataFrame, edges: DataFrame, cfg: PrivacyConfig, method: str, eps: Column, bucket: Column, seed: int = 42) -> DataFrame:
    """rows (split, sbs_id, t, u, v, ..) with y, the reported successor, k_noisy, the reported bucket, and keep_flag.

    The domain is the public successors of u; it never grows. A v outside it fails.
    """
    dom = domains(edges)
    lists = dom.groupBy("u").agg(F.array_sort(F.collect_list("v")).alias("_domain"))  # a road's successors: a few
    key = lambda draw: uniform(seed_of(method, F.col("split"), seed), F.col("sbs_id"), F.col("t"), draw)
    joined = rows.join(lists, "u", "left")
    at = (F.array_position("_domain", F.col("v")) - 1).cast("int")
    fine = F.assert_true(F.coalesce(at >= 0, F.lit(False)), F.lit("a successor is not in the public domain"))
    y = F.get("_domain", respond(at, F.size("_domain"), eps, key("y0"), key("y1")))
    k = respond(bucket - 1, F.lit(len(cfg.eps_event)), F.lit(cfg.eps_bucket), key("k0"), key("k1")) + 1
    out = joined.where(fine.isNull()).withColumns({"y": y, "k_noisy": k.cast("int"), "epsilon_event": eps, "d": F.size("_domain")})
    return out.withColumn("keep_flag", (F.col("y") == F.col("v")).cast("int")).drop("_domain")


def event_epsilon(bucket: Column, cfg: PrivacyConfig) -> Column:
    return F.element_at(F.array(*map(F.lit, cfg.eps_event)), bucket)


def server_reports(rows: DataFrame, columns: tuple[str, ...], seed: int = 42) -> DataFrame:
    """Only what a server may see, in an order that says nothing of the clients: a sort by random keys."""
    return rows.orderBy(F.rand(seed)).select(*columns)


def keep_rates(reports: DataFrame) -> DataFrame:
    """By split and target bucket: transitions, executed below target, share kept, mean expected share."""
    expected = keep_chance(F.col("epsilon_event"), F.col("d"))
    return reports.groupBy("split", "target_bucket").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("exec_bucket") < F.col("target_bucket")).alias("fallbacks"),
        F.round(F.avg("keep_flag"), 9).alias("keep_rate"),
        F.round(F.avg(expected), 9).alias("expected_keep_rate"),
    )


def aggregate_reports(reports: DataFrame) -> DataFrame:
    """Counts by (u, y, k), and in the same pass by (u, y), (u, k), u and k: grouping sets, with `level` to tell them apart."""
    sets = [F.col("split"), F.col("u"), F.col("y"), F.col("k_noisy")]
    s, u, y, k = sets
    out = reports.groupingSets([[s, u, y, k], [s, u, y], [s, u, k], [s, u], [s, k]], s, u, y, k).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    names = {0: "u,y,k", 1: "u,y", 2: "u,k", 3: "u", 6: "k"}
    level = F.lit(None).cast("string")
    for gid, name in names.items():
        level = F.when(F.col("gid") == gid, name).otherwise(level)
    return out.select("split", level.alias("level"), "u", "y", "k_noisy", "n")


def report_audit(reports: DataFrame, edges: DataFrame, buckets: int = 3) -> DataFrame:
    """One row: reports, columns that do not belong, successors outside the domain, labels outside 1..buckets."""
    extra = sorted(set(reports.columns) - set(TRANSITION))
    legal = edges.select("u", F.col("v").alias("y")).distinct()
    bad = reports.join(legal, ["u", "y"], "left_anti").agg(F.count("*").alias("outside_domain"))
    rows = reports.agg(F.count("*").alias("reports"), F.count_if(~F.col("k_noisy").between(1, buckets)).alias("bad_labels"))
    return rows.crossJoin(bad).withColumn("extra_columns", F.lit(len(extra)).cast("int"))  # one row each


def start_audit(reports: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: start reports, columns that do not belong, segments that are not public."""
    public = edges.select(F.col("u").alias("x_noisy")).union(edges.select("v")).distinct()
    bad = reports.join(public, "x_noisy", "left_anti").agg(F.count("*").alias("outside_domain"))
    rows = reports.agg(F.count("*").alias("reports"))
    return rows.crossJoin(bad).withColumn("extra_columns", F.lit(len(set(reports.columns) - set(START))).cast("int"))  # one row each


def count_audit(reports: DataFrame, max_segments: int) -> DataFrame:
    """One row: length reports, columns that do not belong, lengths outside 1..max_segments."""
    out = reports.agg(F.count("*").alias("reports"), F.count_if(F.coalesce(~F.col("x_noisy").between(1, max_segments), F.lit(True))).alias("outside_domain"))
    return out.withColumn("extra_columns", F.lit(len(set(reports.columns) - set(COUNT))).cast("int"))
