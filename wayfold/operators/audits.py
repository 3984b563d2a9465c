"""Gates and bounds of the privacy audit."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PrivacyConfig
from ..functions.columns import keep_chance, other_chance

GATE = "name string, passed boolean, hard boolean, detail string"


def gates(spark: SparkSession, rows: Iterable[tuple[str, bool, bool, str]]) -> DataFrame:
    return spark.createDataFrame([(n, bool(p), h, str(d)) for n, p, h, d in rows], GATE)


def verdict(rows: DataFrame) -> DataFrame:
    """One row: PASS, WARN where only soft gates fail, or FAIL; and the counts."""
    hard, soft = F.count_if(~F.col("passed") & F.col("hard")), F.count_if(~F.col("passed") & ~F.col("hard"))
    return rows.agg(F.count("*").alias("gates"), hard.alias("hard_failed"), soft.alias("soft_failed")).withColumn("verdict", F.when(F.col("hard_failed") > 0, "FAIL").when(F.col("soft_failed") > 0, "WARN").otherwise("PASS"))


def log_ratio(spark: SparkSession, cfg: PrivacyConfig, most: int = 20) -> DataFrame:
    """d, max_log_ratio: for each domain size, the greatest log ratio of two reports' chances over values and bucket epsilons."""
    eps = spark.createDataFrame([(float(e),) for e in cfg.eps_event], "e double")  # a few rows
    d = spark.range(1, most + 1).select(F.col("id").cast("int").alias("d"))
    rows = d.crossJoin(F.broadcast(eps.toDF("e1"))).crossJoin(F.broadcast(eps.toDF("e2")))
    p1, p2, q1, q2 = (f(F.col(e), F.col("d")) for f in (keep_chance, other_chance) for e in ("e1", "e2"))
    ratios = F.greatest(F.abs(F.log(p1 / p2)), F.abs(F.log(p1 / q2)), F.abs(F.log(q1 / p2)), F.abs(F.log(q1 / q2)))
    return rows.groupBy("d").agg(F.max(F.when(F.col("d") == 1, 0.0).otherwise(ratios)).alias("max_log_ratio"))


def bounds(cfg: PrivacyConfig) -> dict[str, float]:
    """What one transition and one piece of greatest length can give away."""
    envelope = max(cfg.eps_event) + cfg.eps_bucket
    return {"transition_envelope": envelope, "piece_bound": cfg.eps_start + cfg.eps_count + (cfg.max_segments - 1) * envelope}


def recovery_gate(context_tv: float, joint_tv: float, least: float = 0.005) -> str:
    """Which recovery to recommend: the joint one only if it is better by `least`."""
    return "joint" if math.isfinite(joint_tv) and joint_tv < context_tv and context_tv - joint_tv >= least else "context"


def majority(rows: DataFrame, column: str) -> DataFrame:
    """One row: the commonest value, the least on a tie."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counts.agg(F.min_by(column, F.struct(-F.col("n"), column)).alias(column))


def alignment(events: DataFrame, risk: DataFrame) -> DataFrame:
    """One row: matched rows, rows of one side alone, and rows whose u or v differ."""
    a = events.select("sbs_id", "t", F.col("u").alias("u1"), F.col("v").alias("v1"))
    b = risk.select("sbs_id", "t", F.col("u").alias("u2"), F.col("v").alias("v2"))
    both = a.join(b, ["sbs_id", "t"], "full_outer")
    alone = F.col("u1").isNull() | F.col("u2").isNull()
    return both.agg(F.count_if(~alone).alias("matched"), F.count_if(alone).alias("alone"), F.count_if(~alone & ((F.col("u1") != F.col("u2")) | (F.col("v1") != F.col("v2")))).alias("different"))


def upstream_gates(spark: SparkSession, splits: DataFrame, illegal_accepted: int, failed_risk: dict[str, int], fixed_thresholds: bool = True, global_ranking: bool = False) -> DataFrame:
    """Gates over what the earlier stages say of themselves.

    splits has split, min_coverage and n_illegal; failed_risk counts the records without a risk by split.
    """
    rows = [("no_illegal_accepted_sequence", illegal_accepted == 0, True, illegal_accepted)]
    for r in splits.orderBy("split").collect():  # a row for each split
        whole = abs((r["min_coverage"] or 0.0) - 1.0) <= 1e-12
        rows.append((f"{r['split']}_coverage_and_legality", whole and r["n_illegal"] == 0, True, f"coverage {r['min_coverage']}, illegal {r['n_illegal']}"))
    rows += [("fixed_public_thresholds", fixed_thresholds, True, fixed_thresholds), ("no_private_global_ranking", not global_ranking, True, global_ranking)]
    rows += [(f"{s}_no_failed_risk_records", n == 0, True, n) for s, n in sorted(failed_risk.items())]
    return gates(spark, rows)


def report_gates(spark: SparkSession, name: str, audit: DataFrame, expected: int) -> DataFrame:
    """Gates over one row of an audit of reports: no extra columns, all inside the public domain, as many as there should be."""
    r = audit.head()
    rows = [
        (f"{name}_columns", r["extra_columns"] == 0, True, r["extra_columns"]),
        (f"{name}_public_domain", r["outside_domain"] == 0 and ("bad_labels" not in audit.columns or r["bad_labels"] == 0), True, r["outside_domain"]),
        (f"{name}_count", r["reports"] == expected, True, f"{r['reports']} of {expected}"),
    ]
    return gates(spark, rows)


def budget_gates(spark: SparkSession, spent: DataFrame, cfg: PrivacyConfig) -> DataFrame:
    """Gates over schedule_audit()'s greatest spend, and the randomiser's bounds."""
    limit = bounds(cfg)
    most = max(r["max_log_ratio"] for r in log_ratio(spark, cfg).collect())  # a row for each domain size
    worst = spent.head()["most"] or 0.0
    rows = [
        ("transition_spend_within_budget", worst <= cfg.for_transitions + 1e-9, True, worst),
        ("randomiser_log_ratio", most <= max(cfg.eps_event) + 1e-9, True, most),
        ("piece_bound_is_finite", math.isfinite(limit["piece_bound"]), True, limit["piece_bound"]),
    ]
    return gates(spark, rows)


def require(rows: DataFrame) -> DataFrame:
    """rows, unless a hard gate among them fails."""
    bad = [r["name"] for r in rows.where("hard and not passed").collect()]  # a row for each gate
    if bad:
        raise AssertionError(f"gates failed: {', '.join(bad)}")
    return rows
