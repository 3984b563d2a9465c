"""The budget scheduler: one fold over each piece's transitions, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PrivacyConfig


def feasible(remaining: Column, future: Column, cfg: PrivacyConfig) -> Column:
    """The buckets whose cost leaves the least cost for each later transition, in order."""
    costs = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(c).alias("c")) for k, c in enumerate(cfg.costs, 1)))
    fits = F.filter(costs, lambda x: x["c"] + future * F.lit(min(cfg.costs)) <= remaining + F.lit(1e-12))
    return F.transform(fits, lambda x: x["k"])


def chosen(buckets: Column, target: Column) -> Column:
    """The target if feasible, else the largest feasible one below it: never weaker protection."""
    return F.array_max(F.filter(buckets, lambda k: k <= target))


def schedule(rows: DataFrame, cfg: PrivacyConfig, carry: list[str], target: str = "target_bucket") -> DataFrame:
    """rows (one for each sbs_id and t) with exec_bucket, transition_cost, remaining_before, remaining_after, future_after, feasible_buckets.

    A choice depends on all earlier ones, so a piece is folded as an array; it
    holds max_segments - 1 transitions at most. Only `carry` is kept of the rest.
    """
    packed = rows.select("sbs_id", F.struct("t", F.col(target).alias("_target"), *(c for c in carry if c not in ("sbs_id", "t"))).alias("x"))
    pieces = packed.groupBy("sbs_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    n = F.size("xs")
    step_type = "array<struct<exec_bucket:int,transition_cost:double,remaining_before:double,remaining_after:double,future_after:int,feasible_buckets:array<int>>>"
    zero = F.struct(F.lit(cfg.for_transitions).alias("rem"), F.array().cast(step_type).alias("out"))
    costs = F.array(*map(F.lit, cfg.costs))

    def add(state, x):
        rem = state["rem"]
        future = n - 1 - F.size(state["out"])
        fits = feasible(rem, future, cfg)
        k = chosen(fits, x["_target"])
        cost = F.element_at(costs, k)
        step = F.struct(k.alias("exec_bucket"), cost.alias("transition_cost"), rem.alias("remaining_before"), (rem - cost).alias("remaining_after"), future.alias("future_after"), fits.alias("feasible_buckets"))
        return F.struct((rem - cost).alias("rem"), F.concat(state["out"], F.array(step)).alias("out"))

    folded = pieces.select("sbs_id", F.aggregate("xs", zero, add, lambda s: s["out"]).alias("steps"), "xs")
    both = folded.select("sbs_id", F.explode_outer(F.arrays_zip("xs", "steps")).alias("z"))
    return both.select("sbs_id", "z.xs.*", "z.steps.*").withColumnRenamed("_target", "target_bucket" if target == "target_bucket" else target)


def audit(scheduled: DataFrame, cfg: PrivacyConfig) -> DataFrame:
    """One row: greatest spend and least margin of a piece, share of transitions below their target, whether any is above, whether all costs fit."""
    pieces = scheduled.groupBy("sbs_id").agg(F.sum("transition_cost").alias("spent"), F.min("remaining_after").alias("margin"))
    spend = pieces.agg(F.count("*").alias("pieces"), F.round(F.max("spent") + cfg.eps_start + cfg.eps_count, 9).alias("max_spend"), F.round(F.min("margin"), 9).alias("min_margin"))
    rows = scheduled.agg(
        F.count("*").alias("transitions"),
        F.count_if(F.col("exec_bucket") < F.col("target_bucket")).alias("fallbacks"),
        F.count_if(F.col("exec_bucket") > F.col("target_bucket")).alias("weaker"),
        *(F.count_if(F.col("exec_bucket") == k).alias(f"exec_{k}") for k in range(1, len(cfg.eps_event) + 1)),
    )
    return spend.crossJoin(rows).withColumn("within_budget", F.col("max_spend") <= cfg.budget + 1e-10)  # one row each
