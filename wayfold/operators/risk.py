"""Risk of each transition, and its bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RiskConfig
from ..functions.columns import clip01, threshold_bucket
from .graph import domains, hop_distances
from .sequences import stay_anchors


def needed_pairs(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """The (a, b) whose distance the score needs: segment to piece ends and to the piece's stay anchors."""
    ends = rows.select(F.col("u").alias("a"), F.explode(F.array("start", "stop")).alias("b"))
    near = rows.select("sbs_id", "u").join(anchors.select("sbs_id", "segment"), "sbs_id").select("u", "segment")
    return ends.union(near).distinct()


def transition_risk(rows: DataFrame, edges: DataFrame, cfg: RiskConfig, bound: int = 29) -> DataFrame:
    """rows with their distances, three risks, risk_score and target_bucket. rows: transitions().

    endpoint: exp(-d/sigma) for the nearer of the piece's ends. stay: the same
    for the nearest anchor of a long stay, 0 where there is none. degree: one
    over the number of public successors. A segment without successors fails.
    """
    anchors = stay_anchors(rows, cfg.stay_seconds).select("sbs_id", "segment").distinct()
    hops = hop_distances(needed_pairs(rows, anchors), edges, bound)
    to = lambda other, name: hops.select(F.col("a").alias("u"), F.col("b").alias(other), F.col("hops").alias(name))
    stays = rows.select("sbs_id", "u").distinct().join(anchors, "sbs_id").join(to("segment", "h"), ["u", "segment"])
    nearest = stays.groupBy("sbs_id", "u").agg(F.min("h").alias("stay_min_distance"))
    counts = anchors.groupBy("sbs_id").agg(F.count("*").alias("num_stay_anchor_segments"))
    degree = domains(edges).groupBy("u").agg(F.max("d").alias("public_successor_domain_size"))
    out = rows.join(to("start", "endpoint_distance_start"), ["u", "start"], "left").join(to("stop", "endpoint_distance_end"), ["u", "stop"], "left")
    out = out.join(nearest, ["sbs_id", "u"], "left").join(counts, "sbs_id", "left").join(degree, "u", "left")
    near = lambda d, sigma: F.exp(-F.col(d) / sigma)
    fine = F.assert_true(F.col("public_successor_domain_size") > 0, F.lit("a segment has no public successor"))
    out = out.where(fine.isNull()).withColumns(
        {
            "risk_endpoint": F.greatest(near("endpoint_distance_start", cfg.sigma_e), near("endpoint_distance_end", cfg.sigma_e)),
            "risk_stay": F.coalesce(near("stay_min_distance", cfg.sigma_st), F.lit(0.0)),
            "risk_degree": 1 / F.col("public_successor_domain_size"),
            "num_stay_anchor_segments": F.coalesce("num_stay_anchor_segments", F.lit(0)),
        }
    )
    return rebucket(out, cfg)


def score(cfg: RiskConfig) -> Column:
    return clip01(cfg.lambda_e * F.col("risk_endpoint") + cfg.lambda_s * F.col("risk_stay") + cfg.lambda_d * F.col("risk_degree"))


def rebucket(risk: DataFrame, cfg: RiskConfig) -> DataFrame:
    """The rows scored and bucketed anew from their components, as for another set of weights."""
    return risk.withColumn("risk_score", score(cfg)).withColumn("target_bucket", threshold_bucket(F.col("risk_score"), cfg.thresholds))


def degree_bucket(degree: Column, buckets: int = 3, thresholds: tuple[int, ...] | None = None) -> Column:
    """A bucket from the out-degree alone: more successors, weaker protection."""
    if thresholds:
        out = F.lit(len(thresholds) + 1)
        for k in range(len(thresholds), 0, -1):
            out = F.when(degree <= thresholds[k - 1], k).otherwise(out)
        return F.least(out, F.lit(buckets))
    if buckets == 3:
        return F.when(degree <= 2, 1).when(degree == 3, 2).otherwise(3)
    return F.greatest(F.lit(1), F.least(F.lit(buckets), degree - 1)).cast("int")


def stored_bucket(stored: Column, score_: Column, thresholds) -> Column:
    """The stored bucket where it is one; 0 means 1; else the score's."""
    k = len(thresholds) + 1
    return F.when(stored.between(1, k), stored).when(stored == 0, 1).otherwise(threshold_bucket(score_, thresholds)).cast("int")


def bucket_summary(risk: DataFrame, buckets: int = 3) -> DataFrame:
    """A row for each bucket, empty ones too: count, share, means of score, components and gap (a null gap adds nothing)."""
    total = risk.agg(F.count("*").alias("total"))  # one row
    every = risk.sparkSession.range(1, buckets + 1).select(F.col("id").cast("int").alias("target_bucket"))
    means = {f"avg_{c}": F.round(F.coalesce(F.avg(c), F.lit(0.0)), 9) for c in ("risk_score", "risk_endpoint", "risk_stay", "risk_degree")}
    seen = risk.groupBy("target_bucket").agg(F.count("*").alias("n"), F.sum(F.coalesce("delta_t", F.lit(0.0))).alias("gap"), *(v.alias(k) for k, v in means.items()))
    rows = F.broadcast(every).join(seen, "target_bucket", "left").crossJoin(F.broadcast(total))  # one row against the few buckets
    n = F.coalesce("n", F.lit(0))
    return rows.select("target_bucket", n.alias("n"), F.round(n / F.greatest("total", F.lit(1)), 9).alias("fraction"), F.round(F.coalesce(F.col("gap") / F.greatest(n, F.lit(1)), F.lit(0.0)), 6).alias("avg_delta_t"), *(F.coalesce(k, F.lit(0.0)).alias(k) for k in means))


def prevalence(risk: DataFrame, cfg: RiskConfig, near: int = 1) -> DataFrame:
    """A row for each scope (all; branching: two or more successors): means, exact quantiles, long gaps, near ends, buckets, domain sizes, leading component of bucket 1."""
    size = F.col("public_successor_domain_size")
    scopes = risk.withColumn("scope", F.explode(F.when(size > 1, F.array(F.lit("all"), F.lit("branching"))).otherwise(F.array(F.lit("all")))))
    parts = [cfg.lambda_e * F.col("risk_endpoint"), cfg.lambda_s * F.col("risk_stay"), cfg.lambda_d * F.col("risk_degree")]
    top = F.greatest(*parts)
    wins = [F.abs(p - top) <= 1e-12 for p in parts]
    many = sum((w.cast("int") for w in wins[1:]), wins[0].cast("int"))
    high = F.col("target_bucket") == 1
    lead = {name: F.count_if(high & w & (many == 1)) for name, w in zip(("endpoint", "stay", "degree"), wins, strict=True)}
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 9)
    return scopes.groupBy("scope").agg(
        F.count("*").alias("n"),
        *(F.round(F.avg(c), 9).alias(f"mean_{c}") for c in ("risk_score", "risk_endpoint", "risk_stay", "risk_degree")),
        *(F.round(F.percentile("risk_score", q / 100), 9).alias(f"q{q}") for q in (10, 25, 50, 75, 90)),
        share(F.coalesce("delta_t", F.lit(0.0)) >= cfg.stay_seconds).alias("long_gap_share"),
        share((F.col("endpoint_distance_start") <= near) | (F.col("endpoint_distance_end") <= near)).alias("near_endpoint_share"),
        *(share(F.col("target_bucket") == k).alias(f"bucket_{k}_share") for k in range(1, cfg.buckets + 1)),
        *(F.count_if(size == k).alias(f"domain_{k}") for k in (1, 2, 3)),
        F.count_if(size >= 4).alias("domain_4_plus"),
        *(v.alias(f"lead_{k}") for k, v in lead.items()),
        F.count_if(high & (many > 1)).alias("lead_tie"),
    )
