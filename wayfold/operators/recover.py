"""Estimates from noisy reports: closed forms of the inverse, all of them windows over small groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PrivacyConfig, RecoveryConfig
from ..functions.columns import keep_chance, other_chance


def simplex(rows: DataFrame, groups: list[str], value: str, key: str, out: str = "prob") -> DataFrame:
    """The nearest point of the probability simplex to each group's values."""
    order = Window.partitionBy(*groups).orderBy(F.desc(value), key)
    whole = Window.partitionBy(*groups)
    rows = rows.withColumns({"_c": F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_j": F.row_number().over(order)})
    rows = rows.withColumn("_theta", F.when(F.col(value) - (F.col("_c") - 1) / F.col("_j") > 0, F.struct("_j", ((F.col("_c") - 1) / F.col("_j")).alias("theta"))))
    rows = rows.withColumn("_top", F.max("_theta").over(whole)["theta"]).withColumn("_x", F.greatest(F.lit(0.0), F.col(value) - F.col("_top")))
    total = F.sum("_x").over(whole)
    return rows.withColumn(out, F.when(total > 0, F.col("_x") / total).otherwise(1 / F.count("*").over(whole))).drop("_c", "_j", "_theta", "_top", "_x")


def constrained_inverse(rows: DataFrame, groups: list[str], b: str, p: str, q: str, key: str, ridge: float = 1e-8, out: str = "prob") -> DataFrame:
    """Least squares for x >= 0 under a channel that keeps with p and else moves evenly (q each), then the simplex.

    rows has one row for each value of the domain in each group: b the observed
    share. With delta = p - q, beta = sum of b and values in falling order of b,
    the solution on the first s of them is in closed form; the last s whose own
    value stays positive is the support.
    """
    order = Window.partitionBy(*groups).orderBy(F.desc(b), key)
    whole = Window.partitionBy(*groups)
    rows = rows.withColumns({"_delta": F.col(p) - F.col(q), "_beta": F.sum(b).over(whole), "_b": F.sum(b).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_s": F.row_number().over(order)})
    delta, beta, s, qq = F.col("_delta"), F.col("_beta"), F.col("_s"), F.col(q)
    total = (delta * F.col("_b") + s * qq * beta) / (delta * delta + ridge + s * qq * (1 + delta))
    rows = rows.withColumn("_c", qq * (1 + delta) * total - qq * beta)
    rows = rows.withColumn("_last", F.max(F.when(delta * F.col(b) - F.col("_c") > 0, F.struct("_s", "_c"))).over(whole)["_c"])
    rows = rows.withColumn("_y", F.coalesce(F.greatest(F.lit(0.0), (delta * F.col(b) - F.col("_last")) / (delta * delta + ridge)), F.lit(0.0)))
    return simplex(rows.drop("_delta", "_beta", "_b", "_s", "_c", "_last"), groups, "_y", key, out).drop("_y")


def clipped_inverse(rows: DataFrame, groups: list[str], f: str, p: Column, q: Column, out: str = "prob") -> DataFrame:
    """(f - q) / (p - q) where that is positive, scaled to sum to 1; where none is, the shares f themselves."""
    whole = Window.partitionBy(*groups)
    raw = F.when(F.abs(p - q) > 1e-15, (F.col(f) - q) / (p - q)).otherwise(F.col(f))
    rows = rows.withColumn("_x", F.greatest(F.lit(0.0), raw))
    total, shares = F.sum("_x").over(whole), F.sum(f).over(whole)
    return rows.withColumn(out, F.when(total > 0, F.col("_x") / total).otherwise(F.when(shares > 0, F.col(f) / shares))).drop("_x")


def recover_start(reports: DataFrame, domain_size: int, eps: float) -> DataFrame:
    """split, value, prob: only reported values can have mass, so the domain is never spread out."""
    seen = reports.groupBy("split", F.col("x_noisy").alias("value")).agg(F.count("*").alias("n"))
    seen = seen.withColumn("f", F.col("n") / F.sum("n").over(Window.partitionBy("split")))
    e, d = F.lit(eps), F.lit(domain_size)
    return clipped_inverse(seen, ["split"], "f", keep_chance(e, d), other_chance(e, d)).where("prob > 0").select("split", "value", "prob")


def _over_counts(reports: DataFrame, most: int) -> DataFrame:
    every = reports.select("split").distinct().select("split", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("value"))
    seen = reports.groupBy("split", F.col("x_noisy").alias("value")).agg(F.count("*").alias("n"))
    rows = every.join(seen, ["split", "value"], "left").fillna(0, ["n"])
    return rows.withColumn("f", F.col("n") / F.sum("n").over(Window.partitionBy("split")))


def recover_count(reports: DataFrame, cfg: PrivacyConfig, method: str = "constrained", ridge: float = 1e-8) -> DataFrame:
    """split, value, prob over 1..max_segments; `constrained` or `clipped` inverse."""
    rows = _over_counts(reports, cfg.max_segments)
    e, d = F.lit(cfg.eps_count), F.lit(cfg.max_segments)
    if method == "clipped":
        return clipped_inverse(rows, ["split"], "f", keep_chance(e, d), other_chance(e, d)).select("split", "value", "prob")
    rows = rows.withColumns({"p": keep_chance(e, d), "q": other_chance(e, d)})
    return constrained_inverse(rows, ["split"], "f", "p", "q", "value", ridge).select("split", "value", "prob")


def bucket_mix(reports: DataFrame, cfg: PrivacyConfig, rec: RecoveryConfig) -> DataFrame:
    """split, u, k, pi_local, pi_global, alpha, pi: bucket shares of each context, drawn to the split's where reports are few."""
    buckets = len(cfg.eps_event)
    ks = F.explode(F.sequence(F.lit(1), F.lit(buckets))).alias("k")
    e, d = F.lit(cfg.eps_bucket), F.lit(buckets)

    def solve(groups):
        seen = reports.groupBy(*groups, F.col("k_noisy").alias("k")).agg(F.count("*").alias("n"))
        rows = reports.select(*groups).distinct().select(*groups, ks).join(seen, [*groups, "k"], "left").fillna(0, ["n"])
        total = F.sum("n").over(Window.partitionBy(*groups))
        rows = rows.withColumns({"f": F.col("n") / total, "num_reports": total, "p": keep_chance(e, d), "q": other_chance(e, d)})
        return constrained_inverse(rows, groups, "f", "p", "q", "k", rec.ridge)

    local = solve(["split", "u"]).select("split", "u", "k", "num_reports", F.col("prob").alias("pi_local"))
    over = solve(["split"]).select("split", "k", F.col("prob").alias("pi_global"))
    both = local.join(F.broadcast(over), ["split", "k"])  # a row for each split and bucket
    alpha = F.col("num_reports") / (F.col("num_reports") + rec.tau)
    both = both.withColumn("alpha", alpha).withColumn("_m", alpha * F.col("pi_local") + (1 - alpha) * F.col("pi_global"))
    return both.withColumn("pi", F.col("_m") / F.sum("_m").over(Window.partitionBy("split", "u"))).drop("_m")


def recover_context(reports: DataFrame, domain: DataFrame, cfg: PrivacyConfig, rec: RecoveryConfig) -> DataFrame:
    """split, u, v, prob, num_reports, domain_size, pbar, qbar: each context's channel is the mix of its buckets' channels.

    A report outside the domain counts in num_reports and has no value of its own.
    """
    mix = bucket_mix(reports, cfg, rec)
    d = domain.groupBy("u").agg(F.max("d").alias("d"))
    eps = F.element_at(F.array(*map(F.lit, cfg.eps_event)), F.col("k"))
    channel = mix.join(d, "u").groupBy("split", "u", "d").agg(
        F.sum(F.col("pi") * keep_chance(eps, F.col("d"))).alias("p"), F.sum(F.col("pi") * other_chance(eps, F.col("d"))).alias("q"), F.max("num_reports").alias("num_reports")
    )
    seen = reports.groupBy("split", "u", F.col("y").alias("v")).agg(F.count("*").alias("n"))
    rows = channel.join(domain.select("u", "v"), "u").join(seen, ["split", "u", "v"], "left").fillna(0, ["n"])
    rows = rows.withColumn("b", F.col("n") / F.col("num_reports"))
    out = constrained_inverse(rows, ["split", "u"], "b", "p", "q", "v", rec.ridge)
    return out.select("split", "u", "v", "prob", "num_reports", F.col("d").alias("domain_size"), F.col("p").alias("pbar"), F.col("q").alias("qbar"))


def recover_uniform(reports: DataFrame, domain: DataFrame, eps: float) -> DataFrame:
    """split, u, v, prob, num_reports: the clipped inverse over each context's domain with one epsilon."""
    seen = reports.groupBy("split", "u", F.col("y").alias("v")).agg(F.count("*").alias("n"))
    rows = reports.select("split", "u").distinct().join(domain.select("u", "v", "d"), "u").join(seen, ["split", "u", "v"], "left").fillna(0, ["n"])
    rows = rows.withColumn("num_reports", F.sum("n").over(Window.partitionBy("split", "u"))).withColumn("f", F.col("n") / F.col("num_reports"))
    e, d = F.lit(eps), F.col("d")
    return clipped_inverse(rows, ["split", "u"], "f", keep_chance(e, d), other_chance(e, d)).select("split", "u", "v", F.coalesce("prob", F.lit(0.0)).alias("prob"), "num_reports")


def channel(d: int, eps_event, eps_bucket: float) -> np.ndarray:
    """A[(y, k~), (v, k)]: chance to report (y, k~) of a transition to v in bucket k."""
    from ..config import grr_parameters

    buckets = len(eps_event)
    p, q = grr_parameters(eps_bucket, buckets)
    labels = np.full((buckets, buckets), q) + (p - q) * np.eye(buckets)
    out = np.zeros((d, buckets, d, buckets))
    for k, eps in enumerate(eps_event):
        p, q = grr_parameters(eps, d)
        out[:, :, :, k] = (np.full((d, d), q) + (p - q) * np.eye(d))[:, None, :] * labels[:, k][None, :, None]
    return out.reshape(d * buckets, d * buckets)


def nnls(a: np.ndarray, b: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Least squares for x >= 0 by active sets; ridge adds ridge * |x|^2."""
    n = a.shape[1]
    gram, right = a.T @ a + ridge * np.eye(n), a.T @ b
    x, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(30 * n):
        slope = right - gram @ x
        slope[active] = -np.inf
        k = int(slope.argmax())
        if slope[k] <= 1e-12:
            break
        active[k] = True
        while True:
            at = np.flatnonzero(active)
            z = np.zeros(n)
            z[at] = np.linalg.lstsq(gram[np.ix_(at, at)], right[at], rcond=None)[0]
            if (z[at] > 0).all():
                x = z
                break
            low = at[z[at] <= 0]
            step = float((x[low] / np.maximum(x[low] - z[low], 1e-300)).min())
            x = x + step * (z - x)
            active[at[x[at] <= 1e-15]] = False
            x[~active] = 0
    return x


def project(x: np.ndarray) -> np.ndarray:
    falling = np.sort(x)[::-1]
    over = (np.cumsum(falling) - 1) / np.arange(1, len(x) + 1)
    good = np.flatnonzero(falling - over > 0)
    out = np.maximum(0, x - over[good[-1]]) if len(good) else np.zeros_like(x)
    return out / out.sum() if out.sum() > 0 else np.full(len(x), 1 / len(x))


JOINT = "split string, u string, v string, k int, prob double, residual double, condition double, source string"


def recover_joint(reports: DataFrame, domain: DataFrame, cfg: PrivacyConfig, rec: RecoveryConfig, mode: str = "latent") -> DataFrame:
    """split, u, v, k, prob, residual, condition, source: successor and bucket together, for each context by itself.

    latent: constrained least squares and the simplex, for contexts with
    joint_min_reports or more (joint_marginals() has the others too). mass: a
    heavy row asks for a sum of 1 instead, and every context is solved; one
    successor alone takes all, and where nothing is left the clipped inverse of
    the successors' shares at the first epsilon stands, spread evenly over the
    buckets. residual is the norm of what is left, condition the channel's.
    """
    buckets = len(cfg.eps_event)
    lists = domain.groupBy("u").agg(F.array_sort(F.collect_list("v")).alias("domain"))
    counts = reports.groupBy("split", "u", "y", "k_noisy").agg(F.count("*").alias("n"))  # few rows for each context
    if mode == "latent":
        enough = reports.groupBy("split", "u").agg(F.count("*").alias("total")).where(F.col("total") >= rec.joint_min_reports)
        counts = counts.join(enough.select("split", "u"), ["split", "u"], "left_semi")
    rows = counts.join(lists, "u")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = list(pdf["domain"].iloc[0])
        d = len(names)
        b = np.zeros((d, buckets))
        for y, k, n in zip(pdf["y"], pdf["k_noisy"], pdf["n"], strict=True):
            b[names.index(y), k - 1] = n
        b = b.ravel() / pdf["n"].sum()
        a = channel(d, cfg.eps_event, cfg.eps_bucket)
        source = mode
        if mode == "latent":
            x = nnls(a, b, rec.ridge)
            residual = float(np.linalg.norm(a @ x - b))
            x = project(x)
        elif d == 1:
            x, residual, source = np.full(buckets, 1 / buckets), 0.0, "single"
        else:
            weight = max(1.0, rec.mass_weight)
            whole, right = np.vstack([a, np.full((1, d * buckets), weight)]), np.r_[b, weight]
            x = nnls(whole, right)
            residual = float(np.linalg.norm(whole @ x - right))
            if x.sum() > 1e-15:
                x = x / x.sum()
            else:
                x, source = np.repeat(clipped_shares(b.reshape(d, buckets).sum(1), cfg.eps_event[0]), buckets) / buckets, "fallback"
        made = {"split": pdf["split"].iloc[0], "u": pdf["u"].iloc[0], "v": np.repeat(names, buckets), "k": np.tile(np.arange(1, buckets + 1), d).astype("int32"), "prob": x}
        return pd.DataFrame(made | {"residual": residual, "condition": float(np.linalg.cond(a)), "source": source})

    return rows.groupBy("split", "u").applyInPandas(solve, JOINT)


def clipped_shares(f: np.ndarray, eps: float) -> np.ndarray:
    """clipped_inverse() of one context's shares."""
    from ..config import grr_parameters

    p, q = grr_parameters(eps, len(f))
    x = np.maximum(0, (f - q) / (p - q) if abs(p - q) > 1e-15 else f)
    return x / x.sum() if x.sum() > 0 else f / f.sum()


def joint_marginals(reports: DataFrame, domain: DataFrame, cfg: PrivacyConfig, rec: RecoveryConfig) -> DataFrame:
    """split, u, v, prob, num_reports, domain_size, source: the joint recovery's successors; contexts with too few reports keep recover_context()'s."""
    joint = recover_joint(reports, domain, cfg, rec)
    found = joint.groupBy("split", "u", "v").agg(F.sum("prob").alias("joint"))
    rows = recover_context(reports, domain, cfg, rec).join(found, ["split", "u", "v"], "left")
    enough = F.col("num_reports") >= rec.joint_min_reports
    return rows.select("split", "u", "v", F.when(enough, F.coalesce("joint", F.lit(0.0))).otherwise(F.col("prob")).alias("prob"), "num_reports", "domain_size", F.when(enough, "joint").otherwise("context").alias("source"))


def bucket_marginals(joint: DataFrame) -> DataFrame:
    """split, u, k, prob: the latent buckets of recover_joint()."""
    return joint.groupBy("split", "u", "k").agg(F.sum("prob").alias("prob"))


def merged(dists: DataFrame, keys: list[str]) -> DataFrame:
    """Distributions of several splits as one, weighted by their reports (1 at least); keys name a context (or none) and the value last."""
    *context, value = keys
    w = F.greatest(F.col("num_reports"), F.lit(1))
    rows = dists.groupBy(*keys).agg(F.sum(F.col("prob") * w).alias("_m"))
    whole = Window.partitionBy(*context)
    return rows.withColumn("prob", F.col("_m") / F.sum("_m").over(whole)).where("prob > 0").drop("_m")
