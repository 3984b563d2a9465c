"""Utility, dependence and attack metrics, and statistics over experiments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(rows: DataFrame, value: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """Shares of the values, within groups if there are any."""
    counts = rows.groupBy(*groups, value).agg(F.count("*").alias("n"))
    return counts.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy(*groups)))


def bigrams(rows: DataFrame, items: str = "segments") -> DataFrame:
    """a, b: every pair of neighbours."""
    n = F.size(items)
    pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.get(items, i).alias("a"), F.get(items, i + 1).alias("b")))
    return rows.where(n >= 2).select(F.explode_outer(pairs).alias("x")).select("x.*")


def transition_distribution(rows: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """u, v, n, n_u, prob: the conditional distribution of the successor, with its context's count."""
    counts = rows.groupBy(*groups, "u", "v").agg(F.count("*").alias("n"))
    n_u = F.sum("n").over(Window.partitionBy(*groups, "u"))
    return counts.withColumn("n_u", n_u).withColumn("prob", F.col("n") / F.col("n_u"))


def _terms(p: Column, q: Column) -> Column:
    m = (p + q) / 2
    half = lambda x: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)
    return (half(p) + half(q)) / 2


def joined(p: DataFrame, q: DataFrame, keys: list[str]) -> DataFrame:
    """p and q side by side over all keys of either; what one lacks is 0."""
    a, b = p.select(*keys, F.col("prob").alias("p")), q.select(*keys, F.col("prob").alias("q"))
    return a.join(b, keys, "full_outer").fillna(0.0, ["p", "q"])


def js_divergence(p: DataFrame, q: DataFrame, keys: list[str]) -> DataFrame:
    """One row: Jensen-Shannon divergence in nats of two distributions, clipped at 0 and scaled to 1 each."""
    rows = joined(p, q, keys).withColumns({"p": F.greatest("p", F.lit(0.0)), "q": F.greatest("q", F.lit(0.0))})
    sums = rows.agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))  # one row
    rows = rows.crossJoin(F.broadcast(sums))
    of = lambda x, s: F.when(F.col(s) > 0, F.col(x) / F.col(s)).otherwise(0.0)
    return rows.agg(F.coalesce(F.sum(_terms(of("p", "sp"), of("q", "sq"))), F.lit(0.0)).alias("js"))


def transition_js(truth: DataFrame, recovered: DataFrame) -> DataFrame:
    """One row: divergence of each context's distribution, weighted by its true count; a context that was not recovered adds half of ln 2."""
    own = recovered.select("u").distinct().withColumn("known", F.lit(True))
    rows = joined(truth, recovered, ["u", "v"]).join(truth.groupBy("u").agg(F.max("n_u").alias("n_u")), "u").join(own, "u", "left")
    each = rows.groupBy("u").agg(F.max("n_u").alias("n_u"), F.sum(_terms(F.col("p"), F.col("q"))).alias("js"), F.max("known").alias("known"))
    value = F.when(F.col("known"), F.col("js")).otherwise(0.5 * math.log(2))
    return each.agg((F.sum(value * F.col("n_u")) / F.sum("n_u")).alias("transition_js"))


def total_variation(p: DataFrame, q: DataFrame, keys: list[str], groups: tuple[str, ...] = ()) -> DataFrame:
    """tv of two distributions, by group if there are any."""
    return joined(p, q, [*groups, *keys]).groupBy(*groups).agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("tv"))


def recovery_error(truth: DataFrame, recovered: DataFrame) -> DataFrame:
    """One row: contexts, those recovered, and the variation weighted by N_u / N; a context that is missing is skipped and its weight is lost."""
    known = recovered.select("u").distinct()
    each = total_variation(truth.join(known, "u", "left_semi"), recovered, ["v"], ("u",)).join(truth.groupBy("u").agg(F.max("n_u").alias("n_u")), "u", "right")
    n = F.sum("n_u")
    return each.agg(F.count("*").alias("contexts"), F.count("tv").alias("recovered"), (F.sum(F.coalesce(F.col("tv") * F.col("n_u"), F.lit(0.0))) / n).alias("weighted_tv"), F.coalesce(F.max("tv"), F.lit(0.0)).alias("max_tv"))


def legal_ratio(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the share of pairs (a, b) that are edges; 1 where there are none."""
    legal = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).distinct().withColumn("ok", F.lit(1.0))
    return pairs.join(legal, ["a", "b"], "left").agg(F.coalesce(F.avg(F.coalesce("ok", F.lit(0.0))), F.lit(1.0)).alias("legal_ratio"))


def conditional_dependence(rows: DataFrame) -> DataFrame:
    """One row: mutual information of bucket and successor given the segment (nats, bits), the mean and greatest variation from independence and where.

    rows: u, v, k. Joint and product are compared over each context's full grid of values.
    """
    cells = rows.groupBy("u", "v", "k").agg(F.count("*").alias("n"))
    vs, ks = cells.groupBy("u", "v").agg(F.sum("n").alias("n_v")), cells.groupBy("u", "k").agg(F.sum("n").alias("n_k"))
    totals = cells.groupBy("u").agg(F.sum("n").alias("n_u"))
    grid = vs.join(ks, "u").join(totals, "u").join(cells, ["u", "v", "k"], "left").fillna(0, ["n"])
    pj, pp = F.col("n") / F.col("n_u"), F.col("n_v") * F.col("n_k") / (F.col("n_u") * F.col("n_u"))
    each = grid.groupBy("u").agg(F.max("n_u").alias("n_u"), F.sum(F.when(pj > 0, pj * F.log(pj / pp)).otherwise(0.0)).alias("mi"), (F.sum(F.abs(pj - pp)) / 2).alias("tv"))
    mean = lambda c: F.sum(F.col(c) * F.col("n_u")) / F.sum("n_u")
    return each.agg(mean("mi").alias("mi_nats"), (mean("mi") / math.log(2)).alias("mi_bits"), mean("tv").alias("weighted_tv"), F.max("tv").alias("max_tv"), F.max_by("u", F.struct(F.round("tv", 12), "u")).alias("max_tv_u"))


def attack(train: DataFrame, test: DataFrame, domain: DataFrame, mass: float = 5.0, support: int = 3) -> DataFrame:
    """How well an attacker who knows training pairs of (u, v, y, k_noisy) guesses v of the test rows; a row for scopes all and branching.

    The prior of a context is smoothed by 1 over its domain. Where (u, y) has
    enough support, its counts are drawn to the prior with `mass`; where
    (u, y, k) has, its counts are drawn to that in turn. The first value in the
    domain's order wins a tie.
    """
    dom = domain.select("u", "v", "pos", "d")
    whole = lambda *keys: Window.partitionBy(*keys)
    c_u = train.groupBy("u", "v").agg(F.count("*").alias("c"))
    prior = dom.join(c_u, ["u", "v"], "left").withColumn("x", F.coalesce("c", F.lit(0)) + F.lit(1.0))
    prior = prior.withColumn("prior", F.col("x") / F.sum("x").over(whole("u"))).select("u", "v", "pos", "d", "prior")
    seen = test.select("u", "y", "k_noisy").distinct()
    grid = seen.join(prior, "u")
    c_uy = train.groupBy("u", "y", "v").agg(F.count("*").alias("c_uy"))
    c_uyk = train.groupBy("u", "y", "k_noisy", "v").agg(F.count("*").alias("c_uyk"))
    grid = grid.join(c_uy, ["u", "y", "v"], "left").join(c_uyk, ["u", "y", "k_noisy", "v"], "left").fillna(0, ["c_uy", "c_uyk"])
    own = whole("u", "y", "k_noisy")
    grid = grid.withColumns({"n_uy": F.sum("c_uy").over(own), "n_uyk": F.sum("c_uyk").over(own)})
    shrink = lambda c, n, back: (F.col(c) + mass * F.col(back)) / (F.col(n) + mass)
    grid = grid.withColumn("p_uy", F.when(F.col("n_uy") >= support, shrink("c_uy", "n_uy", "prior")).otherwise(F.col("prior")))
    grid = grid.withColumn("p", F.when(F.col("n_uyk") >= support, shrink("c_uyk", "n_uyk", "p_uy")).otherwise(F.col("p_uy")))
    grid = grid.withColumns({"level": F.when(F.col("n_uyk") >= support, 3).when(F.col("n_uy") >= support, 2).otherwise(1), "local": F.when(F.col("n_uyk") >= support, F.col("n_uyk")).otherwise(F.col("n_uy"))})
    best = lambda c: F.struct(F.round(c, 12), -F.col("pos"))
    stats = grid.groupBy("u", "y", "k_noisy").agg(
        F.max_by("v", best("prior")).alias("prior_guess"), F.max_by("v", best("p")).alias("guess"), (-F.sum(F.col("p") * F.log("p"))).alias("entropy"), F.max("d").alias("d"), F.max("level").alias("level"), F.max("local").alias("local")
    )
    rows = test.join(stats, ["u", "y", "k_noisy"]).join(grid.select("u", "y", "k_noisy", "v", "p"), ["u", "y", "k_noisy", "v"])
    rows = rows.withColumn("scope", F.explode(F.when(F.col("d") > 1, F.array(F.lit("all"), F.lit("branching"))).otherwise(F.array(F.lit("all")))))
    right = lambda c: F.avg((F.col(c) == F.col("v")).cast("double"))
    norm = F.when(F.col("d") > 1, F.col("entropy") / F.log(F.col("d").cast("double"))).otherwise(0.0)
    return rows.groupBy("scope").agg(
        F.count("*").alias("n"),
        right("prior_guess").alias("prior_top1"),
        right("guess").alias("posterior_top1"),
        (right("guess") - right("prior_guess")).alias("advantage"),
        F.avg("entropy").alias("entropy"),
        F.avg(norm).alias("normalized_entropy"),
        F.avg(-F.log(F.greatest(F.col("p"), F.lit(1e-15)))).alias("nll"),
        F.avg("p").alias("p_true"),
        F.avg("local").alias("support"),
        *(F.count_if(F.col("level") == k).alias(f"level_{name}") for k, name in ((1, "u"), (2, "uy"), (3, "uyk"))),
    )


def seed_statistics(rows: DataFrame, metrics: list[str], keys: tuple[str, ...] = ("dataset", "profile", "method"), min_seeds: int = 1) -> DataFrame:
    """Mean, sample deviation (0 for one), least and greatest of each metric by key, for groups with enough distinct seeds."""
    aggs = [f(c).alias(f"{c}_{name}") for c in metrics for name, f in (("mean", F.avg), ("std", lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))), ("min", F.min), ("max", F.max))]
    return rows.groupBy(*keys).agg(F.count_distinct("seed").alias("seeds"), *aggs).where(F.col("seeds") >= min_seeds)


def line_fit(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: least-squares slope, intercept and r2; r2 is 1 for a constant y, all null for a constant x."""
    sxx, syy, sxy = F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x)
    fit = rows.agg(sxx.alias("sxx"), syy.alias("syy"), sxy.alias("sxy"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    ok = F.col("sxx") > 0
    slope = F.col("sxy") / F.col("sxx")
    r2 = F.when(F.col("syy") == 0, 1.0).otherwise(F.col("sxy") * F.col("sxy") / (F.col("sxx") * F.col("syy")))
    return fit.select(F.when(ok, slope).alias("slope"), F.when(ok, F.col("my") - slope * F.col("mx")).alias("intercept"), F.when(ok, r2).alias("r2"))


def length_bins(rows: DataFrame, length: str, bins: int = 4) -> DataFrame:
    """rows with bin (from 0) and label; edges are nearest-rank quantiles, each once."""
    qs = F.expr("array(" + ", ".join(f"percentile_disc({k / bins}) WITHIN GROUP (ORDER BY {length})" for k in range(1, bins)) + ")")
    edges = rows.agg(F.array_sort(F.array_distinct(qs.cast("array<bigint>"))).alias("edges"), F.max(length).alias("most"))  # one row
    out = rows.crossJoin(F.broadcast(edges))
    bin_ = F.size(F.filter("edges", lambda e: e < F.col(length)))
    low = F.when(bin_ == 0, F.lit(None)).otherwise(F.get("edges", bin_ - 1))
    high = F.coalesce(F.get("edges", bin_), F.col("most"))
    return out.withColumns({"bin": bin_, "label": F.concat(F.coalesce(low + 1, F.lit(0)).cast("string"), F.lit("-"), high.cast("string"))}).drop("edges", "most")
