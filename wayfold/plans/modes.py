"""Ways to run an experiment: attack, ablation, scaling by size and by length, and the audit before a release."""

from __future__ import annotations

import statistics
from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ExperimentConfig
from ..functions.columns import segment_length
from ..functions.tables import staged
from ..operators import audits, evaluate, randomize, schedule, sequences, summaries
from .experiment import Experiment, assert_fresh

#: What a scaling run times: map matching and synthesis are left out.
TIMED = ("split", "pieces", "transitions", "risk", "domain", "scheduled", "reports", "ends", "recovered")


def run_attack(run: Experiment) -> DataFrame:
    """evaluate.attack() of the test reports by an attacker who knows the training pairs."""
    rows = run.stage("reports").select("split", "u", "v", "y", "k_noisy")
    return evaluate.attack(rows.where("split = 'train'"), rows.where("split = 'test'"), run.stage("domain"))


def run_ablation(spark: SparkSession, sequences_: DataFrame, edges: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """metrics() with each component of the risk left out in turn, a row for each variant."""
    out: DataFrame | None = None
    shared: dict[str, DataFrame] = {}
    for name, c in cfg.ablations().items():
        run = Experiment(spark, sequences_, edges, c)
        run.tables |= shared
        row = staged(run.metrics().withColumn("variant", F.lit(name)), "ablation")
        shared |= {k: run.tables[k] for k in ("split", "pieces", "transitions", "domain")}
        out = row if out is None else out.unionByName(row)
    return out


def _timed(run: Experiment) -> dict:
    for name in TIMED:
        run.stage(name)
    assert_fresh(run.records, TIMED)
    n = run.stage("transitions").count()
    total = sum(run.seconds[s] for s in TIMED)
    return {"transitions": n, "seconds": total, "seconds_per_transition": total / max(1, n)} | {f"seconds_{s}": run.seconds[s] for s in TIMED}


def run_scaling(spark: SparkSession, sequences_: DataFrame, edges: DataFrame, cfg: ExperimentConfig, sizes: Iterable[int]) -> DataFrame:
    """A row for each size: sequences drawn by key, seconds of each stage, all made anew."""
    rows = []
    for size in sizes:
        some = staged(sequences.hash_sample(sequences_, "traj_id", size, cfg.seed), "sample")
        rows.append({"size": size, "sequences": some.count()} | _timed(Experiment(spark, some, edges, cfg)))
    return spark.createDataFrame(rows)  # a row for each size


def run_by_length(spark: SparkSession, sequences_: DataFrame, edges: DataFrame, cfg: ExperimentConfig, per_bin: int = 20_000, bins: int = 4, warmups: int = 1, repeats: int = 3, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """Scaling with the length of sequences: a row for each bin (mean and deviation of the repeats' seconds), and the line fitted to their means.

    All bins have the same number of sequences: per_bin, or what the smallest has.
    """
    binned = staged(evaluate.length_bins(sequences_.withColumn("n", segment_length(sequences_)), "n", bins), "binned")
    sizes = {r["bin"]: r["count"] for r in binned.groupBy("bin").count().collect()}  # a row for each bin
    equal = min(per_bin, *sizes.values())
    if equal < least:
        raise ValueError(f"a length bin has only {equal} sequences")
    picked = staged(sequences.bin_sample(binned, "bin", "traj_id", equal, cfg.seed), "picked")
    rows = []
    for b in sorted(sizes):
        part = picked.where(F.col("bin") == b)
        own = replace(cfg, dataset=replace(cfg.dataset, seed=cfg.dataset.seed + b))
        times = [_timed(Experiment(spark, part.select(*sequences_.columns), edges, own)) for _ in range(warmups + repeats)][warmups:]
        seconds = [t["seconds"] for t in times]
        mean = part.agg(F.avg("n")).head()[0]
        rows.append({"bin": b, "label": part.select("label").head()[0], "sequences": equal, "mean_length": mean, "transitions": times[0]["transitions"], "seconds_mean": statistics.mean(seconds), "seconds_std": statistics.stdev(seconds) if len(seconds) > 1 else 0.0})
    table = spark.createDataFrame(rows)
    return table, evaluate.line_fit(table, "mean_length", "seconds_mean")


def run_audit(run: Experiment) -> DataFrame:
    """Every gate of a run before its reports are released: stages, budget, reports, alignment. audits.require() fails on a hard one."""
    spark, p = run.spark, run.cfg.privacy
    rows = run.stage("transitions")
    illegal = sequences.legality(rows, run.edges)
    held = summaries.piece_statistics(run.stage("pieces")).where("split is not null").select("split", "min_coverage")
    wrong = rows.join(run.edges.select("u", "v").distinct(), ["u", "v"], "left_anti").groupBy("split").agg(F.count("*").alias("n_illegal"))
    splits = held.join(wrong, "split", "left").fillna(0, ["n_illegal"])
    without = {r["split"]: r["n"] for r in run.stage("risk").groupBy("split").agg(F.count_if(F.col("risk_score").isNull()).alias("n")).collect()}  # a row for each split
    gates = audits.upstream_gates(spark, splits, illegal.agg(F.coalesce(F.sum("n_illegal"), F.lit(0))).head()[0], without)
    reports, ends = run.stage("reports"), run.stage("ends")
    gates = gates.union(audits.report_gates(spark, "transition", randomize.report_audit(reports.select(*randomize.TRANSITION), run.edges, run.cfg.risk.buckets), rows.count()))
    gates = gates.union(audits.report_gates(spark, "start", randomize.start_audit(ends.select("split", F.col("start_noisy").alias("x_noisy")), run.edges), run.stage("pieces").count()))
    gates = gates.union(audits.report_gates(spark, "count", randomize.count_audit(ends.select("split", F.col("cnt_noisy").alias("x_noisy")), p.max_segments), run.stage("pieces").count()))
    a = audits.alignment(rows, run.stage("risk")).head()
    gates = gates.union(audits.gates(spark, [("events_and_risk_align", a["alone"] == 0 and a["different"] == 0, True, f"{a['alone']} alone, {a['different']} different")]))
    if run.method == "riskaware":
        spent = schedule.audit(run.stage("scheduled"), p).select((F.col("max_spend") - p.eps_start - p.eps_count).alias("most"))
        gates = gates.union(audits.budget_gates(spark, spent, p))
    return gates
