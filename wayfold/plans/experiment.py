"""Whole experiments: the stages in order, each a function over tables that are stored and used again."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ExperimentConfig
from ..functions.tables import finished, kept, staged
from ..operators import evaluate as E
from ..operators import graph, randomize, recover, risk, schedule, sequences, synthesis

METHODS = ("riskaware", "uniform", "degree")
#: Stages that do not depend on the method, profile and seed.
SHARED = ("split", "pieces", "transitions", "risk", "domain")
#: What a stage's record says.
DONE, REUSED = "DONE", "SKIPPED_EXISTING"
#: What the seed of the synthetic walks adds to the experiment's, by method (fixed values).
SYNTHESIS_SEEDS = {"riskaware": 7001, "uniform": 107004, "degree": 97001}


@dataclass
class Experiment:
    """A run over sequences (traj_id, segments, segment_times) on a public graph (u, v); stages are made once and kept as tables.

    With a root, tables get places of their own below it, and a later run with
    the same settings reads those that are whole. skip_invalid leaves out rows
    that are no sequences; else they fail the run.
    """

    spark: SparkSession
    sequences: DataFrame
    edges: DataFrame
    cfg: ExperimentConfig
    seconds: dict[str, float] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    method: str = "riskaware"
    root: str | None = None
    skip_invalid: bool = False
    records: list[dict] = field(default_factory=list)

    def place(self, name: str) -> str:
        own = "shared" if name in SHARED else f"{self.cfg.profile}_seed{self.cfg.seed}_{self.method}"
        return f"{self.root.rstrip('/')}/{self.cfg.dataset.variant}/{own}/{name}"

    def stage(self, name: str) -> DataFrame:
        if name not in self.tables:
            before = time.perf_counter()
            status = DONE
            if self.root and finished(self.spark, self.place(name)):
                self.tables[name], status = self.spark.read.parquet(self.place(name)), REUSED
            else:
                made = getattr(self, f"_{name}")()
                self.tables[name] = kept(made, self.place(name)) if self.root else staged(made, name)
            self.seconds[name] = time.perf_counter() - before
            self.records.append({"stage": name, "status": status, "seconds": self.seconds[name]})
        return self.tables[name]

    def _split(self) -> DataFrame:
        return sequences.split_of(sequences.checked(self.sequences, self.skip_invalid), "traj_id", self.cfg.dataset.ratios, self.cfg.dataset.seed)

    def _pieces(self) -> DataFrame:
        return sequences.pieces(self.stage("split"), self.cfg.privacy.max_segments)

    def _transitions(self) -> DataFrame:
        rows = sequences.assert_ordered(sequences.transitions(self.stage("pieces")))
        bad = sequences.legality(rows, self.edges).where("n_illegal > 0").limit(1).count()
        if bad:
            raise ValueError("a transition is no public edge")
        return rows

    def _risk(self) -> DataFrame:
        return risk.transition_risk(self.stage("transitions"), self.edges, self.cfg.risk, self.cfg.privacy.max_segments - 1)

    def _scheduled(self) -> DataFrame:
        rows = self.stage("risk")
        if self.method == "degree":
            rows = rows.withColumn("target_bucket", risk.degree_bucket(F.col("public_successor_domain_size"), self.cfg.risk.buckets))
        if self.method == "uniform":
            k = F.lit(self.cfg.privacy.uniform_bucket)
            return rows.select("split", "sbs_id", "t", "u", "v", "target_bucket", k.alias("exec_bucket"))
        return schedule.schedule(rows, self.cfg.privacy, ["split", "u", "v"])

    def _reports(self) -> DataFrame:
        p = self.cfg.privacy
        eps = F.lit(p.uniform) if self.method == "uniform" else randomize.event_epsilon(F.col("exec_bucket"), p)
        return randomize.successors(self.stage("scheduled"), self.edges, p, self.method, eps, F.col("exec_bucket"), self.cfg.seed)

    def _ends(self) -> DataFrame:
        return randomize.start_and_count(self.stage("pieces"), self.edges, self.cfg.privacy, self.method, self.cfg.seed)

    def _domain(self) -> DataFrame:
        return graph.domains(self.edges)

    def _recovered(self) -> DataFrame:
        visible = self.stage("reports").select(*randomize.TRANSITION)
        if self.method == "uniform":
            return recover.recover_uniform(visible, self.stage("domain"), self.cfg.privacy.uniform)
        if self.method == "degree":
            joint = recover.recover_joint(visible, self.stage("domain"), self.cfg.privacy, self.cfg.recovery, "mass")
            n = visible.groupBy("split", "u").agg(F.count("*").alias("num_reports"))
            return joint.groupBy("split", "u", "v").agg(F.sum("prob").alias("prob")).join(n, ["split", "u"])
        return recover.recover_context(visible, self.stage("domain"), self.cfg.privacy, self.cfg.recovery)

    def _synthetic(self) -> DataFrame:
        """As many walks as the test split has pieces, from the recoveries of the other splits."""
        use = F.col("split").isin(*self.cfg.synthesis_splits)
        found = self.stage("recovered").where(use)
        trans = recover.merged(found, ["u", "v"])
        prior = synthesis.global_prior(found)
        options = synthesis.candidates(trans, self.stage("domain"), prior)
        ends = self.stage("ends").where(use)
        size = self.stage("domain").select("u").distinct().count()
        weigh = lambda df, n: recover.merged(df.join(n, "split"), ["value"])
        n = ends.groupBy("split").agg(F.count("*").alias("num_reports"))
        start = weigh(recover.recover_start(ends.select("split", F.col("start_noisy").alias("x_noisy")), size, self.cfg.privacy.eps_start), n)
        method = "constrained" if self.method == "riskaware" else "clipped"
        count = weigh(recover.recover_count(ends.select("split", F.col("cnt_noisy").alias("x_noisy")), self.cfg.privacy, method), n)
        rows = self.stage("pieces").where("split = 'test'").count()
        return synthesis.walks(rows, start, count, options, self.cfg.privacy.max_segments, self.cfg.seed + SYNTHESIS_SEEDS[self.method], self.spark)

    def metrics(self) -> DataFrame:
        """One row: keep rate, recovery error, divergences of lengths, bigrams and transitions, legality of the synthetic walks."""
        test = self.stage("transitions").where("split = 'test'")
        truth = E.transition_distribution(test)
        found = recover.merged(self.stage("recovered").where(F.col("split").isin(*self.cfg.synthesis_splits)), ["u", "v"])
        syn, real = self.stage("synthetic"), self.stage("pieces").where("split = 'test'")
        length = lambda df: E.distribution(df.select(F.size("segments").alias("value")), "value")
        pairs = lambda df: E.bigrams(df)
        two = lambda df: df.groupBy("a", "b").agg(F.count("*").cast("double").alias("prob"))
        parts = [
            self.stage("reports").agg(F.avg("keep_flag").alias("keep_rate")),
            E.recovery_error(truth, found).select("weighted_tv"),
            E.transition_js(truth, found),
            E.js_divergence(length(real), length(syn), ["value"]).toDF("length_js"),
            E.js_divergence(two(pairs(real)), two(pairs(syn)), ["a", "b"]).toDF("bigram_js"),
            E.legal_ratio(pairs(syn), self.edges),
            syn.agg(F.count("*").alias("walks"), F.avg("early_stop").alias("early_stops")),
        ]
        out = parts[0]
        for part in parts[1:]:  # one row each
            out = out.crossJoin(F.broadcast(part))
        return out.select(F.lit(self.method).alias("method"), F.lit(self.cfg.profile).alias("profile"), F.lit(self.cfg.seed).alias("seed"), "*")


    def comparison(self) -> dict:
        """The run's row of the main table; a synthetic walk off the graph, or another number of walks than the test split has pieces, fails."""
        reports, syn = self.stage("reports"), self.stage("synthetic")
        m = self.metrics().head()
        high = reports.where("split = 'test' and target_bucket = 1").agg(F.coalesce(F.avg("keep_flag"), F.lit(0.0))).head()[0]
        overall = reports.where("split = 'test'").agg(F.coalesce(F.avg("keep_flag"), F.lit(0.0))).head()[0]
        exact = syn.agg(F.avg((F.size("segments") == F.col("target_count")).cast("int"))).head()[0]
        wanted = self.stage("pieces").where("split = 'test'").count()
        row = {
            "method": self.method, "high_risk_keep_rate": high, "keep_rate_overall": overall, "transition_js": m["transition_js"], "synthetic_bigram_js": m["bigram_js"],
            "synthetic_count_js": m["length_js"], "public_legal_ratio": m["legal_ratio"], "exact_count_rate": exact, "early_stop_rate": m["early_stops"],
            "num_synthetic_trajectories": m["walks"], "transition_recovery_component": "transition_joint" if self.method == "degree" else "transition_context",
        }
        if row["public_legal_ratio"] < 1 - 1e-12:
            raise AssertionError(f"{self.method}: a synthetic walk leaves the public graph")
        if row["num_synthetic_trajectories"] != wanted:
            raise AssertionError(f"{self.method}: {row['num_synthetic_trajectories']} walks for {wanted} pieces")
        return row


def assert_fresh(records: list[dict], stages: tuple[str, ...]) -> None:
    """Raise unless each of the stages has a record and none was read from an earlier run, so that its seconds are its own."""
    by_stage: dict[str, set[str]] = {}
    for r in records:
        by_stage.setdefault(r["stage"], set()).add(r["status"])
    bad = [f"{s}: no record" for s in stages if s not in by_stage]
    bad += [f"{s}: {', '.join(sorted(by_stage[s]))}" for s in stages if s in by_stage and (REUSED in by_stage[s] or DONE not in by_stage[s])]
    if bad:
        raise AssertionError("not fresh: " + "; ".join(bad))


def compare(spark: SparkSession, sequences_: DataFrame, edges: DataFrame, cfg: ExperimentConfig, methods=METHODS, root: str | None = None) -> DataFrame:
    """The main table, a row for each method, with its checks."""
    shared: dict[str, DataFrame] = {}
    rows = []
    for method in methods:
        run = Experiment(spark, sequences_, edges, cfg, method=method, root=root)
        run.tables |= shared
        rows.append(run.comparison())
        shared |= {k: run.tables[k] for k in SHARED if k in run.tables}
    return spark.createDataFrame(rows)  # a row for each method


def run_grid(spark: SparkSession, sequences_: DataFrame, edges: DataFrame, cfg: ExperimentConfig, profiles, seeds, methods=METHODS) -> DataFrame:
    """The metrics of every profile, seed and method; stages that do not depend on them are made once."""
    shared: dict[str, DataFrame] = {}
    out: DataFrame | None = None
    for c in cfg.grid(profiles, seeds):
        for method in methods:
            run = Experiment(spark, sequences_, edges, c, method=method)
            run.tables |= shared
            row = staged(run.metrics(), "metrics")
            shared |= {k: run.tables[k] for k in SHARED if k in run.tables}
            out = row if out is None else out.unionByName(row)
    return out
