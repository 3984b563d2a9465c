"""Audit, attack, comparison and scaling runs, on the smallest tables."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from wayfold.functions import columns as C
from wayfold.operators import audits, randomize, recover, sequences, summaries
from wayfold.oracle import CFG
from wayfold.plans import modes
from wayfold.plans.experiment import Experiment, assert_fresh
from wayfold.sources import files
from wayfold.sources.walks import public_edges, walks


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("user_id % 3 = 0")
    n = (F.lit(10) + F.pmod(F.xxhash64("traj_id"), F.lit(31))).cast("int")
    found = walks(events).withColumns({c: F.slice(c, F.lit(1), n) for c in ("segments", "segment_times")})
    return Experiment(spark, found, public_edges(spark), CFG, root=f"file://{tmp_path_factory.mktemp('runs')}", skip_invalid=True)


def test_audit_passes_and_finds_faults(spark, run):
    gates = modes.run_audit(run)
    assert audits.verdict(gates).head().verdict == "PASS", gates.where("not passed").collect()
    assert audits.require(gates).count() >= 15
    wrong = run.stage("ends").select("split", F.lit("nowhere").alias("x_noisy"), "sbs_id")
    r = randomize.start_audit(wrong, run.edges).head()
    assert (r.outside_domain, r.extra_columns) == (r.reports, 1)
    bad = audits.report_gates(spark, "start", randomize.start_audit(wrong, run.edges), 1)
    with pytest.raises(AssertionError):
        audits.require(bad)
    far = run.stage("ends").select("split", F.lit(31).alias("x_noisy"))
    assert randomize.count_audit(far, 30).head().outside_domain == far.count()


def test_comparison_and_attack(spark, run):
    row = run.comparison()
    assert list(row) == [
        "method", "high_risk_keep_rate", "keep_rate_overall", "transition_js", "synthetic_bigram_js", "synthetic_count_js",
        "public_legal_ratio", "exact_count_rate", "early_stop_rate", "num_synthetic_trajectories", "transition_recovery_component",
    ]
    assert row["public_legal_ratio"] == 1.0 and row["num_synthetic_trajectories"] == run.stage("pieces").where("split = 'test'").count()
    assert {r.scope for r in modes.run_attack(run).collect()} <= {"all", "branching"}


def test_tables_are_found_again_and_told_from_fresh_ones(spark, run):
    run.stage("transitions")
    again = Experiment(spark, run.sequences, run.edges, CFG, root=run.root)
    assert again.stage("transitions").count() == run.stage("transitions").count()
    assert [r["status"] for r in again.records] == ["SKIPPED_EXISTING"]
    with pytest.raises(AssertionError):
        assert_fresh(again.records, ("transitions",))
    with pytest.raises(AssertionError):
        assert_fresh([], ("risk",))


def test_scaling_by_length(spark, run):
    table, fit = modes.run_by_length(spark, run.sequences, run.edges, CFG, per_bin=5, bins=2, warmups=0, repeats=1, least=1)
    rows = table.collect()
    assert len(rows) == 2 and len({r.sequences for r in rows}) == 1 and all(r.seconds_mean > 0 for r in rows)
    assert fit.count() == 1
    with pytest.raises(ValueError):
        modes.run_by_length(spark, run.sequences, run.edges, CFG, least=10**6)


def test_sequences_that_are_none(spark):
    rows = spark.createDataFrame([("a", ["x", "y"], [1, 2]), ("b", ["x"], [1]), ("c", None, None), ("d", ["x", "y"], [1]), ("e", ["x", ""], None), ("f", ["x", "y"], None)], "traj_id string, segments array<string>, segment_times array<long>")
    assert {r.traj_id for r in sequences.checked(rows, skip_invalid=True).collect()} == {"a", "f"}
    with pytest.raises(PySparkException):
        sequences.checked(rows).collect()
    assert sequences.checked(rows.where("traj_id in ('a', 'f')")).count() == 2


def test_names_and_nested_values(spark):
    rows = spark.createDataFrame([("", "s1", ["p", "q", "r"], '{"a": {"b": 3}}'), (None, None, None, "{}")], "start string, x_start string, segments array<string>, doc string")
    got = rows.select(C.event_start(rows).alias("s"), C.event_count(rows).alias("n"), C.segment_length(rows).alias("k"), C.nested(F.col("doc"), "a.b", "none").alias("d"), C.first_present(rows, ["other"]).alias("o")).collect()
    assert [tuple(r) for r in got] == [("s1", 3, 3, "3", None), (None, None, None, "none", None)]
    only = rows.select(F.lit(7).alias("num_segments"))
    assert only.select(C.segment_length(only)).head()[0] == 7
    assert rows.select(C.safe_number(F.lit("nan"), 0.5)).head()[0] == 0.5 and rows.select(C.safe_number(F.lit("2"))).head()[0] == 2.0


def test_joint_recovery_keeps_sparse_contexts(spark):
    domain = spark.createDataFrame([("a", "b", 0, 2), ("a", "c", 1, 2), ("z", "b", 0, 1)], "u string, v string, pos int, d int")
    rows = [("train", "a", "b", 1)] * 15 + [("train", "a", "c", 2)] * 15 + [("test", "a", "b", 1)] * 3 + [("test", "z", "b", 2)]
    reports = spark.createDataFrame(rows, "split string, u string, y string, k_noisy int")
    got = recover.joint_marginals(reports, domain, CFG.privacy, CFG.recovery).collect()
    assert {(r.split, r.u): r.source for r in got} == {("train", "a"): "joint", ("test", "a"): "context", ("test", "z"): "context"}
    context = {(r.split, r.u, r.v): r.prob for r in recover.recover_context(reports, domain, CFG.privacy, CFG.recovery).collect()}
    assert all(abs(context[r.split, r.u, r.v] - r.prob) < 1e-12 for r in got if r.source == "context")
    mass = recover.recover_joint(reports, domain, CFG.privacy, CFG.recovery, "mass").collect()
    assert {r.source for r in mass if r.u == "z"} == {"single"} and all(r.condition >= 1 and r.residual >= 0 for r in mass)
    sums = {}
    for r in mass:
        sums[r.split, r.u] = sums.get((r.split, r.u), 0) + r.prob
    assert all(abs(x - 1) < 1e-9 for x in sums.values())
    assert abs(sum(r.prob for r in recover.bucket_marginals(recover.recover_joint(reports, domain, CFG.privacy, CFG.recovery)).collect()) - 1) < 1e-9


def test_joint_solution_is_optimal():
    """Conditions of the optimum: no slope below 0 where x is 0, none where it is positive."""
    import numpy as np

    rng = np.random.default_rng(5)
    a = recover.channel(3, CFG.privacy.eps_event, CFG.privacy.eps_bucket)
    for _ in range(20):
        b = rng.dirichlet(np.ones(len(a)))
        x = recover.nnls(a, b, 1e-8)
        slope = a.T @ (a @ x - b) + 1e-8 * x
        assert (x >= 0).all() and (slope > -1e-9).all() and abs(slope[x > 0]).max() < 1e-9


def test_pieces_that_do_not_hold_their_parents(spark):
    good = spark.createDataFrame([("w", "train", 1, 1, 0, 30, 1.0)], "dataset string, split string, num_parents int, num_single int, num_multi int, max_piece_segments int, min_coverage double")
    summaries.check_pieces(good, 30)
    for bad in (good.withColumn("min_coverage", F.lit(0.9)), good.withColumn("max_piece_segments", F.lit(31)), good.withColumn("num_multi", F.lit(1))):
        with pytest.raises(AssertionError):
            summaries.check_pieces(bad, 30)
    with pytest.raises(ValueError):
        summaries.check_pieces(good.limit(0), 30)


def test_metric_files(spark, tmp_path):
    for seed, head in ((1, "﻿Method Name,Density Error"), (2, "Method Name,Dens-Err")):
        d = tmp_path / f"porto_seed{seed}" / "b1p0"
        d.mkdir(parents=True)
        (d / "m.csv").write_text(f"{head}\nRisk-Aware,0.{seed}\nUniform,0.5\n".replace("Risk-Aware", "RiskAware"), encoding="utf-8")
    rows = files.read_metrics(spark, [f"{tmp_path}/*/b1p0/*.csv", f"{tmp_path}/porto_seed1/*/m.csv"], {"Method Name": "method"}).collect()
    assert sorted((r.seed, r.profile, r.dataset_name, r.method, r.dens_err) for r in rows) == [(1, "B1p0", "porto", "riskaware", "0.1"), (1, "B1p0", "porto", "uniform", "0.5"), (2, "B1p0", "porto", "riskaware", "0.2"), (2, "B1p0", "porto", "uniform", "0.5")]
    with pytest.raises(FileNotFoundError):
        files.read_metrics(spark, [f"{tmp_path}/none*.csv"])
    some = files.read_csv(spark, f"{tmp_path}/porto_seed2/b1p0/m.csv", ["Dens-Err"], {"Dens-Err": "double"})
    assert some.dtypes == [("Dens-Err", "double")] and files.missing_metrics(some.withColumnRenamed("Dens-Err", "dens_err"))[0] == "query_err"
    files.write_json({"a": [1, "é"]}, f"{tmp_path}/x/y.json")
    assert files.read_json(f"{tmp_path}/x/y.json") == {"a": [1, "é"]}
    assert files.resolved("a/b", "/r/") == "/r/a/b" and files.resolved("/a", "/r") == "/a" and files.resolved("s3://a", "/r") == "s3://a" and files.resolved(None, "/r") is None
    ids = spark.range(3).select(F.col("id").cast("int").alias("id"))
    files.append_new(ids, f"{tmp_path}/p", "id", f"{tmp_path}/p.json")
    files.append_new(spark.range(5).select(F.col("id").cast("int").alias("id")), f"{tmp_path}/p", "id", f"{tmp_path}/p.json")
    assert files.read_json(f"{tmp_path}/p.json")["rows"] == 5
    spark.createDataFrame([("a", "b", 2.0), ("a", "c", 2.0), ("a", "d", 0.0)], "u string, v string, prob double").write.parquet(f"{tmp_path}/rec")
    assert sorted((r.v, r.prob) for r in files.read_recovered(spark, f"{tmp_path}/rec").collect()) == [("b", 0.5), ("c", 0.5)]
    files.write_debug(ids, None)
    files.write_debug(ids, f"{tmp_path}/debug")
    assert spark.read.parquet(f"{tmp_path}/debug").count() == 3


def test_points_off_the_nodes(spark):
    """The nearest node by brute force, however far a point is from the map."""
    import random

    from wayfold.operators import trips

    rng = random.Random(3)
    nodes = [(f"n{k}", rng.uniform(0, 3), rng.uniform(0, 3)) for k in range(40)]
    roads = [(a[0], b[0], 0, 1.0 + rng.random()) for a in nodes for b in nodes if a != b]
    shapes = [[(rng.uniform(-2, 5), rng.uniform(-2, 5)) for _ in range(6)] for _ in range(15)] + [[(90.0, 90.0), (-90.0, -80.0), (1.5, 1.5)]]
    near = lambda p: min(nodes, key=lambda n: ((n[1] - p[0]) ** 2 + (n[2] - p[1]) ** 2, n[0]))[0]
    rows = [(str(k), "t", 0, [list(p) for p in s], [15 * j for j in range(len(s))]) for k, s in enumerate(shapes)]
    table = spark.createDataFrame(rows, "traj_id string, taxi_id string, start_timestamp long, points array<array<double>>, point_times array<long>")
    got = trips.match(table, spark.createDataFrame(nodes, "node string, lon double, lat double"), spark.createDataFrame(roads, "src string, dst string, key int, length double"), spark, cell=0.05, min_segments=1)
    for r in got.collect():
        want = []
        for p in shapes[int(r.traj_id)]:
            if not want or want[-1] != near(p):
                want.append(near(p))
        if len(want) > 1:
            assert [s.split("__")[0] for s in r.segments] + [r.segments[-1].split("__")[1]] == want
        else:
            assert r.reason == "one_node"
