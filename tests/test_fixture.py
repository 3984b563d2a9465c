"""The hand-worked trajectory: seven segments, pieces of four."""

import math

import pytest
from wayfold.config import ExperimentConfig, PrivacyConfig, RecoveryConfig, RiskConfig, ablation_weights, number_tag
from wayfold.operators import audits, evaluate, graph, recover, risk, schedule, sequences

EDGES = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("c", "d"), ("c", "e"), ("d", "e"), ("e", "a"), ("e", "b"), ("e", "c"), ("e", "f")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "u string, v string")


@pytest.fixture(scope="module")
def rows(spark):
    seq = spark.createDataFrame([("T1", list("abcdeac"), [0, 15, 30, 400, 415, 430, 445]), ("T2", ["a"], [0])], "traj_id string, segments array<string>, segment_times array<long>")
    return sequences.transitions(sequences.pieces(seq, 4))


def test_pieces(spark):
    seq = spark.createDataFrame([("T1", list("abcdeac"), None)], "traj_id string, segments array<string>, segment_times array<long>")
    got = {r.sbs_id: ("".join(r.segments), r.a_j, r.r_j) for r in sequences.pieces(seq, 4).collect()}
    assert got == {"T1::sbs1": ("abcd", 1, 4), "T1::sbs2": ("deac", 4, 7)}


def test_risk(rows, edges):
    out = risk.transition_risk(rows, edges, RiskConfig(), 3).orderBy("sbs_id", "t").collect()
    want = [
        (0, 2, 1, 1.0, 0.716531, 0.5, 0.738844, 1),
        (1, 2, 1, 0.716531, 0.716531, 1.0, 0.811021, 1),
        (1, 1, 0, 0.716531, 1.0, 0.333333, 0.683288, 1),
        (0, 1, None, 1.0, 0.0, 1.0, 0.666667, 2),
        (1, 1, None, 0.716531, 0.0, 0.25, 0.322177, 3),
        (2, 1, None, 0.716531, 0.0, 0.5, 0.405510, 2),
    ]
    for r, w in zip(out, want, strict=True):
        assert (r.endpoint_distance_start, r.endpoint_distance_end, r.stay_min_distance) == w[:3]
        for got, x in zip((r.risk_endpoint, r.risk_stay, r.risk_degree, r.risk_score), w[3:7], strict=True):
            assert abs(got - x) < 1e-6
        assert r.target_bucket == w[7]


def test_both_searches_agree(spark, edges):
    names = spark.createDataFrame([(a, b) for a in "abcdef" for b in "abcdef"], "a string, b string")
    one = {tuple(r) for r in graph._search(names, edges, 5).collect()}
    assert one == {tuple(r) for r in graph._frontiers(names, edges, 5).select("a", "b", "hops").collect()}


def test_schedule(spark):
    cfg = PrivacyConfig(budget=0.4, eps_start=0.1, eps_count=0.2, eps_bucket=0.005, eps_event=(0.01, 0.025, 0.05), max_segments=6)
    rows = spark.createDataFrame([("s", t, k) for t, k in enumerate([3, 3, 1, 2, 3], 1)], "sbs_id string, t int, target_bucket int")
    got = [r.exec_bucket for r in schedule.schedule(rows, cfg, []).orderBy("t").collect()]
    assert got == [2, 1, 1, 1, 1]


def test_legality(rows, edges):
    assert sequences.legality(rows, edges).collect()[0].n_illegal == 0
    bad = sequences.legality(rows, edges.where("not (u = 'd')")).collect()[0]
    assert (bad.n_illegal, bad.first_illegal) == (1, 4)


def test_negative_gap_fails(spark):
    seq = spark.createDataFrame([("T", ["a", "b"], [5, 1])], "traj_id string, segments array<string>, segment_times array<long>")
    with pytest.raises(Exception, match="negative time gap"):
        sequences.assert_ordered(sequences.transitions(sequences.pieces(seq))).collect()


@pytest.mark.parametrize(("name", "least", "uniform", "envelope", "bound"), [("B0p5", 0.3675, 0.0095689655, 0.0275, 0.9475), ("B1p0", 0.735, 0.0191379310, 0.055, 1.895), ("B1p5", 1.1025, 0.0287068966, 0.0825, 2.8425)])
def test_budgets(name, least, uniform, envelope, bound):
    cfg = PrivacyConfig.profile(name)
    assert abs(cfg.required - least) < 1e-9 and abs(cfg.uniform - uniform) < 1e-9 and cfg.uniform_bucket == 2
    got = audits.bounds(cfg)
    assert abs(got["transition_envelope"] - envelope) < 1e-9 and abs(got["piece_bound"] - bound) < 1e-9


def test_settings_are_checked():
    for bad in (lambda: RiskConfig(lambda_e=0.9), lambda: RiskConfig(thresholds=(0.3, 0.6)), lambda: PrivacyConfig(budget=0.5), lambda: RecoveryConfig(mode="x"), lambda: ExperimentConfig(synthesis_splits=("test",))):
        with pytest.raises(ValueError):
            bad()
    assert number_tag(1.0) == "1" and number_tag(0.005) == "0p005"
    assert abs(sum(ablation_weights(RiskConfig())["without_stay"]) - 1) < 1e-12


@pytest.mark.parametrize("n", [2, 3, 4, 5, 29, 30, 31, 59, 88])
@pytest.mark.parametrize("most", [2, 3, 30])
def test_each_transition_stands_once(spark, n, most):
    seq = spark.createDataFrame([("T", [str(k) for k in range(n)], None)], "traj_id string, segments array<string>, segment_times array<long>")
    sbs = sequences.pieces(seq, most)
    got = sorted((r.u, r.v) for r in sequences.transitions(sbs).collect())
    assert got == sorted((str(k), str(k + 1)) for k in range(n - 1))
    assert sbs.count() == math.ceil((n - 1) / (most - 1))


def test_constrained_inverse_against_active_sets(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows, want = [], {}
    for g in range(30):
        d = int(rng.integers(1, 7))
        p = 1.0 if d == 1 else float(rng.uniform(1 / d + 0.05, 0.95))
        q = 0.0 if d == 1 else (1 - p) / (d - 1)
        b = rng.dirichlet(np.ones(d) * 0.5)
        a = np.full((d, d), q) + (p - q) * np.eye(d)
        want[g] = recover.project(recover.nnls(a, b, 1e-8))
        rows += [(g, k, float(x), p, q) for k, x in enumerate(b)]
    got = recover.constrained_inverse(spark.createDataFrame(rows, "g int, k int, b double, p double, q double"), ["g"], "b", "p", "q", "k")
    for r in got.collect():
        assert abs(r.prob - want[r.g][r.k]) < 1e-6


def test_divergence_and_fit_edges(spark):
    p = spark.createDataFrame([("x", 1.0)], "v string, prob double")
    q = spark.createDataFrame([("y", 2.0)], "v string, prob double")
    assert abs(evaluate.js_divergence(p, q, ["v"]).head().js - math.log(2)) < 1e-12
    assert evaluate.js_divergence(p.limit(0), q.limit(0), ["v"]).head().js == 0
    same = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert evaluate.line_fit(same, "x", "y").head().slope is None
    flat = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "x double, y double")
    assert evaluate.line_fit(flat, "x", "y").head().r2 == 1.0
    assert evaluate.legal_ratio(spark.createDataFrame([], "a string, b string"), spark.createDataFrame([], "u string, v string")).head().legal_ratio == 1.0
    assert audits.recovery_gate(0.2, 0.19) == "joint" and audits.recovery_gate(0.2, 0.199) == "context"
