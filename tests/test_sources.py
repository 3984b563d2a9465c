import pytest
from wayfold.config import DatasetConfig, ExperimentConfig, RiskConfig
from wayfold.operators import audits, evaluate, randomize, sequences, trips
from wayfold.plans.experiment import Experiment, run_grid
from wayfold.sources import files
from wayfold.sources.walks import public_edges, walks
from wayfold.streaming import reports as stream

SF = "/root/testdata/sf0.001"


def test_jsonl(spark, tmp_path):
    files.write_jsonl(spark.createDataFrame([(1, "a")], "n int, s string"), f"{tmp_path}/x")
    assert files.read_jsonl(spark, f"{tmp_path}/x", "n int, s string").collect()[0].s == "a"
    (tmp_path / "bad.json").write_text('{"n": 1}\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.read_jsonl(spark, f"{tmp_path}/bad.json", "n int").collect()


def test_trips_and_matching(spark, tmp_path):
    head = ",".join(files.TRIP_COLUMNS)
    line = lambda i, missing, points, t="100": f'"{i}","7","{t}","{missing}","{points}"'
    good = "[" + ",".join(f"[{k}.1,0.0]" for k in range(10)) + "]"
    rows = [line("a", "False", good), line("b", "True", good), line("c", "False", "[[1,2],"), line("d", "False", "[[1.0,2.0]]"), line("e", "False", good, "x"), line("f", "False", good.replace("[1.1,0.0]", "[1.1]"))]
    (tmp_path / "t.csv").write_text("\n".join([head, *rows]) + "\n")
    parsed = trips.parse_trips(files.read_trips(spark, f"{tmp_path}/t.csv"))
    assert [r.traj_id for r in parsed.collect()] == ["a"]
    graphml = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="node" attr.name="x"/><key id="d1" for="node" attr.name="y"/><key id="d2" for="edge" attr.name="length"/><graph>'
    graphml += "".join(f'<node id="{k}"><data key="d0">{k}</data><data key="d1">0</data></node>' for k in range(11))
    graphml += "".join(f'<edge source="{k}" target="{k + 1}" id="{j}"><data key="d2">{9 - j}</data></edge>' for k in range(10) for j in range(2)) + "</graph></graphml>"
    (tmp_path / "g.graphml").write_text(graphml)
    from wayfold.operators.graph import best_parallel

    nodes, roads = files.read_graphml(spark, f"{tmp_path}/g.graphml")
    best = best_parallel(roads)
    assert {r.key for r in best.collect()} == {1}
    got = trips.match(trips.point_times(parsed), nodes, best, spark, cell=1.0).collect()[0]
    assert got.reason is None and got.segments[0] == "0__1__1" and len(got.segments) == 9 and got.segment_times[:2] == [100, 115]
    back = trips.match(trips.point_times(parsed.withColumn("points", __import__("pyspark.sql.functions", fromlist=["x"]).reverse("points"))), nodes, best, spark, cell=1.0)
    assert [(r.reason, r.n) for r in trips.failures(back).collect()] == [("no_path", 1)]


def test_metrics_csv(spark, tmp_path):
    for seed in (1, 2):
        d = tmp_path / f"seed_{seed}" / "B1p0"
        d.mkdir(parents=True)
        (d / "m.csv").write_text("Method,js\nriskaware,0.5\n" if seed == 1 else "Method,js,tv\nriskaware,0.7,0.1\n")
    rows = files.read_metrics(spark, [f"{tmp_path}/seed_1/B1p0/m.csv", f"{tmp_path}/seed_2/B1p0/m.csv"], {"Method": "method"})
    assert {(r.seed, r.profile, r.js) for r in rows.collect()} == {(1, "B1p0", "0.5"), (2, "B1p0", "0.7")}
    stats = evaluate.seed_statistics(rows.selectExpr("'d' dataset", "profile", "method", "seed", "double(js) js"), ["js"], min_seeds=2).collect()[0]
    assert abs(stats.js_mean - 0.6) < 1e-12 and stats.seeds == 2
    files.write_csv([rows.select("method"), rows.select("seed")], f"{tmp_path}/out")
    assert spark.read.csv(f"{tmp_path}/out", header=True).columns == ["method", "seed"]


def test_settings_and_appends(spark, tmp_path):
    files.write_yaml({"a": {"b": 1}}, f"{tmp_path}/d/x.yaml")
    assert files.read_yaml(f"{tmp_path}/d/x.yaml") == {"a": {"b": 1}}
    one = spark.createDataFrame([(1,), (2,)], "id int")
    files.append_new(one, f"{tmp_path}/p", "id")
    assert files.append_new(one.union(spark.createDataFrame([(3,)], "id int")), f"{tmp_path}/p", "id").count() == 3
    with pytest.raises(ValueError, match="sbs_id"):
        files.check_report(one.withColumnRenamed("id", "sbs_id"))
    assert DatasetConfig().variant != DatasetConfig(seed=7).variant and ExperimentConfig().tag.startswith("Lm30_K3_B1p0_B1_")


def test_samples_and_splits(spark):
    rows = spark.range(1000).selectExpr("cast(id as string) id", "id % 4 bin")
    assert sequences.bin_sample(rows, "bin", "id", 10).groupBy("bin").count().where("count <> 10").count() == 0
    sizes = {r.split: r["count"] for r in sequences.split_of(rows.limit(105), "id", rounding="round").groupBy("split").count().collect()}
    assert sizes == {"train": 84, "valid": 10, "test": 11}
    assert sequences.hash_sample(rows, "id", 5).collect() == sequences.hash_sample(rows.repartition(7), "id", 5).collect()


def test_randomised_response_keeps_as_often_as_it_should(spark):
    from pyspark.sql import functions as F
    from wayfold.config import grr_parameters
    from wayfold.functions.columns import respond, uniform

    n, d, eps = 20000, 5, 1.0
    x = respond(F.lit(2), F.lit(d), F.lit(eps), uniform(1, F.col("id"), "a"), uniform(1, F.col("id"), "b"))
    seen = {r.x: r["count"] for r in spark.range(n).select(x.alias("x")).groupBy("x").count().collect()}
    p, q = grr_parameters(eps, d)
    for value in range(d):
        share = p if value == 2 else q
        assert abs(seen[value] - n * share) < 5 * (n * share * (1 - share)) ** 0.5


def test_experiment(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    cfg = ExperimentConfig(risk=RiskConfig(stay_seconds=86400.0))
    out = run_grid(spark, walks(events), public_edges(spark), cfg, ["B1p0"], [42]).collect()
    assert [r.method for r in out] == ["riskaware", "uniform", "degree"]
    assert all(r.legal_ratio == 1.0 and 0 <= r.keep_rate <= 1 and r.weighted_tv <= 1 for r in out)
    run = Experiment(spark, walks(events), public_edges(spark), cfg)
    assert run.stage("synthetic").count() == run.stage("pieces").where("split = 'test'").count()
    gate = audits.gates(spark, [("a", True, True, ""), ("b", False, False, "")])
    assert audits.verdict(gate).head().verdict == "WARN"
    assert audits.majority(run.stage("reports"), "k_noisy").count() == 1
    seen = randomize.server_reports(run.stage("reports"), randomize.TRANSITION)
    assert tuple(seen.columns) == randomize.TRANSITION


def test_stream(spark, tmp_path):
    rows = [("train", "a", "b", 1), ("train", "a", "b", 1), ("train", "a", "c", 2)]
    spark.createDataFrame(rows, stream.SCHEMA).write.json(f"{tmp_path}/in")
    stream.keep_counts(stream.read_reports(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(60)
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]
