"""Every registered query of the engine, with the DuckDB SQL that must give the same rows.

The queries read the events table as walks on a fixed public graph; those on
raw trips and road maps make small ones from it. Sums and means are rounded
where engines add in another order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from .functions.columns import uniform
from .functions.tables import staged
from .operators import audits, evaluate, graph, randomize, recover, risk, schedule, sequences, summaries, synthesis, trips
from .oracle import CFG, num, sql
from .sources import walks as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
P, R = CFG.privacy, CFG.risk


def query(body: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if body is not None:
            ORACLE_SQL[f.__name__] = sql(body)
        return f

    return add


def _walks(spark, d):
    return W.walks(spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", "props"))


def _pieces(spark, d):
    return sequences.pieces(sequences.split_of(_walks(spark, d), "traj_id"), P.max_segments)


def _transitions(spark, d):
    return sequences.transitions(_pieces(spark, d))


def _risk(spark, d):
    return risk.transition_risk(staged(_transitions(spark, d), "transitions"), W.public_edges(spark), R)


def _scheduled(spark, d, target="target_bucket"):
    return schedule.schedule(_risk(spark, d), P, ["split", "u", "v", "risk_score"])


def _reports(spark, d):
    return randomize.successors(_scheduled(spark, d), W.public_edges(spark), P, "riskaware", randomize.event_epsilon(F.col("exec_bucket"), P), F.col("exec_bucket"))


def _visible(spark, d):
    return staged(_reports(spark, d).select(*randomize.TRANSITION), "reports")


def _uniform(spark, d):
    return randomize.successors(_risk(spark, d), W.public_edges(spark), P, "uniform", F.lit(P.uniform), F.lit(P.uniform_bucket))


def _degree(spark, d):
    rows = _transitions(spark, d).join(F.broadcast(graph.domains(W.public_edges(spark)).groupBy("u").agg(F.max("d").alias("deg"))), "u")
    rows = schedule.schedule(rows.withColumn("target_bucket", risk.degree_bucket(F.col("deg"))), P, ["split", "u", "v"])
    return randomize.successors(rows, W.public_edges(spark), P, "degree", randomize.event_epsilon(F.col("exec_bucket"), P), F.col("exec_bucket"))


def _ends(spark, d):
    return randomize.start_and_count(_pieces(spark, d), W.public_edges(spark), P, "riskaware")


def _domain(spark):
    return graph.domains(W.public_edges(spark))


def _context(spark, d):
    return recover.recover_context(_visible(spark, d), _domain(spark), P, CFG.recovery)


def _synthesis_input(spark, d):
    found = staged(_context(spark, d).where("split <> 'test'"), "recovered")
    return found, recover.merged(found, ["u", "v"])


def r(c, digits=9):
    return F.round(c, digits).alias(c)


# sequences


@query("SELECT traj_id, n, seg AS segment, tau FROM pt")
def legal_walks(spark, d):
    return _walks(spark, d).select("traj_id", F.posexplode(F.arrays_zip("segments", "segment_times")).alias("n", "x")).select("traj_id", (F.col("n") + 1).cast("long").alias("n"), F.col("x.segments").alias("segment"), F.col("x.segment_times").alias("tau"))


@query("SELECT traj_id, sbs_id, CAST(sbs_index AS INTEGER) AS sbs_index, q AS num_sbs, CAST(a_j AS INTEGER) AS a_j, CAST(r_j AS INTEGER) AS r_j, CAST(np AS INTEGER) AS parent_num_segments, split FROM sbs")
def sbs_partition(spark, d):
    return _pieces(spark, d).select("traj_id", "sbs_id", "sbs_index", "num_sbs", "a_j", "r_j", "parent_num_segments", "split")


@query("SELECT split, sbs_id, t, global_pos, cnt, u, v, tau_u, tau_v, delta_t, start, stop FROM tr")
def transitions(spark, d):
    return _transitions(spark, d).select("split", "sbs_id", F.col("t").cast("long"), F.col("global_pos").cast("long"), F.col("cnt").cast("long"), "u", "v", "tau_u", "tau_v", "delta_t", "start", "stop")


@query("SELECT traj_id, count(*) AS n_pairs, count(*) FILTER (e.u IS NULL) AS n_illegal, min(global_pos) FILTER (e.u IS NULL) AS first_illegal FROM tr LEFT JOIN (SELECT u, v FROM edge WHERE NOT (u = 's05' AND v = 's16')) e USING (u, v) GROUP BY traj_id")
def legality_check(spark, d):
    """Against the graph without one edge, so that there is something to find."""
    return sequences.legality(_transitions(spark, d), W.public_edges(spark).where("not (u = 's05' and v = 's16')")).withColumn("first_illegal", F.col("first_illegal").cast("long"))


@query(f"SELECT traj_id FROM par ORDER BY {O.uniform(chr(39) + '42' + chr(39), chr(39) + 'sample' + chr(39), 'traj_id')}, traj_id LIMIT 25")
def hash_sample(spark, d):
    return sequences.hash_sample(_walks(spark, d).select("traj_id"), "traj_id", 25)


@query("SELECT split, count(*) AS n FROM spl GROUP BY split")
def split_counts(spark, d):
    return sequences.split_of(_walks(spark, d).select("traj_id"), "traj_id").groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT traj_id, split FROM spl")
def split_assignment(spark, d):
    return sequences.split_of(_walks(spark, d).select("traj_id"), "traj_id").select("traj_id", "split")


@query(
    f"WITH q AS (SELECT traj_id, max(q) AS q, max(np) AS n, sum(r_j - a_j) AS c FROM sbs GROUP BY traj_id) SELECT count(*) AS parents, CAST(sum(q) AS BIGINT) AS pieces, count(*) FILTER (q = 1) AS single, count(*) FILTER (q > 1) AS multi, round(avg(q), 9) AS avg_q, CAST(quantile_disc(q, 0.95) AS BIGINT) AS p95_q, CAST(max(q) AS BIGINT) AS max_q, round(avg(n), 9) AS avg_segments, CAST(quantile_cont(n, 0.5) AS DOUBLE) AS median_segments, count(*) FILTER (n > {P.max_segments}) AS longer_than_piece, round(sum(c) / sum(n - 1), 9) AS coverage, CAST(sum(q) - count(*) AS BIGINT) AS shared_boundaries FROM q"
)
def sbs_stats(spark, d):
    return sequences.summary(_pieces(spark, d), P.max_segments)


@query("SELECT sbs_id, CAST(pos AS BIGINT) AS pos, seg AS segment FROM anc")
def stay_anchors(spark, d):
    return sequences.stay_anchors(_transitions(spark, d), R.stay_seconds).select("sbs_id", F.col("pos").cast("long").alias("pos"), "segment")


@query("SELECT traj_id, tau FROM (SELECT traj_id, n, tau, count(*) OVER (PARTITION BY traj_id) AS m FROM pt) WHERE m <= 20 OR n - 1 IN (SELECT CAST(round_even(i * (m - 1) / 19e0, 0) AS BIGINT) FROM range(20) t(i))")
def even_downsample(spark, d):
    return _walks(spark, d).select("traj_id", F.explode(sequences.even_downsample(F.col("segment_times"), 20)).alias("tau"))


@query("SELECT traj_id, n, g FROM (SELECT traj_id, n, CAST(substr(seg, 2) AS INTEGER) // 16 AS g, lag(CAST(substr(seg, 2) AS INTEGER) // 16) OVER (PARTITION BY traj_id ORDER BY n) AS p FROM pt) WHERE p IS NULL OR p <> g")
def dedup_consecutive(spark, d):
    """Of the walks over quarters of the graph, where neighbours do repeat."""
    rows = _walks(spark, d).select("traj_id", F.transform("segments", lambda s: F.floor(F.substring(s, 2, 2).cast("int") / 16).cast("int")).alias("g"), F.transform("segments", lambda s, i: (i + 1).cast("long")).alias("n"))
    kept = sequences.without_repeats(F.col("g"), F.col("n"))
    return rows.select("traj_id", F.explode(kept).alias("x")).select("traj_id", F.col("x.time").alias("n"), F.col("x.item").alias("g"))


# graph


@query("SELECT u AS segment, string_agg(v, ',' ORDER BY v) AS successors, count(*) AS n FROM (SELECT a.u || '__' || a.v || '__0' AS u, b.u || '__' || b.v || '__0' AS v FROM edge a JOIN edge b ON a.v = b.u) GROUP BY u")
def successor_graph(spark, d):
    roads = W.public_edges(spark).select(F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(0).alias("key"))
    return graph.line_graph(roads).select("segment", F.array_join("successors", ",").alias("successors"), F.size("successors").cast("long").alias("n"))


@query("SELECT src, dst, arg_min(key, (length, key)) AS key, min(length) AS length FROM (SELECT l_suppkey % 20 AS src, l_partkey % 20 AS dst, CAST(l_linenumber AS INTEGER) AS key, CASE WHEN l_quantity > 45 THEN 1e0 ELSE l_quantity END AS length FROM lineitem) GROUP BY src, dst")
def best_parallel_edge(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_suppkey") % 20).alias("src"), (F.col("l_partkey") % 20).alias("dst"), F.col("l_linenumber").cast("int").alias("key"), F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("length"))
    return graph.best_parallel(rows)


@query("SELECT DISTINCT u AS a, stop AS b, CAST(hops AS INTEGER) AS hops FROM tr JOIN hop ON a = u AND b = stop")
def hop_distance(spark, d):
    return graph.hop_distances(_transitions(spark, d).select(F.col("u").alias("a"), F.col("stop").alias("b")).distinct(), W.public_edges(spark))


@query("SELECT a, b, CAST(min(h) AS INTEGER) AS hops FROM bfs GROUP BY a, b")
def frontier_search(spark, d):
    """The search by joins, which larger graphs take, between all segments."""
    nodes = W.public_edges(spark).select("u").distinct()
    pairs = nodes.select(F.col("u").alias("a")).join(nodes.select(F.col("u").alias("b")))  # the public segments, twice
    return graph._frontiers(pairs, W.public_edges(spark), P.max_segments - 1)


# risk

_RISK = "split, sbs_id, t, u, v, CAST(d1 AS INTEGER) AS endpoint_distance_start, CAST(d2 AS INTEGER) AS endpoint_distance_end, CAST(ds AS INTEGER) AS stay_min_distance, na AS num_stay_anchor_segments, d AS public_successor_domain_size, round(re, 9) AS risk_endpoint, round(rs, 9) AS risk_stay, round(rd, 9) AS risk_degree, round(score, 9) AS risk_score, target_bucket"


@query(f"SELECT {_RISK} FROM scr")
def transition_risk(spark, d):
    return _risk(spark, d).select("split", "sbs_id", F.col("t").cast("long"), "u", "v", "endpoint_distance_start", "endpoint_distance_end", "stay_min_distance", "num_stay_anchor_segments", "public_successor_domain_size", *map(r, ("risk_endpoint", "risk_stay", "risk_degree", "risk_score")), "target_bucket")


@query(
    "SELECT k AS target_bucket, count(target_bucket) AS n, round(count(target_bucket) / (SELECT count(*) FROM scr), 9) AS fraction, round(coalesce(sum(delta_t), 0) / greatest(count(target_bucket), 1), 6) AS avg_delta_t, "
    "round(coalesce(avg(score), 0), 9) AS avg_risk_score, round(coalesce(avg(re), 0), 9) AS avg_risk_endpoint, round(coalesce(avg(rs), 0), 9) AS avg_risk_stay, round(coalesce(avg(rd), 0), 9) AS avg_risk_degree FROM (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS k) LEFT JOIN scr ON target_bucket = k GROUP BY k"
)
def bucket_summary(spark, d):
    return risk.bucket_summary(_risk(spark, d))


_w = (f"{num(R.lambda_e)} * re", f"{num(R.lambda_s)} * rs", f"{num(R.lambda_d)} * rd")


@query(
    "WITH s AS (SELECT *, unnest(CASE WHEN d > 1 THEN ['all', 'branching'] ELSE ['all'] END) AS scope, greatest(%s, %s, %s) AS top FROM scr), " % _w
    + "w AS (SELECT *, CAST(abs(%s - top) <= 1e-12 AS INTEGER) AS w1, CAST(abs(%s - top) <= 1e-12 AS INTEGER) AS w2, CAST(abs(%s - top) <= 1e-12 AS INTEGER) AS w3 FROM s) " % _w
    + "SELECT scope, count(*) AS n, round(avg(score), 9) AS mean_risk_score, round(avg(re), 9) AS mean_risk_endpoint, round(avg(rs), 9) AS mean_risk_stay, round(avg(rd), 9) AS mean_risk_degree, "
    + ", ".join(f"round(quantile_cont(score, {q / 100}), 9) AS q{q}" for q in (10, 25, 50, 75, 90))
    + ", round(count(*) FILTER (delta_t >= 86400) / count(*), 9) AS long_gap_share, round(count(*) FILTER (d1 <= 1 OR d2 <= 1) / count(*), 9) AS near_endpoint_share, "
    + ", ".join(f"round(count(*) FILTER (target_bucket = {k}) / count(*), 9) AS bucket_{k}_share, count(*) FILTER (d = {k}) AS domain_{k}" for k in (1, 2, 3))
    + ", count(*) FILTER (d >= 4) AS domain_4_plus, count(*) FILTER (target_bucket = 1 AND w1 = 1 AND w1 + w2 + w3 = 1) AS lead_endpoint, count(*) FILTER (target_bucket = 1 AND w2 = 1 AND w1 + w2 + w3 = 1) AS lead_stay, count(*) FILTER (target_bucket = 1 AND w3 = 1 AND w1 + w2 + w3 = 1) AS lead_degree, count(*) FILTER (target_bucket = 1 AND w1 + w2 + w3 > 1) AS lead_tie FROM w GROUP BY scope"
)
def risk_prevalence(spark, d):
    return risk.prevalence(_risk(spark, d), R)


@query("SELECT u, CASE WHEN d <= 2 THEN 1 WHEN d = 3 THEN 2 ELSE 3 END AS bucket, CAST(greatest(1, least(4, d - 1)) AS INTEGER) AS bucket_of_4 FROM deg")
def degree_bucket(spark, d):
    rows = _domain(spark).groupBy("u").agg(F.max("d").alias("d"))
    return rows.select("u", risk.degree_bucket(F.col("d")).alias("bucket"), risk.degree_bucket(F.col("d"), 4).alias("bucket_of_4"))


_abl = "least(1e0, greatest(0e0, we * re + ws * rs + wd * rd))"


@query(f"SELECT variant, {O.bucket(_abl)} AS bucket, count(*) AS n, round(avg({_abl}), 9) AS mean_score FROM rsk, abl GROUP BY 1, 2")
def ablation_buckets(spark, d):
    rows = staged(_risk(spark, d).select("risk_endpoint", "risk_stay", "risk_degree"), "components")
    out = None
    for name, cfg in CFG.ablations().items():
        part = risk.rebucket(rows, cfg.risk).groupBy(F.col("target_bucket").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("risk_score"), 9).alias("mean_score")).withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("variant", "bucket", "n", "mean_score")


# schedule


@query(f"SELECT sbs_id, t, target_bucket, exec_bucket, round(cost, 9) AS transition_cost, round(rem, 9) AS remaining_before, round(rem - cost, 9) + 0e0 AS remaining_after, CAST(n_t - t AS INTEGER) AS future_after, CAST(1 + CAST({num(P.costs[1])} + (n_t - t) * {num(P.costs[0])} <= rem + 1e-12 AS INTEGER) + CAST({num(P.costs[2])} + (n_t - t) * {num(P.costs[0])} <= rem + 1e-12 AS INTEGER) AS INTEGER) AS n_feasible FROM exe")
def schedule_exec(spark, d):
    return _scheduled(spark, d).select("sbs_id", F.col("t").cast("long"), "target_bucket", "exec_bucket", r("transition_cost"), r("remaining_before"), r("remaining_after"), "future_after", F.size("feasible_buckets").alias("n_feasible"))


@query(
    f"WITH p AS (SELECT sbs_id, sum(cost) AS spent, min(rem - cost) AS margin FROM exe GROUP BY sbs_id), a AS (SELECT count(*) AS pieces, round(max(spent) + {num(P.eps_start)} + {num(P.eps_count)}, 9) AS max_spend, round(min(margin), 9) + 0e0 AS min_margin FROM p) "
    f"SELECT a.*, count(*) AS transitions, count(*) FILTER (exec_bucket < target_bucket) AS fallbacks, count(*) FILTER (exec_bucket > target_bucket) AS weaker, count(*) FILTER (exec_bucket = 1) AS exec_1, count(*) FILTER (exec_bucket = 2) AS exec_2, count(*) FILTER (exec_bucket = 3) AS exec_3, any_value(max_spend <= {num(P.budget)} + 1e-10) AS within_budget FROM exe, a GROUP BY ALL"
)
def schedule_audit(spark, d):
    return schedule.audit(_scheduled(spark, d), P)


# reports


@query("SELECT split, sbs_id, start, start_noisy FROM ends")
def grr_start(spark, d):
    return _ends(spark, d).select("split", "sbs_id", "start", "start_noisy")


@query("SELECT split, sbs_id, cnt, cnt_noisy FROM ends")
def grr_count(spark, d):
    return _ends(spark, d).select("split", "sbs_id", "cnt", "cnt_noisy")


_REP = ["split", "sbs_id", "t", "u", "v", "y", "k_noisy", "keep_flag"]


@query("SELECT split, sbs_id, t, u, v, y, k_noisy, keep_flag, exec_bucket FROM rep")
def grr_transition(spark, d):
    return _reports(spark, d).withColumn("t", F.col("t").cast("long")).select(*_REP, "exec_bucket")


@query("SELECT split, sbs_id, t, u, v, y, k_noisy, keep_flag FROM uni")
def uniform_reports(spark, d):
    return _uniform(spark, d).withColumn("t", F.col("t").cast("long")).select(*_REP)


@query("SELECT split, sbs_id, t, u, v, y, k_noisy, keep_flag, target_bucket, exec_bucket FROM dgr")
def degree_reports(spark, d):
    return _degree(spark, d).withColumn("t", F.col("t").cast("long")).select(*_REP, "target_bucket", "exec_bucket")


@query(f"SELECT split, target_bucket, count(*) AS n, count(*) FILTER (exec_bucket < target_bucket) AS fallbacks, round(avg(keep_flag), 9) AS keep_rate, round(avg({O.keep('epsilon_event', 'dd')}), 9) AS expected_keep_rate FROM rep GROUP BY split, target_bucket")
def keep_rates(spark, d):
    return randomize.keep_rates(_reports(spark, d))


@query("SELECT split, 'u,y,k' AS level, u, y, k_noisy, count(*) AS n FROM rep GROUP BY ALL UNION ALL SELECT split, 'u,y', u, y, NULL, count(*) FROM rep GROUP BY ALL UNION ALL SELECT split, 'u,k', u, NULL, k_noisy, count(*) FROM rep GROUP BY ALL UNION ALL SELECT split, 'u', u, NULL, NULL, count(*) FROM rep GROUP BY ALL UNION ALL SELECT split, 'k', NULL, NULL, k_noisy, count(*) FROM rep GROUP BY ALL")
def report_aggregate(spark, d):
    return randomize.aggregate_reports(_visible(spark, d))


@query("SELECT count(*) AS reports, count(*) FILTER (k_noisy NOT BETWEEN 1 AND 3) AS bad_labels, count(*) FILTER (e.u IS NULL) AS outside_domain, CAST(0 AS INTEGER) AS extra_columns FROM rep LEFT JOIN edge e ON e.u = rep.u AND e.v = rep.y")
def report_audit(spark, d):
    return randomize.report_audit(_visible(spark, d), W.public_edges(spark))


@query("SELECT (SELECT count(*) FROM sbs) AS pieces, (SELECT count(*) FROM tr) AS transitions, 2 * (SELECT count(*) FROM sbs) + (SELECT count(*) FROM tr) AS reports")
def report_volume(spark, d):
    p = _pieces(spark, d).agg(F.count("*").alias("pieces"), F.sum(F.size("segments") - 1).alias("transitions"))
    return p.withColumn("reports", 2 * F.col("pieces") + F.col("transitions"))


# recovery


@query("WITH s AS (SELECT split, start_noisy AS value, count(*) AS n FROM ends GROUP BY ALL), f AS (SELECT *, n / sum(n) OVER (PARTITION BY split) AS f, %s AS p, %s AS q FROM s), x AS (%s) SELECT split, value, round(prob, 6) AS prob FROM x WHERE prob > 0" % (O.keep(num(P.eps_start), "64"), O.other(num(P.eps_start), "64"), O.clipped("f", "split")))
def recover_start(spark, d):
    return recover.recover_start(_ends(spark, d).select("split", F.col("start_noisy").alias("x_noisy")), W.SEGMENTS, P.eps_start).select("split", "value", r("prob", 6))


@query("SELECT split, value, round(prob, 6) AS prob FROM cntx")
def recover_count(spark, d):
    return recover.recover_count(_ends(spark, d).select("split", F.col("cnt_noisy").alias("x_noisy")), P).select("split", "value", r("prob", 6))


@query("WITH x AS (%s) SELECT split, value, round(prob, 6) AS prob FROM x" % O.clipped("cnt0", "split"))
def recover_count_clipped(spark, d):
    return recover.recover_count(_ends(spark, d).select("split", F.col("cnt_noisy").alias("x_noisy")), P, "clipped").select("split", "value", r("prob", 6))


@query("SELECT split, u, k, round(pi_local, 6) AS pi_local, round(pi_global, 6) AS pi_global, round(alpha, 6) AS alpha, round(pi, 6) AS pi FROM mix")
def bucket_mix(spark, d):
    return recover.bucket_mix(_visible(spark, d), P, CFG.recovery).select("split", "u", F.col("k").cast("long").alias("k"), *(r(c, 6) for c in ("pi_local", "pi_global", "alpha", "pi")))


@query("SELECT split, u, v, round(prob, 6) AS prob, CAST(num_reports AS BIGINT) AS num_reports, d AS domain_size, round(p, 9) AS pbar, round(q, 9) AS qbar FROM ctx")
def recover_context(spark, d):
    return _context(spark, d).select("split", "u", "v", r("prob", 6), "num_reports", "domain_size", r("pbar"), r("qbar"))


@query("SELECT split, u, v, round(coalesce(prob, 0), 6) AS prob, CAST(num_reports AS BIGINT) AS num_reports FROM unix")
def recover_uniform(spark, d):
    seen = staged(_uniform(spark, d).select(*randomize.TRANSITION), "reports")
    return recover.recover_uniform(seen, _domain(spark), P.uniform).select("split", "u", "v", r("prob", 6), "num_reports")


@query(None)
def recover_joint(spark, d):
    return recover.recover_joint(_visible(spark, d), _domain(spark), P, CFG.recovery)


@query("SELECT split, u, CAST(max(num_reports) AS BIGINT) AS num_reports, CASE WHEN max(num_reports) >= 20 THEN 'joint' ELSE 'context' END AS source, 1e0 AS total, count(*) AS n_successors, CASE WHEN max(num_reports) < 20 THEN round(max(prob), 6) END AS top FROM ctx GROUP BY split, u")
def recover_joint_marginals(spark, d):
    """The joint recovery's successors for each context: all contexts are there, sums are 1, and those with few reports have the context's recovery."""
    rows = recover.joint_marginals(_visible(spark, d), _domain(spark), P, CFG.recovery)
    few = F.max("num_reports") < CFG.recovery.joint_min_reports
    return rows.groupBy("split", "u").agg(F.max("num_reports").alias("num_reports"), F.max("source").alias("source"), F.round(F.sum("prob"), 6).alias("total"), F.count("*").alias("n_successors"), F.when(few, F.round(F.max("prob"), 6)).alias("top"))


@query(None)
def recover_degree(spark, d):
    seen = staged(_degree(spark, d).select(*randomize.TRANSITION), "reports")
    return recover.recover_joint(seen, _domain(spark), P, CFG.recovery, "mass")


@query("SELECT u, v, round(prob, 6) AS prob FROM mrg")
def merge_distributions(spark, d):
    return _synthesis_input(spark, d)[1].select("u", "v", r("prob", 6))


@query("SELECT v, round(prob, 6) AS prob FROM pri")
def global_prior(spark, d):
    return synthesis.global_prior(_synthesis_input(spark, d)[0]).select("v", r("prob", 6))


# synthesis

_CAND = "round(m.prob / sum(m.prob) OVER w, 6) AS prob, round(sum(m.prob) OVER (w ORDER BY pos) / sum(m.prob) OVER w, 6) AS cum, 'local' AS source"


@query(f"SELECT u, more, v, pos, {_CAND} FROM mrg m JOIN dom USING (u, v), (VALUES (false), (true)) t(more) WINDOW w AS (PARTITION BY u, more) UNION ALL SELECT d.u, more, d.v, pos, round(CASE WHEN sum(coalesce(pri.prob, 0)) OVER w > 0 THEN coalesce(pri.prob, 0) / sum(coalesce(pri.prob, 0)) OVER w ELSE 1e0 / count(*) OVER w END, 6), round(CASE WHEN sum(coalesce(pri.prob, 0)) OVER w > 0 THEN sum(coalesce(pri.prob, 0)) OVER (w ORDER BY pos) / sum(coalesce(pri.prob, 0)) OVER w ELSE count(*) OVER (w ORDER BY pos) / count(*) OVER w END, 6), CASE WHEN sum(coalesce(pri.prob, 0)) OVER w > 0 THEN 'prior' ELSE 'even' END FROM dom d LEFT JOIN pri ON pri.v = d.v, (VALUES (false), (true)) t(more) WHERE d.u NOT IN (SELECT u FROM mrg) WINDOW w AS (PARTITION BY d.u, more)")
def candidate_cdf(spark, d):
    found, trans = _synthesis_input(spark, d)
    out = synthesis.candidates(trans, _domain(spark), synthesis.global_prior(found))
    return out.select("u", "more", "v", "pos", r("prob", 6), r("cum", 6), "source")


@query(None)
def synthesize(spark, d):
    found, trans = _synthesis_input(spark, d)
    ends = staged(_ends(spark, d).where("split <> 'test'"), "ends")
    n = ends.groupBy("split").agg(F.count("*").alias("num_reports"))
    start = recover.merged(recover.recover_start(ends.select("split", F.col("start_noisy").alias("x_noisy")), W.SEGMENTS, P.eps_start).join(n, "split"), ["value"])
    count = recover.merged(recover.recover_count(ends.select("split", F.col("cnt_noisy").alias("x_noisy")), P).join(n, "split"), ["value"])
    options = staged(synthesis.candidates(trans, _domain(spark), synthesis.global_prior(found)), "candidates")
    rows = _pieces(spark, d).where("split = 'test'").count()
    return synthesis.walks(rows, staged(start, "start"), staged(count, "count"), options, P.max_segments, 42 + 7001, spark)


_U = O.uniform("'7'", "concat('syn', i)", "{}")


@query(
    f"""SELECT syn_id, string_agg(seg, ',' ORDER BY n) AS path FROM (
      WITH RECURSIVE cum AS (SELECT u, v, pos, sum(prob) OVER (PARTITION BY u ORDER BY pos) AS c, d FROM (SELECT u, v, pos, d, 1e0 / d AS prob FROM dom)),
      g AS (SELECT i, 1 AS n, printf('s%02d', i % 64) AS seg FROM range(1, 201) t(i)
        UNION ALL SELECT g.i, g.n + 1, (SELECT arg_min(v, pos) FROM cum WHERE cum.u = g.seg AND ({_U.format('CAST(g.n + 1 AS VARCHAR)').replace("'syn', i", "'syn', g.i")} <= c OR pos = d - 1)) FROM g WHERE g.n < 8)
      SELECT concat('syn', i) AS syn_id, n, seg FROM g) GROUP BY syn_id"""
)
def even_walks(spark, d):
    """200 walks of 8 segments where every successor is alike, each from a given start."""
    return _even(spark, synthesis.HELD)


def _even(spark, held):
    dom = _domain(spark)
    none = dom.select("u", "v", F.lit(0.0).alias("prob")).limit(0)
    options = staged(synthesis.candidates(none, dom, none.select("v", "prob")), "candidates")
    rows = spark.range(1, 201).select(F.concat(F.lit("syn"), F.col("id")).alias("syn_id"), W.segment_id(F.col("id") % 64).alias("first"), F.lit(8).alias("target_count"))
    return synthesis.grow(rows, options, 8, 7, held).select("syn_id", F.array_join("path", ",").alias("path"))


def even_walks_by_joins(spark, d):
    """The same by a join for each step, which larger graphs take."""
    return _even(spark, 0)


QUERIES["even_walks_by_joins"], ORACLE_SQL["even_walks_by_joins"] = even_walks_by_joins, ORACLE_SQL["even_walks"]


# metrics


@query("SELECT u, v, n, n_u, round(prob, 9) AS prob FROM (SELECT u, v, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY u) AS BIGINT) AS n_u, count(*) / sum(count(*)) OVER (PARTITION BY u) AS prob FROM tr GROUP BY u, v)")
def transition_distribution(spark, d):
    return evaluate.transition_distribution(_transitions(spark, d)).select("u", "v", "n", "n_u", r("prob"))


@query("WITH c AS (SELECT u, v, exec_bucket AS k, count(*) AS n FROM exe GROUP BY ALL), g AS (SELECT a.u, a.v, b.k, n_v, n_k, n_u, coalesce(n, 0) AS n FROM (SELECT u, v, sum(n) AS n_v FROM c GROUP BY u, v) a JOIN (SELECT u, k, sum(n) AS n_k FROM c GROUP BY u, k) b USING (u) JOIN (SELECT u, sum(n) AS n_u FROM c GROUP BY u) USING (u) LEFT JOIN c ON c.u = a.u AND c.v = a.v AND c.k = b.k), e AS (SELECT u, max(n_u) AS n_u, sum(CASE WHEN n > 0 THEN n / n_u * ln(n / n_u / (n_v * n_k / (n_u * n_u))) ELSE 0 END) AS mi, sum(abs(n / n_u - n_v * n_k / (n_u * n_u))) / 2 AS tv FROM g GROUP BY u) SELECT round(sum(mi * n_u) / sum(n_u), 9) AS mi_nats, round(sum(mi * n_u) / sum(n_u) / ln(2), 9) AS mi_bits, round(sum(tv * n_u) / sum(n_u), 9) AS weighted_tv, round(max(tv), 9) AS max_tv, arg_max(u, (round(tv, 12), u)) AS max_tv_u FROM e")
def conditional_mi(spark, d):
    out = evaluate.conditional_dependence(_scheduled(spark, d).select("u", "v", F.col("exec_bucket").alias("k")))
    return out.select(*(r(c) for c in ("mi_nats", "mi_bits", "weighted_tv", "max_tv")), "max_tv_u")


_SIDE = "SELECT coalesce(t.u, m.u) AS u, coalesce(t.v, m.v) AS v, coalesce(t.prob, 0) AS p, coalesce(m.prob, 0) AS q FROM tru t FULL JOIN mrg m ON m.u = t.u AND m.v = t.v"
_JS = "(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2"


@query(f"WITH x AS ({_SIDE}), n AS (SELECT u, max(n_u) AS n_u FROM tru GROUP BY u), e AS (SELECT u, sum(abs(p - q)) / 2 AS tv FROM x WHERE u IN (SELECT u FROM mrg) GROUP BY u) SELECT count(*) AS contexts, count(tv) AS recovered, round(coalesce(sum(tv * n_u), 0) / sum(n_u), 6) AS weighted_tv, round(coalesce(max(tv), 0), 6) AS max_tv FROM n LEFT JOIN e USING (u)")
def recovery_tv(spark, d):
    truth = evaluate.transition_distribution(_transitions(spark, d).where("split = 'test'"))
    return evaluate.recovery_error(truth, _synthesis_input(spark, d)[1]).select("contexts", "recovered", r("weighted_tv", 6), r("max_tv", 6))


@query(f"WITH x AS ({_SIDE}), n AS (SELECT u, max(n_u) AS n_u FROM tru GROUP BY u), e AS (SELECT u, sum({_JS}) AS js FROM x GROUP BY u) SELECT round(sum((CASE WHEN u IN (SELECT u FROM mrg) THEN js ELSE ln(2) / 2 END) * n_u) / sum(n_u), 6) AS transition_js FROM n JOIN e USING (u)")
def transition_js(spark, d):
    truth = evaluate.transition_distribution(_transitions(spark, d).where("split = 'test'"))
    return evaluate.transition_js(truth, _synthesis_input(spark, d)[1]).select(r("transition_js", 6))


def _js_sql(value: str, rows: str) -> str:
    return f"WITH a AS (SELECT {value}, count(*) / sum(count(*)) OVER () AS p FROM {rows} WHERE split = 'train' GROUP BY ALL), b AS (SELECT {value}, count(*) / sum(count(*)) OVER () AS q FROM {rows} WHERE split = 'test' GROUP BY ALL), x AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM a FULL JOIN b USING ({value})) SELECT round(sum({_JS}), 9) AS js FROM x"


@query(_js_sql("u, v", "tr"))
def bigram_js(spark, d):
    rows = staged(_transitions(spark, d).select("split", "u", "v"), "pairs")
    two = lambda s: rows.where(F.col("split") == s).groupBy("u", "v").agg(F.count("*").cast("double").alias("prob"))
    return evaluate.js_divergence(two("train"), two("test"), ["u", "v"]).select(r("js"))


@query(_js_sql("cnt", "(SELECT split, r_j - a_j + 1 AS cnt FROM sbs)"))
def count_js(spark, d):
    rows = staged(_pieces(spark, d).select("split", F.size("segments").alias("cnt")), "lengths")
    of = lambda s: evaluate.distribution(rows.where(F.col("split") == s), "cnt")
    return evaluate.js_divergence(of("train"), of("test"), ["cnt"]).select(r("js"))


@query("SELECT round(avg(CASE WHEN e.u IS NULL THEN 0 ELSE 1 END), 9) AS legal_ratio FROM tr LEFT JOIN (SELECT u, v FROM edge WHERE u <> 's05') e USING (u, v)")
def legal_ratio(spark, d):
    pairs = evaluate.bigrams(_pieces(spark, d))
    return evaluate.legal_ratio(pairs, W.public_edges(spark).where("u <> 's05'")).select(r("legal_ratio"))


@query(
    """WITH a AS (SELECT * FROM rep WHERE split = 'train'), b AS (SELECT * FROM rep WHERE split = 'test'),
    pr AS (SELECT dom.u, dom.v, pos, d, (coalesce(c, 0) + 1e0) / sum(coalesce(c, 0) + 1e0) OVER (PARTITION BY dom.u) AS prior FROM dom LEFT JOIN (SELECT u, v, count(*) AS c FROM a GROUP BY u, v) USING (u, v)),
    g AS (SELECT s.y, s.k_noisy, pr.*, coalesce(c1, 0) AS c1, coalesce(c2, 0) AS c2 FROM (SELECT DISTINCT u, y, k_noisy FROM b) s JOIN pr USING (u) LEFT JOIN (SELECT u, y, v, count(*) AS c1 FROM a GROUP BY ALL) USING (u, y, v) LEFT JOIN (SELECT u, y, k_noisy, v, count(*) AS c2 FROM a GROUP BY ALL) USING (u, y, k_noisy, v)),
    n AS (SELECT *, sum(c1) OVER (PARTITION BY u, y, k_noisy) AS n1, sum(c2) OVER (PARTITION BY u, y, k_noisy) AS n2 FROM g),
    p1 AS (SELECT *, CASE WHEN n1 >= 3 THEN (c1 + 5e0 * prior) / (n1 + 5e0) ELSE prior END AS p1 FROM n),
    p2 AS (SELECT *, CASE WHEN n2 >= 3 THEN (c2 + 5e0 * p1) / (n2 + 5e0) ELSE p1 END AS p, CASE WHEN n2 >= 3 THEN 3 WHEN n1 >= 3 THEN 2 ELSE 1 END AS lvl, CASE WHEN n2 >= 3 THEN n2 ELSE n1 END AS loc FROM p1),
    st AS (SELECT u, y, k_noisy, arg_max(v, (round(prior, 12), -pos)) AS g0, arg_max(v, (round(p, 12), -pos)) AS g1, -sum(p * ln(p)) AS h, max(d) AS d, max(lvl) AS lvl, max(loc) AS loc FROM p2 GROUP BY ALL),
    r AS (SELECT b.v, st.*, p2.p, unnest(CASE WHEN st.d > 1 THEN ['all', 'branching'] ELSE ['all'] END) AS scope FROM b JOIN st USING (u, y, k_noisy) JOIN p2 ON p2.u = b.u AND p2.y = b.y AND p2.k_noisy = b.k_noisy AND p2.v = b.v)
    SELECT scope, count(*) AS n, round(avg(CAST(g0 = v AS DOUBLE)), 6) AS prior_top1, round(avg(CAST(g1 = v AS DOUBLE)), 6) AS posterior_top1, round(avg(CAST(g1 = v AS DOUBLE)) - avg(CAST(g0 = v AS DOUBLE)), 6) AS advantage, round(avg(h), 6) AS entropy, round(avg(CASE WHEN d > 1 THEN h / ln(d) ELSE 0 END), 6) AS normalized_entropy, round(avg(-ln(greatest(p, 1e-15))), 6) AS nll, round(avg(p), 6) AS p_true, round(avg(loc), 6) AS support, count(*) FILTER (lvl = 1) AS level_u, count(*) FILTER (lvl = 2) AS level_uy, count(*) FILTER (lvl = 3) AS level_uyk FROM r GROUP BY scope"""
)
def attack_metrics(spark, d):
    rows = staged(_reports(spark, d).select("split", "u", "v", "y", "k_noisy"), "debug")
    out = evaluate.attack(rows.where("split = 'train'"), rows.where("split = 'test'"), _domain(spark))
    return out.select("scope", "n", *(r(c, 6) for c in ("prior_top1", "posterior_top1", "advantage", "entropy", "normalized_entropy", "nll", "p_true", "support")), "level_u", "level_uy", "level_uyk")


def _ratio(a: str, b: str) -> str:
    return f"abs(ln(({a}) / ({b})))"


_p = {f"{n}{i}": f(f"e{i}", "d") for n, f in (("p", O.keep), ("q", O.other)) for i in (1, 2)}


@query(f"SELECT d, round(max(CASE WHEN d = 1 THEN 0e0 ELSE greatest({_ratio(_p['p1'], _p['p2'])}, {_ratio(_p['p1'], 'CASE WHEN d = 1 THEN 1e0 ELSE ' + _p['q2'] + ' END')}, {_ratio('CASE WHEN d = 1 THEN 1e0 ELSE ' + _p['q1'] + ' END', _p['p2'])}, {_ratio('CASE WHEN d = 1 THEN 1e0 ELSE ' + _p['q1'] + ' END', 'CASE WHEN d = 1 THEN 1e0 ELSE ' + _p['q2'] + ' END')}) END), 9) AS max_log_ratio FROM (SELECT CAST(unnest(range(1, 21)) AS INTEGER) AS d), (SELECT unnest([{', '.join(num(e) for e in P.eps_event)}]) AS e1), (SELECT unnest([{', '.join(num(e) for e in P.eps_event)}]) AS e2) GROUP BY d")
def grr_log_ratio(spark, d):
    return audits.log_ratio(spark, P).select("d", r("max_log_ratio"))


@query("SELECT count(*) AS matched, CAST(0 AS BIGINT) AS alone, CAST(0 AS BIGINT) AS different FROM tr")
def alignment_audit(spark, d):
    return audits.alignment(_transitions(spark, d), _risk(spark, d))


@query(f"SELECT count(*) AS reports, CAST(0 AS BIGINT) AS outside_domain, CAST(0 AS INTEGER) AS extra_columns FROM ends WHERE cnt_noisy BETWEEN 1 AND {O.L}")
def count_report_audit(spark, d):
    return randomize.count_audit(_ends(spark, d).select("split", F.col("cnt_noisy").alias("x_noisy")), P.max_segments)


@query("SELECT count(*) AS reports, count(*) FILTER (start_noisy = 's05') AS outside_domain, CAST(1 AS INTEGER) AS extra_columns FROM ends")
def start_report_audit(spark, d):
    """Against a public graph without one segment, and with a column that does not belong."""
    rows = _ends(spark, d).select("split", F.col("start_noisy").alias("x_noisy"), "sbs_id")
    return randomize.start_audit(rows, W.public_edges(spark).where("u <> 's05' and v <> 's05'"))


@query("SELECT 'train' AS split, count(*) AS matched, CAST(0 AS BIGINT) AS alone, count(*) FILTER (v <> 's09' AND t = 2) AS different FROM tr WHERE split = 'train'")
def alignment_of_changed_rows(spark, d):
    """Risk rows whose second successors have been overwritten."""
    rows = staged(_transitions(spark, d).where("split = 'train'"), "transitions")
    changed = rows.withColumn("v", F.when(F.col("t") == 2, "s09").otherwise(F.col("v")))
    return audits.alignment(rows, changed).select(F.lit("train").alias("split"), "*")


# summaries of sequences


@query(
    f"""WITH s AS (SELECT k.split, np FROM (SELECT unnest(['train', 'valid', 'test']) AS split) k LEFT JOIN (SELECT split, np FROM par JOIN spl USING (traj_id)) x USING (split))
    SELECT split, count(np) AS num_records, round(coalesce(avg(np), 0), 9) AS avg_segments, coalesce(median(np), 0e0) AS median_segments, coalesce(list_sort(list(np) FILTER (np IS NOT NULL))[CAST(ceil(0.95 * count(np)) AS BIGINT)], 0) AS p95_segments,
    coalesce(min(np), 0) AS min_segments, coalesce(max(np), 0) AS max_segments, count(*) FILTER (np > {O.L}) AS num_long, round(coalesce(count(*) FILTER (np > {O.L}) / nullif(count(np), 0), 0), 9) AS fraction_long FROM s GROUP BY split"""
)
def split_lengths(spark, d):
    out = summaries.split_lengths(sequences.split_of(_walks(spark, d), "traj_id"), P.max_segments)
    return out.withColumns({"avg_segments": F.round("avg_segments", 9), "fraction_long": F.round("fraction_long", 9)})


@query(
    """WITH q AS (SELECT split, traj_id, count(*) AS q, max(np) AS n, max(r_j - a_j + 1) AS most, sum(r_j - a_j) AS held FROM sbs GROUP BY ALL),
    p AS (SELECT split, count(*) AS num_parents, sum(q) AS num_pieces, count(*) FILTER (q = 1) AS num_single, count(*) FILTER (q > 1) AS num_multi, max(q) AS max_pieces, sum(n) AS total, max(most) AS most, sum(held) / sum(n - 1) AS min_coverage FROM q GROUP BY split)
    SELECT 'walks' AS dataset, split, CAST(sum(num_parents) AS BIGINT) AS num_parents, CAST(sum(num_pieces) AS BIGINT) AS num_pieces, CAST(sum(num_single) AS BIGINT) AS num_single, CAST(sum(num_multi) AS BIGINT) AS num_multi, round(sum(num_multi) / sum(num_parents), 9) AS fraction_multi,
    round(sum(num_pieces) / sum(num_parents), 9) AS avg_pieces, CAST(max(max_pieces) AS BIGINT) AS max_pieces, round(sum(total) / sum(num_parents), 9) AS avg_parent_segments, CAST(max(most) AS INTEGER) AS max_piece_segments, min(min_coverage) AS min_coverage FROM p GROUP BY GROUPING SETS ((split), ())"""
)
def piece_statistics(spark, d):
    return summaries.piece_statistics(_pieces(spark, d))


_ID = "CAST(substr(traj_id, 2) AS BIGINT) % 5"


@query(f"SELECT CASE WHEN {_ID} = 2 THEN 'no_segments' WHEN np < 2 OR {_ID} = 0 THEN 'fewer_than_two' WHEN {_ID} = 3 THEN 'empty_segment' WHEN {_ID} = 1 THEN 'times_of_other_length' END AS fault, count(*) AS n FROM par GROUP BY 1")
def sequence_faults(spark, d):
    """Faults of walks that have been damaged, each fifth in another way."""
    k = F.substring("traj_id", 2, 20).cast("long") % 5
    damaged = F.when(k == 2, None).when(k == 0, F.slice("segments", 1, 1)).when(k == 3, F.concat(F.array(F.lit("")), F.slice("segments", 2, 1_000_000))).otherwise(F.col("segments"))
    times = F.when(k == 1, F.slice("segment_times", 2, 1_000_000)).when(k == 0, F.slice("segment_times", 1, 1)).otherwise(F.col("segment_times"))
    rows = _walks(spark, d).withColumns({"segments": damaged, "segment_times": times})
    return rows.groupBy(sequences.faults(rows).alias("fault")).agg(F.count("*").alias("n"))


# experiments: rows as if of runs, made from the line items


@query("SELECT l_shipmode AS dataset, l_returnflag AS profile, l_linestatus AS method, count(DISTINCT l_linenumber) AS seeds, round(avg(l_quantity), 6) AS q_mean, round(coalesce(stddev_samp(l_quantity), 0), 6) AS q_std, min(l_quantity) AS q_min, max(l_quantity) AS q_max FROM (SELECT *, CAST(l_suppkey % 3 AS VARCHAR) AS l_shipmode FROM lineitem) GROUP BY ALL HAVING count(DISTINCT l_linenumber) >= 5")
def seed_mean_std(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_suppkey") % 3).cast("string").alias("dataset"), F.col("l_returnflag").alias("profile"), F.col("l_linestatus").alias("method"), F.col("l_linenumber").alias("seed"), F.col("l_quantity").alias("q"))
    out = evaluate.seed_statistics(rows, ["q"], min_seeds=5)
    return out.withColumns({"q_mean": F.round("q_mean", 6), "q_std": F.round("q_std", 6)})


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 9) AS r2 FROM lineitem")
def ols_fit(spark, d):
    return evaluate.line_fit(spark.read.parquet(f"{d}/lineitem.parquet"), "l_quantity", "l_extendedprice").select(r("slope", 6), r("intercept", 4), r("r2"))


@query("WITH e AS (SELECT list_sort(list_distinct([quantile_disc(l, 0.25), quantile_disc(l, 0.5), quantile_disc(l, 0.75)])) AS e, max(l) AS m FROM (SELECT length(text) AS l FROM documents)), x AS (SELECT l, len(list_filter(e, lambda v: v < l)) AS bin, e, m FROM (SELECT length(text) AS l FROM documents), e) SELECT CAST(bin AS INTEGER) AS bin, concat(CASE WHEN bin = 0 THEN 0 ELSE e[bin] + 1 END, '-', coalesce(e[bin + 1], m)) AS label, count(*) AS n FROM x GROUP BY ALL")
def length_bins(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select(F.char_length("text").alias("l"))
    return evaluate.length_bins(rows, "l").groupBy("bin", "label").agg(F.count("*").alias("n"))


# trips: made from the orders, since no table holds any

_TRIPS = "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS taxi, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS t0, o_orderkey % 7 = 0 AS missing, 8 + o_custkey % 6 AS n FROM orders"


def _raw_trips(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    n = 8 + F.col("o_custkey") % 6
    at = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.array(((F.col("o_orderkey") + i) % 50).cast("double"), ((F.col("o_custkey") + 2 * i) % 50).cast("double")))
    return o.select(F.col("o_orderkey").cast("string").alias("TRIP_ID"), F.col("o_custkey").cast("string").alias("TAXI_ID"), F.unix_timestamp("o_orderdate").cast("string").alias("TIMESTAMP"), F.when(F.col("o_orderkey") % 7 == 0, "True").otherwise("False").alias("MISSING_DATA"), F.when(F.col("o_orderkey") % 11 == 0, "[[1.0, 2.0], [3").otherwise(F.to_json(at)).alias("POLYLINE"))


@query(f"SELECT id AS traj_id, taxi AS taxi_id, t0 AS start_timestamp, n AS n_points FROM ({_TRIPS}) WHERE NOT missing AND n >= 10 AND CAST(id AS BIGINT) % 11 <> 0")
def trip_parse(spark, d):
    return trips.parse_trips(_raw_trips(spark, d)).select("traj_id", "taxi_id", "start_timestamp", F.size("points").cast("long").alias("n_points"))


@query(f"SELECT id AS traj_id, i AS n, t0 + 15 * i AS tau FROM (SELECT *, unnest(range(0, n)) AS i FROM ({_TRIPS}) WHERE NOT missing AND n >= 10 AND CAST(id AS BIGINT) % 11 <> 0)")
def point_times(spark, d):
    rows = trips.point_times(trips.parse_trips(_raw_trips(spark, d)))
    return rows.select("traj_id", F.posexplode("point_times").alias("n", "tau")).select("traj_id", F.col("n").cast("long").alias("n"), "tau")


def _matched(spark, d):
    """Trips on a grid of 50 by 50 nodes with roads to the east and the north, and back at the edges."""
    nodes = spark.range(2500).select(F.concat((F.col("id") % 50).cast("string"), F.lit(","), F.floor(F.col("id") / 50).cast("string")).alias("node"), (F.col("id") % 50).cast("double").alias("lon"), F.floor(F.col("id") / 50).cast("double").alias("lat"))
    name = lambda x, y: F.concat((x % 50).cast("int").cast("string"), F.lit(","), (y % 50).cast("int").cast("string"))
    x, y = F.col("lon"), F.col("lat")
    east = nodes.select(name(x, y).alias("src"), name(x + 1, y).alias("dst"), F.lit(0).alias("key"), F.lit(1.0).alias("length"))
    north = nodes.select(name(x, y).alias("src"), name(x, y + 1).alias("dst"), F.lit(0).alias("key"), F.lit(1.25).alias("length"))
    rows = trips.point_times(trips.parse_trips(_raw_trips(spark, d)))
    return trips.match(rows, nodes, graph.best_parallel(east.union(north)), spark, cell=1.0)


@query(f"SELECT id AS traj_id, 3 * (n - 1) AS n_segments, t0 AS first_time, CAST(NULL AS VARCHAR) AS reason FROM ({_TRIPS}) WHERE NOT missing AND n >= 10 AND CAST(id AS BIGINT) % 11 <> 0")
def map_match_grid(spark, d):
    return _matched(spark, d).select("traj_id", F.size("segments").cast("long").alias("n_segments"), F.get("segment_times", F.lit(0)).alias("first_time"), "reason")
