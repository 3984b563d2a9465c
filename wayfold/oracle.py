"""SQL of the shared steps, as common table expressions that the oracles of the queries put together."""

from __future__ import annotations

import re

from .config import ExperimentConfig, RiskConfig, ablation_weights

#: The settings of the registered queries. The events are hours apart, so a long stay is a day.
CFG = ExperimentConfig(risk=RiskConfig(stay_seconds=86400.0))
P, R = CFG.privacy, CFG.risk
L = P.max_segments


def num(x: float) -> str:
    return f"{x!r}" if "e" in repr(x) else f"{x!r}e0"


def uniform(*parts: str) -> str:
    return f"(CAST(concat('0x', substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13)) AS BIGINT) / 4503599627370496e0)"


def keep(eps: str, d: str) -> str:
    return f"(CASE WHEN {d} = 1 THEN 1e0 ELSE exp({eps}) / (exp({eps}) + {d} - 1) END)"


def other(eps: str, d: str) -> str:
    return f"(CASE WHEN {d} = 1 THEN 0e0 ELSE 1e0 / (exp({eps}) + {d} - 1) END)"


def respond(pos: str, d: str, eps: str, keep_: str, pick: str) -> str:
    return f"(CASE WHEN {d} = 1 OR {keep_} < {keep(eps, d)} THEN {pos} ELSE ({pos} + 1 + CAST(floor({pick} * ({d} - 1)) AS INTEGER)) % {d} END)"


def bucket(score: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {num(t)} THEN {k}" for k, t in enumerate(R.thresholds, 1)) + f" ELSE {R.buckets} END"


def pick(target: str, rem: str, future: str) -> str:
    least = num(min(P.costs))
    return "CASE " + " ".join(f"WHEN {target} >= {k} AND {num(P.costs[k - 1])} + ({future}) * {least} <= {rem} + 1e-12 THEN {k}" for k in range(R.buckets, 1, -1)) + " ELSE 1 END"


def by_bucket(values, k: str) -> str:
    return f"CASE {k} " + " ".join(f"WHEN {i} THEN {num(v)}" for i, v in enumerate(values, 1)) + " END"


def seed(base: tuple[int, int, int]) -> str:
    return "CASE split " + " ".join(f"WHEN '{s}' THEN '{420000 + o}'" for s, o in zip(("train", "valid", "test"), base, strict=True)) + " END"


def inverse(name: str, src: str, groups: str, key: str) -> dict[str, str]:
    """Constrained inverse of src (b, p, q) within groups, and the simplex: adds prob."""
    g, r = f"PARTITION BY {groups}", num(CFG.recovery.ridge)
    return {
        f"{name}1": f"SELECT *, p - q AS dl, sum(b) OVER ({g}) AS bt, sum(b) OVER ({g} ORDER BY b DESC, {key} ROWS UNBOUNDED PRECEDING) AS cb, row_number() OVER ({g} ORDER BY b DESC, {key}) AS s FROM {src}",
        f"{name}2": f"SELECT *, q * (1 + dl) * ((dl * cb + s * q * bt) / (dl * dl + {r} + s * q * (1 + dl))) - q * bt AS c FROM {name}1",
        f"{name}3": f"SELECT *, arg_max(c, s) FILTER (dl * b - c > 0) OVER ({g}) AS cl FROM {name}2",
        f"{name}4": f"SELECT *, coalesce(greatest(0e0, (dl * b - cl) / (dl * dl + {r})), 0e0) AS y0 FROM {name}3",
        f"{name}5": f"SELECT *, sum(y0) OVER ({g} ORDER BY y0 DESC, {key} ROWS UNBOUNDED PRECEDING) AS sc, row_number() OVER ({g} ORDER BY y0 DESC, {key}) AS sj FROM {name}4",
        f"{name}6": f"SELECT *, arg_max((sc - 1) / sj, sj) FILTER (y0 - (sc - 1) / sj > 0) OVER ({g}) AS th FROM {name}5",
        f"{name}7": f"SELECT *, coalesce(greatest(0e0, y0 - th), 0e0) AS y1 FROM {name}6",
        name: f"SELECT *, CASE WHEN sum(y1) OVER ({g}) > 0 THEN y1 / sum(y1) OVER ({g}) ELSE 1e0 / count(*) OVER ({g}) END AS prob FROM {name}7",
    }


def clipped(src: str, groups: str) -> str:
    g = f"PARTITION BY {groups}"
    x = "greatest(0e0, CASE WHEN abs(p - q) > 1e-15 THEN (f - q) / (p - q) ELSE f END)"
    return f"SELECT *, CASE WHEN sum({x}) OVER ({g}) > 0 THEN {x} / sum({x}) OVER ({g}) ELSE f / nullif(sum(f) OVER ({g}), 0) END AS prob FROM {src}"


_score = f"least(1e0, greatest(0e0, {num(R.lambda_e)} * re + {num(R.lambda_s)} * rs + {num(R.lambda_d)} * rd))"


def reports(src: str, eps: str, k: str, seeds, target: str = "target_bucket") -> str:
    """Successor and bucket reports of src (split, sbs_id, t, u, v, and what eps and k are made of)."""
    s = seed(seeds)
    draw = lambda name: uniform(s, "sbs_id", "t", f"'{name}'")
    return f"""SELECT x.*, dom.v AS y, CAST({respond(f"({k} - 1)", str(R.buckets), num(P.eps_bucket), draw('k0'), draw('k1'))} + 1 AS INTEGER) AS k_noisy, CAST(dom.v = x.v AS INTEGER) AS keep_flag
      FROM (SELECT s.*, dom.d AS dd, {eps} AS epsilon_event, {respond('dom.pos', 'dom.d', f'({eps})', draw('y0'), draw('y1'))} AS at FROM {src} s JOIN dom USING (u, v)) x JOIN dom ON dom.u = x.u AND dom.pos = x.at"""


CTES: dict[str, str] = {
    "ev": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(epoch(ts)) AS BIGINT) AS tau FROM events",
    "walk": "SELECT user_id, n, k % 64 AS s, tau FROM ev WHERE n = 1 UNION ALL SELECT e.user_id, e.n, (3 * w.s + 7 * (e.k % (1 + w.s % 4)) + 1) % 64, e.tau FROM walk w JOIN ev e ON e.user_id = w.user_id AND e.n = w.n + 1",
    "pt": "SELECT concat('u', user_id) AS traj_id, n, printf('s%02d', s) AS seg, tau FROM walk",
    "par": "SELECT traj_id, count(*) AS np FROM pt GROUP BY traj_id",
    "edge": "SELECT printf('s%02d', s) AS u, printf('s%02d', (3 * s + 7 * j + 1) % 64) AS v FROM range(64) a(s), range(4) b(j) WHERE j <= s % 4",
    "dom": "SELECT u, v, CAST(row_number() OVER (PARTITION BY u ORDER BY v) - 1 AS INTEGER) AS pos, CAST(count(*) OVER (PARTITION BY u) AS INTEGER) AS d FROM edge",
    "deg": "SELECT u, max(d) AS d FROM dom GROUP BY u",
    "spl": f"SELECT traj_id, CASE WHEN rk <= floor(n * 0.8e0) THEN 'train' WHEN rk <= floor(n * 0.8e0) + floor(n * 0.1e0) THEN 'valid' ELSE 'test' END AS split FROM (SELECT traj_id, row_number() OVER (ORDER BY {uniform("'42'", "'split'", 'traj_id')}, traj_id) AS rk, count(*) OVER () AS n FROM par)",
    "sbs": f"SELECT *, concat(traj_id, '::sbs', sbs_index) AS sbs_id, (sbs_index - 1) * {L - 1} + 1 AS a_j, least(np, (sbs_index - 1) * {L - 1} + {L}) AS r_j FROM (SELECT traj_id, split, np, CAST(ceil((np - 1) / {L - 1}e0) AS INTEGER) AS q, unnest(range(1, CAST(ceil((np - 1) / {L - 1}e0) AS INTEGER) + 1)) AS sbs_index FROM par JOIN spl USING (traj_id) WHERE np >= 2)",
    "tr": "SELECT b.traj_id, split, sbs_id, sbs_index, r_j - a_j + 1 AS cnt, r_j - a_j AS n_t, x.n - a_j + 1 AS t, x.n AS global_pos, x.seg AS u, y.seg AS v, x.tau AS tau_u, y.tau AS tau_v, CAST(y.tau - x.tau AS DOUBLE) AS delta_t, s.seg AS start, e.seg AS stop FROM sbs b JOIN pt x ON x.traj_id = b.traj_id AND x.n BETWEEN a_j AND r_j - 1 JOIN pt y ON y.traj_id = x.traj_id AND y.n = x.n + 1 JOIN pt s ON s.traj_id = b.traj_id AND s.n = a_j JOIN pt e ON e.traj_id = b.traj_id AND e.n = r_j",
    "bfs": "SELECT DISTINCT u AS a, u AS b, 0 AS h FROM edge UNION SELECT bfs.a, edge.v, h + 1 FROM bfs JOIN edge ON edge.u = bfs.b WHERE h < 12",
    "way": "SELECT a, b, min(h) AS h FROM bfs GROUP BY a, b",
    "hop": "SELECT coalesce(f.a, g.b) AS a, coalesce(f.b, g.a) AS b, least(f.h, g.h) AS hops FROM way f FULL JOIN way g ON g.a = f.b AND g.b = f.a",
    "anc": "SELECT DISTINCT sbs_id, pos, seg FROM (SELECT sbs_id, t - 1 AS pos, u AS seg FROM tr WHERE delta_t >= 86400 UNION ALL SELECT sbs_id, t, v FROM tr WHERE delta_t >= 86400)",
    "stay": "SELECT sbs_id, u, min(hops) AS ds FROM (SELECT DISTINCT sbs_id, u FROM tr) JOIN (SELECT DISTINCT sbs_id, seg FROM anc) USING (sbs_id) JOIN hop ON a = u AND b = seg GROUP BY sbs_id, u",
    "rsk": f"SELECT tr.*, h1.hops AS d1, h2.hops AS d2, ds, coalesce(na, 0) AS na, d, greatest(exp(-h1.hops / {num(R.sigma_e)}), exp(-h2.hops / {num(R.sigma_e)})) AS re, coalesce(exp(-ds / {num(R.sigma_st)}), 0e0) AS rs, 1e0 / d AS rd FROM tr JOIN hop h1 ON h1.a = u AND h1.b = start JOIN hop h2 ON h2.a = u AND h2.b = stop LEFT JOIN stay USING (sbs_id, u) LEFT JOIN (SELECT sbs_id, count(DISTINCT seg) AS na FROM anc GROUP BY sbs_id) USING (sbs_id) JOIN deg USING (u)",
    "scr": f"SELECT *, {_score} AS score, {bucket(_score)} AS target_bucket FROM rsk",
    "sch": f"SELECT sbs_id, CAST(1 AS BIGINT) AS t, n_t, {pick('target_bucket', num(P.for_transitions), 'n_t - 1')} AS k, {num(P.for_transitions)} AS rem FROM scr WHERE t = 1 UNION ALL SELECT s.sbs_id, s.t, s.n_t, {pick('s.target_bucket', '(p.rem - ' + by_bucket(P.costs, 'p.k') + ')', 's.n_t - s.t')}, p.rem - {by_bucket(P.costs, 'p.k')} FROM sch p JOIN scr s ON s.sbs_id = p.sbs_id AND s.t = p.t + 1",
    "exe": f"SELECT scr.*, sch.k AS exec_bucket, {by_bucket(P.costs, 'sch.k')} AS cost, sch.rem AS rem FROM scr JOIN sch USING (sbs_id, t)",
    "rep": reports("exe", by_bucket(P.eps_event, "exec_bucket"), "exec_bucket", (101, 202, 303)),
    "uni": reports("scr", num(P.uniform), str(P.uniform_bucket), (1101, 1202, 1303)),
    "dgt": "SELECT tr.*, CASE WHEN d <= 2 THEN 1 WHEN d = 3 THEN 2 ELSE 3 END AS target_bucket FROM tr JOIN deg USING (u)",
    "dgs": f"SELECT sbs_id, CAST(1 AS BIGINT) AS t, n_t, {pick('target_bucket', num(P.for_transitions), 'n_t - 1')} AS k, {num(P.for_transitions)} AS rem FROM dgt WHERE t = 1 UNION ALL SELECT s.sbs_id, s.t, s.n_t, {pick('s.target_bucket', '(p.rem - ' + by_bucket(P.costs, 'p.k') + ')', 's.n_t - s.t')}, p.rem - {by_bucket(P.costs, 'p.k')} FROM dgs p JOIN dgt s ON s.sbs_id = p.sbs_id AND s.t = p.t + 1",
    "dge": "SELECT dgt.*, dgs.k AS exec_bucket FROM dgt JOIN dgs USING (sbs_id, t)",
    "dgr": reports("dge", by_bucket(P.eps_event, "exec_bucket"), "exec_bucket", (5101, 5202, 5303)),
    "segs": "SELECT seg, CAST(row_number() OVER (ORDER BY seg) - 1 AS INTEGER) AS pos, CAST(count(*) OVER () AS INTEGER) AS d FROM (SELECT u AS seg FROM edge UNION SELECT v FROM edge)",
    "ends": f"SELECT x.split, x.sbs_id, x.start, z.seg AS start_noisy, x.cnt, CAST({respond('(x.cnt - 1)', str(L), num(P.eps_count), uniform(seed((101, 202, 303)), 'sbs_id', chr(39) + 'count0' + chr(39)), uniform(seed((101, 202, 303)), 'sbs_id', chr(39) + 'count1' + chr(39)))} + 1 AS INTEGER) AS cnt_noisy FROM (SELECT split, sbs_id, pt.seg AS start, CAST(r_j - a_j + 1 AS INTEGER) AS cnt, {respond('segs.pos', 'segs.d', num(P.eps_start), uniform(seed((101, 202, 303)), 'sbs_id', chr(39) + 'start0' + chr(39)), uniform(seed((101, 202, 303)), 'sbs_id', chr(39) + 'start1' + chr(39)))} AS at FROM sbs JOIN pt ON pt.traj_id = sbs.traj_id AND pt.n = a_j JOIN segs ON segs.seg = pt.seg) x JOIN segs z ON z.pos = x.at",
    "cnt0": f"SELECT split, value, coalesce(n, 0) AS n, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY split) AS b, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY split) AS f, {keep(num(P.eps_count), str(L))} AS p, {other(num(P.eps_count), str(L))} AS q FROM (SELECT DISTINCT split FROM ends) CROSS JOIN (SELECT CAST(unnest(range(1, {L + 1})) AS INTEGER) AS value) LEFT JOIN (SELECT split, cnt_noisy AS value, count(*) AS n FROM ends GROUP BY ALL) USING (split, value)",
    **inverse("cntx", "cnt0", "split", "value"),
    "ml0": f"SELECT split, u, k, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY split, u) AS b, sum(coalesce(n, 0)) OVER (PARTITION BY split, u) AS num_reports, {keep(num(P.eps_bucket), str(R.buckets))} AS p, {other(num(P.eps_bucket), str(R.buckets))} AS q FROM (SELECT DISTINCT split, u FROM rep) CROSS JOIN (SELECT unnest(range(1, {R.buckets + 1})) AS k) LEFT JOIN (SELECT split, u, k_noisy AS k, count(*) AS n FROM rep GROUP BY ALL) USING (split, u, k)",
    **inverse("mlx", "ml0", "split, u", "k"),
    "mg0": f"SELECT split, k, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY split) AS b, {keep(num(P.eps_bucket), str(R.buckets))} AS p, {other(num(P.eps_bucket), str(R.buckets))} AS q FROM (SELECT DISTINCT split FROM rep) CROSS JOIN (SELECT unnest(range(1, {R.buckets + 1})) AS k) LEFT JOIN (SELECT split, k_noisy AS k, count(*) AS n FROM rep GROUP BY ALL) USING (split, k)",
    **inverse("mgx", "mg0", "split", "k"),
    "mix": f"SELECT *, m / sum(m) OVER (PARTITION BY split, u) AS pi FROM (SELECT split, u, k, num_reports, a.prob AS pi_local, g.prob AS pi_global, num_reports / (num_reports + {num(CFG.recovery.tau)}) AS alpha, num_reports / (num_reports + {num(CFG.recovery.tau)}) * a.prob + (1 - num_reports / (num_reports + {num(CFG.recovery.tau)})) * g.prob AS m FROM mlx a JOIN mgx g USING (split, k))",
    "chn": f"SELECT split, u, d, sum(pi * {keep(by_bucket(P.eps_event, 'k'), 'd')}) AS p, sum(pi * {other(by_bucket(P.eps_event, 'k'), 'd')}) AS q, max(num_reports) AS num_reports FROM mix JOIN deg USING (u) GROUP BY split, u, d",
    "ctx0": "SELECT c.*, dom.v, coalesce(n, 0) / num_reports AS b FROM chn c JOIN dom USING (u) LEFT JOIN (SELECT split, u, y AS v, count(*) AS n FROM rep GROUP BY ALL) r ON r.split = c.split AND r.u = c.u AND r.v = dom.v",
    **inverse("ctx", "ctx0", "split, u", "v"),
    "uni0": f"SELECT a.split, a.u, dom.v, dom.d, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY a.split, a.u) AS num_reports, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY a.split, a.u) AS f, {keep(num(P.uniform), 'dom.d')} AS p, {other(num(P.uniform), 'dom.d')} AS q FROM (SELECT DISTINCT split, u FROM uni) a JOIN dom ON dom.u = a.u LEFT JOIN (SELECT split, u, y AS v, count(*) AS n FROM uni GROUP BY ALL) r ON r.split = a.split AND r.u = a.u AND r.v = dom.v",
    "unix": clipped("uni0", "split, u"),
    "mrg": "SELECT u, v, m / sum(m) OVER (PARTITION BY u) AS prob FROM (SELECT u, v, sum(prob * greatest(num_reports, 1)) AS m FROM ctx WHERE split <> 'test' GROUP BY u, v) WHERE m > 0",
    "tru": "SELECT u, v, count(*) AS n, sum(count(*)) OVER (PARTITION BY u) AS n_u, count(*) / sum(count(*)) OVER (PARTITION BY u) AS prob FROM tr WHERE split = 'test' GROUP BY u, v",
    "pri": "SELECT v, m / sum(m) OVER () AS prob FROM (SELECT v, sum(prob * greatest(num_reports, 1)) AS m FROM ctx WHERE split <> 'test' GROUP BY v)",
    "abl": " UNION ALL ".join(f"SELECT '{n}' AS variant, {num(float(w[0]))} AS we, {num(float(w[1]))} AS ws, {num(float(w[2]))} AS wd" for n, w in ablation_weights(R).items()),
}


def sql(body: str) -> str:
    """body with the expressions that it uses, and those that they use."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in CTES:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.append(name)
                add(CTES[name])

    add(body)
    parts = [f"{n} AS ({CTES[n]})" for n in CTES if n in need]
    if not parts:
        return body
    own = body.removeprefix("WITH ")
    return "WITH RECURSIVE " + ",\n".join(parts) + (",\n" if own != body else "\n") + own
