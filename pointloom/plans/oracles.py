"""DuckDB SQL for the registered queries, put together from common table expressions.

``chain`` writes the whole pipeline once for a points table; queries pick what
they need from it.  REAL arithmetic there stays REAL, division and square root
included, as long as both sides are REAL.
"""

from __future__ import annotations

from ..functions import colors
from ..operators.report import IMPLEMENTATIONS
from ..sources.scans import FIXTURE_SQL

POINTS = f"pts AS ({FIXTURE_SQL.format(F='REAL', lineitem='lineitem')})"
ROI = "x >= -40::REAL AND x < 40::REAL AND y >= -40::REAL AND y < 40::REAL AND z >= -3::REAL AND z < 2::REAL"
IX, IY, IZ = (f"least(floor(({c} - {lo}::REAL) / 0.2::REAL), {n - 1})::BIGINT" for c, lo, n in (("x", "(-40)", 400), ("y", "(-40)", 400), ("z", "(-3)", 25)))
KEY = f"({IZ} * 400 + {IY}) * 400 + {IX}"
CX, CY = (f"floor(({c} - (-40)::REAL) / 0.4::REAL)::BIGINT" for c in "xy")
CELL = f"CASE WHEN {CX} BETWEEN 0 AND 199 AND {CY} BETWEEN 0 AND 199 THEN ({CY} * 200 + {CX})::INTEGER END"
INLIER = "abs(a * x + b * y + c * z + d) < 0.2::REAL"


def chain(t: str = "", points: str = "pts", iters: int = 256, scans: str | None = None, vox: str | None = None) -> list[str]:
    """Common table expressions of the pipeline over ``points``, their names ending in ``t``."""
    scans = scans or f"SELECT DISTINCT scan_id, 1000 + scan_id AS seed FROM {points}"
    vox = vox or f"SELECT scan_id, key, count(*) AS n, avg(x::DOUBLE)::REAL AS x, avg(y::DOUBLE)::REAL AS y, avg(z::DOUBLE)::REAL AS z FROM (SELECT scan_id, x, y, z, {KEY} AS key FROM {points} WHERE {ROI}) GROUP BY 1, 2"
    return [
        f"scans{t} AS ({scans})",
        f"vox{t} AS MATERIALIZED ({vox})",
        f"ranked{t} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY key) - 1 AS rn, count(*) OVER (PARTITION BY scan_id) AS nv FROM vox{t})",
        f"rng{t}(scan_id, k, s) AS (SELECT scan_id, -1, seed::UBIGINT FROM scans{t} UNION ALL SELECT scan_id, k + 1, xor(v, (v << 5) & 4294967295) FROM "
        f"(SELECT scan_id, k, xor(u, u >> 17) AS v FROM (SELECT scan_id, k, xor(s, (s << 13) & 4294967295) AS u FROM rng{t} WHERE k < {3 * iters - 1})))",
        f"hyps{t} AS MATERIALIZED (SELECT scan_id, (k // 3)::INTEGER AS hyp, (k % 3)::INTEGER AS slot, s::BIGINT AS s FROM rng{t} WHERE k >= 0)",
        f"corner{t} AS (SELECT h.scan_id, h.hyp, h.slot, v.x, v.y, v.z FROM hyps{t} h JOIN (SELECT DISTINCT scan_id, nv FROM ranked{t}) c USING (scan_id) JOIN ranked{t} v ON v.scan_id = h.scan_id AND v.rn = h.s % c.nv)",
        f"tri{t} AS (SELECT scan_id, hyp, " + ", ".join(f"max({c}) FILTER (WHERE slot = {k}) AS {c}{k}" for k in range(3) for c in "xyz") + f" FROM corner{t} GROUP BY 1, 2)",
        f"nrm{t} AS (SELECT *, (y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) AS p, (z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) AS q, (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) AS r FROM tri{t})",
        f"len{t} AS (SELECT *, sqrt((p*p+q*q+r*r)::DOUBLE)::REAL AS len FROM nrm{t})",
        f"unit{t} AS (SELECT *, p/len AS a, q/len AS b, r/len AS c FROM len{t} WHERE len >= 1e-6::REAL)",
        f"planes{t} AS MATERIALIZED (SELECT scan_id, hyp, a, b, c, -(a*x0+b*y0+c*z0) AS d FROM unit{t} WHERE abs(c) >= 0.9::REAL)",
        f"cnt{t} AS (SELECT v.scan_id, p.hyp, count(*) FILTER (WHERE {INLIER}) AS score FROM vox{t} v JOIN planes{t} p USING (scan_id) GROUP BY 1, 2)",
        f"scores{t} AS MATERIALIZED (SELECT h.scan_id, h.hyp, coalesce(c.score, -1)::INTEGER AS score FROM (SELECT DISTINCT scan_id, hyp FROM hyps{t}) h LEFT JOIN cnt{t} c USING (scan_id, hyp))",
        f"top{t} AS (SELECT scan_id, hyp, score FROM scores{t} WHERE score >= 0 QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, hyp) = 1)",
        f"best{t} AS MATERIALIZED (SELECT s.scan_id, coalesce(t.hyp, -1) AS best_hyp, coalesce(t.score, -1) AS best_score, p.a, p.b, p.c, p.d FROM scans{t} s LEFT JOIN top{t} t USING (scan_id) LEFT JOIN planes{t} p ON p.scan_id = t.scan_id AND p.hyp = t.hyp)",
        f"flag{t} AS MATERIALIZED (SELECT v.scan_id, v.key, v.x, v.y, v.z, coalesce({INLIER}, false) AS ground, {CELL} AS cell FROM vox{t} v LEFT JOIN best{t} b USING (scan_id))",
        f"occ{t} AS MATERIALIZED (SELECT DISTINCT scan_id, cell, cell % 200 AS cx FROM flag{t} WHERE NOT ground AND cell IS NOT NULL)",
    ]


def components(t: str = "") -> list[str]:
    """Labels by recursion with a keyed table."""
    return [
        f"o{t}(dx, dy) AS (VALUES (-1,0),(-1,-1),(0,-1),(1,-1),(1,0),(1,1),(0,1),(-1,1))",
        f"e{t} AS MATERIALIZED (SELECT a.scan_id, a.cell AS u, b.cell AS v FROM (SELECT scan_id, cell, cell + dy*200 + dx AS nb FROM occ{t}, o{t} WHERE cx + dx BETWEEN 0 AND 199) a JOIN occ{t} b ON a.scan_id = b.scan_id AND a.nb = b.cell)",
        f"lab{t}(scan_id, cell, label) USING KEY (scan_id, cell) AS (SELECT scan_id, cell, cell FROM occ{t} UNION SELECT e.scan_id, e.u, min(l.label) FROM lab{t} l JOIN e{t} e ON e.scan_id = l.scan_id AND e.v = l.cell JOIN recurring.lab{t} r ON r.scan_id = e.scan_id AND r.cell = e.u WHERE l.label < r.label GROUP BY 1, 2)",
        f"labels{t} AS MATERIALIZED (SELECT * FROM lab{t})",
        f"sizes{t} AS MATERIALIZED (SELECT scan_id, label, count(*) AS cells FROM labels{t} GROUP BY 1, 2)",
        f"clusters{t} AS (SELECT s.scan_id, count(*) FILTER (WHERE cells >= 3) AS n_clusters, count(*) FILTER (WHERE cells < 3) AS n_small FROM scans{t} s LEFT JOIN sizes{t} USING (scan_id) GROUP BY 1)",
        f"ground{t} AS (SELECT scan_id, count(*) AS n_voxels, count(*) FILTER (WHERE ground) AS n_ground FROM flag{t} GROUP BY 1)",
    ]


def labelled(t: str = "") -> str:
    return (
        f"vlab{t} AS MATERIALIZED (SELECT f.scan_id, f.key, CASE WHEN f.ground THEN -2 WHEN s.cells >= 3 THEN l.label ELSE -1 END AS label, f.x, f.y, f.z "
        f"FROM flag{t} f LEFT JOIN labels{t} l ON l.scan_id = f.scan_id AND l.cell = f.cell LEFT JOIN sizes{t} s ON s.scan_id = l.scan_id AND s.label = l.label)"
    )


def sql(ctes: list[str], select: str) -> str:
    return f"WITH RECURSIVE {', '.join(ctes)} {select}"


BASE = [POINTS, *chain()]
FULL = [*BASE, *components()]
STEP = {c: f"(({hi - lo})::REAL / 65536::REAL)" for c, lo, hi in (("x", -40, 40), ("y", -40, 40), ("z", -3, 2))}
QUANT = [
    "q AS MATERIALIZED (SELECT scan_id, idx, " + ", ".join(f"greatest(0, least(65535, floor(({c} - ({lo})::REAL) / ({hi - lo})::REAL * 65536::REAL)))::INTEGER AS q{c}" for c, lo, hi in (("x", -40, 40), ("y", -40, 40), ("z", -3, 2))) + f" FROM pts WHERE {ROI})",
    "dq AS MATERIALIZED (SELECT scan_id, idx, " + ", ".join(f"({lo})::REAL + (q{c}::REAL + 0.5::REAL) * {STEP[c]} AS {c}" for c, lo in (("x", -40), ("y", -40), ("z", -3))) + " FROM q)",
]
_IMPL = "CASE (event_id % 9)::INTEGER " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(IMPLEMENTATIONS)) + " END"
TIMING_SQL = f"""SELECT CAST(user_id % 20 AS INTEGER) AS scan, {_IMPL} AS impl, CAST(event_id AS INTEGER) AS rep, CAST(1000 + user_id AS BIGINT) AS n_points, CAST(500 + user_id AS BIGINT) AS n_voxels,
 CAST(0 AS DOUBLE) AS h2d, value * 0.5 AS voxel, value * 0.25 AS ransac, value * 0.125 AS cluster, CAST(0 AS DOUBLE) AS d2h, value AS total, CAST(event_id % 7 AS INTEGER) AS prop_iters FROM {{events}} WHERE value IS NOT NULL"""
VALIDATION_SQL = f"""SELECT CAST(user_id % 20 AS INTEGER) AS scan, {_IMPL} AS impl, CAST(event_id % 3 - 1 AS INTEGER) AS voxel_count_diff, CAST(event_id % 2 AS INTEGER) AS key_mismatch, value AS max_centroid_diff,
 CAST(event_id % 2 AS INTEGER) AS best_hyp_same, CAST(event_id % 11 - 5 AS INTEGER) AS score_diff, CAST(event_id % 5 AS INTEGER) AS ground_diff, CAST(event_id % 4 AS INTEGER) AS label_mismatch, CAST(0 AS INTEGER) AS cluster_diff,
 CAST(500 + user_id AS BIGINT) AS n_voxels, CAST(user_id AS INTEGER) AS n_ground, CAST(event_id % 50 AS INTEGER) AS n_clusters FROM {{events}} WHERE value IS NOT NULL"""
TIMING = f"timing AS ({TIMING_SQL.format(events='events')})"
VALIDATION = f"validation AS ({VALIDATION_SQL.format(events='events')})"

HEIGHT = "least(0.9999, greatest(0.0, (z::DOUBLE + 2.2) / 3.4)) * 4"
RAMP, PALETTE = (str([[float(v) for v in c] for c in colors]) for colors in (colors.RAMP, colors.PALETTE))
GOLDEN = ("n_voxels", "best_hyp", "best_score", "n_ground", "n_clusters", "n_small")


def _rgb(select: str) -> str:
    return ", ".join(f"round(({select})[{k + 1}], 6) AS {c}" for k, c in enumerate("rgb"))


_RAMP_K = lambda k: f"round({RAMP}[floor(t)::INTEGER + 1][{k}] + ({RAMP}[floor(t)::INTEGER + 2][{k}] - {RAMP}[floor(t)::INTEGER + 1][{k}]) * (t - floor(t)), 6)"
_HASH = "(xor(h, h >> 15) % 12)::INTEGER"



def _list(c: tuple) -> str:
    return str([float(v) for v in c])


def _bytes(v: str) -> str:
    return ", ".join(f"({v} >> {8 * k}) & 255" for k in range(4))


def _fnv(values: str, order: str) -> str:
    """FNV-1a over the bytes ``values`` of all rows of a group in order."""
    return f"list_reduce(list_prepend(2166136261::UBIGINT, flatten(list([{values}]::UBIGINT[] ORDER BY {order}))), lambda h, b: (xor(h, b) * 16777619) & 4294967295)::BIGINT"


ORACLES: dict[str, str] = {
    "scan_stats": sql([POINTS], "SELECT scan_id, count(*) AS n_points, min(idx) AS first_idx, max(idx) AS last_idx FROM pts GROUP BY 1"),
    "roi_filter": sql([POINTS], f"SELECT scan_id, idx, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM pts WHERE {ROI}"),
    "voxel_key": sql([POINTS], f"SELECT scan_id, idx, {KEY} AS key FROM pts WHERE {ROI}"),
    "voxel_downsample": sql(BASE, "SELECT scan_id, key, n, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM vox"),
    "voxel_downsample_exact": sql(BASE, "SELECT scan_id, key, n, round(x, 3)::DOUBLE AS x, round(y, 3)::DOUBLE AS y, round(z, 3)::DOUBLE AS z FROM vox"),
    "voxel_rank": sql(BASE, "SELECT scan_id, key, rn FROM ranked"),
    "hypotheses": sql(BASE, "SELECT scan_id, hyp, slot, s FROM hyps"),
    "plane_fit": sql(BASE, "SELECT scan_id, hyp, round(a::DOUBLE, 5) AS a, round(b::DOUBLE, 5) AS b, round(c::DOUBLE, 5) AS c, round(d::DOUBLE, 4) AS d FROM planes"),
    "plane_scores": sql(BASE, "SELECT scan_id, hyp, score FROM scores"),
    "best_plane": sql(BASE, "SELECT scan_id, best_hyp, best_score FROM best"),
    "ground_count": sql(BASE, "SELECT scan_id, count(*) AS n_voxels, count(*) FILTER (WHERE ground) AS n_ground FROM flag GROUP BY 1"),
    "ground_removal": sql(BASE, "SELECT scan_id, key FROM flag WHERE NOT ground"),
    "occupancy": sql(BASE, "SELECT scan_id, cell FROM occ"),
    "neighbours": sql(FULL, "SELECT scan_id, u, v FROM e"),
    "component_labels": sql(FULL, "SELECT scan_id, cell, label FROM labels"),
    "component_labels_hooked": sql(FULL, "SELECT scan_id, cell, label FROM labels"),
    "component_sizes": sql(FULL, "SELECT scan_id, label, cells FROM sizes"),
    "cluster_counts": sql(FULL, "SELECT scan_id, n_clusters, n_small FROM clusters"),
    "voxel_labels": sql([*FULL, labelled()], "SELECT scan_id, key, label FROM vlab"),
    "voxel_labels_vectorised": sql([*FULL, labelled()], "SELECT scan_id, key, label FROM vlab"),
    "point_labels": sql([*FULL, labelled()], f"SELECT p.scan_id, p.idx, coalesce(v.label, -1) AS label FROM (SELECT scan_id, idx, CASE WHEN {ROI} THEN {KEY} END AS key FROM pts) p LEFT JOIN vlab v ON v.scan_id = p.scan_id AND v.key = p.key"),
    "object_count": sql([*FULL, labelled()], "SELECT scan_id, count(*) FILTER (WHERE label = -2) AS ground, count(DISTINCT label) FILTER (WHERE label >= 0) AS objects FROM vlab GROUP BY 1"),
    "quantize": sql([POINTS, *QUANT], "SELECT scan_id, idx, qx, qy, qz FROM q"),
    "dequantize": sql([POINTS, *QUANT], "SELECT scan_id, idx, round(x::DOUBLE, 4) AS x, round(y::DOUBLE, 4) AS y, round(z::DOUBLE, 4) AS z FROM dq"),
    "occupancy_diff": sql([*BASE, *QUANT, *chain("2", "dq")], "SELECT scan_id, count(*) FILTER (WHERE a.cell IS NULL OR b.cell IS NULL) AS occ_diff FROM occ a FULL JOIN occ2 b USING (scan_id, cell) GROUP BY 1"),
    "pipeline_result": sql(FULL, "SELECT b.scan_id, p.n_points, n_voxels, best_hyp, best_score, n_ground, n_clusters, n_small FROM best b JOIN clusters USING (scan_id) JOIN ground USING (scan_id) JOIN (SELECT scan_id, count(*) AS n_points FROM pts GROUP BY 1) p USING (scan_id)"),
    "pipeline_summary": sql(FULL, "SELECT b.scan_id, n_voxels, best_hyp, best_score, n_ground::INTEGER AS n_ground, c.n_cells, n_clusters::INTEGER AS n_clusters, n_small::INTEGER AS n_small FROM best b JOIN clusters USING (scan_id) JOIN ground USING (scan_id) JOIN (SELECT scan_id, count(*)::INTEGER AS n_cells FROM occ GROUP BY 1) c USING (scan_id)"),
    "compare_quantized": sql(
        [*FULL, *QUANT, *chain("2", "dq"), *components("2")],
        """SELECT b.scan_id, (g2.n_voxels - g.n_voxels)::INTEGER AS voxel_count_diff, coalesce(k.key_mismatch, 0)::INTEGER AS key_mismatch, (b2.best_hyp = b.best_hyp)::INTEGER AS best_hyp_same,
        (b2.best_score - b.best_score)::INTEGER AS score_diff, (g2.n_ground - g.n_ground)::INTEGER AS ground_diff, coalesce(m.label_mismatch, 0)::INTEGER AS label_mismatch, (c2.n_clusters - c.n_clusters)::INTEGER AS cluster_diff, round(coalesce(k.far, 0)::DOUBLE, 4) AS max_centroid_diff
        FROM best b JOIN best2 b2 USING (scan_id) JOIN ground g USING (scan_id) JOIN ground2 g2 USING (scan_id) JOIN clusters c USING (scan_id) JOIN clusters2 c2 USING (scan_id)
        LEFT JOIN (SELECT a.scan_id, count(*) FILTER (WHERE a.key <> z.key) AS key_mismatch, max(greatest(abs(a.x - z.x), abs(a.y - z.y), abs(a.z - z.z))) FILTER (WHERE a.key = z.key) AS far FROM ranked a JOIN ranked2 z ON z.scan_id = a.scan_id AND z.rn = a.rn GROUP BY 1) k USING (scan_id)
        LEFT JOIN (SELECT scan_id, count(*) FILTER (WHERE coalesce(a.label, -1) <> coalesce(z.label, -1)) AS label_mismatch FROM labels a FULL JOIN labels2 z USING (scan_id, cell) GROUP BY 1) m USING (scan_id)""",
    ),
    "seed_sweep": sql(
        [POINTS, *chain("0", iters=1), *chain("a", iters=64, scans="SELECT frame * 2 + sd - 1 AS scan_id, frame, sd, sd * 7919 AS seed FROM (SELECT DISTINCT scan_id AS frame FROM pts), (VALUES (1), (2)) v(sd)", vox="SELECT s.scan_id, v.key, v.n, v.x, v.y, v.z FROM vox0 v JOIN scansa s ON s.frame = v.scan_id"), *components("a")],
        "SELECT s.frame, 64 AS iters, s.sd::BIGINT AS seed, b.best_score, g.n_ground::INTEGER AS ground, c.n_clusters::INTEGER AS clusters FROM scansa s JOIN besta b USING (scan_id) JOIN clustersa c USING (scan_id) JOIN grounda g USING (scan_id)",
    ),
    "key_fingerprint": sql(
        BASE,
        "SELECT scan_id, list_reduce(list_prepend(2166136261::UBIGINT, flatten(list([key & 255, (key >> 8) & 255, (key >> 16) & 255, (key >> 24) & 255]::UBIGINT[] ORDER BY key))), lambda h, b: (xor(h, b) * 16777619) & 4294967295)::BIGINT AS h_keys FROM vox GROUP BY 1",
    ),
    "fingerprints": sql(
        [*FULL, "grid AS (SELECT s.scan_id, c.range AS cell, coalesce(l.label, -1) AS label FROM scans s, range(40000) c LEFT JOIN labels l ON l.scan_id = s.scan_id AND l.cell = c.range)"],
        f"SELECT scan_id, h_keys, h_labels, h_centroids FROM (SELECT scan_id, {_fnv(_bytes('key'), 'key')} AS h_keys, {_fnv(', '.join(_bytes(f'({c}::BIT::UINTEGER)') for c in 'xyz'), 'key')} AS h_centroids FROM vox GROUP BY 1) "
        f"JOIN (SELECT scan_id, {_fnv(_bytes('(label & 4294967295)'), 'cell')} AS h_labels FROM grid GROUP BY 1) USING (scan_id)",
    ),
    "propagation_labels": sql(FULL, "SELECT scan_id, cell, label FROM labels"),
    "propagation_rounds": sql(
        [*FULL, "far(scan_id, cell, n) USING KEY (scan_id, cell) AS (SELECT scan_id, cell, 0 FROM labels WHERE cell = label UNION SELECT e.scan_id, e.v, min(f.n) + 1 FROM far f JOIN e ON e.scan_id = f.scan_id AND e.u = f.cell "
         "LEFT JOIN recurring.far r ON r.scan_id = e.scan_id AND r.cell = e.v WHERE r.cell IS NULL GROUP BY 1, 2)"],
        "SELECT scan_id, (ceil((max(n) + 1) / 16.0) * 16)::INTEGER AS prop_iters FROM far GROUP BY 1",
    ),
    "scans_roundtrip": sql([POINTS], "SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY idx) - 1 AS idx, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, i::DOUBLE AS i FROM pts WHERE scan_id < 3"),
    "frames_roundtrip": sql([POINTS, *QUANT], "SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY idx) - 1 AS idx, qx, qy, qz FROM q"),
    "timing_csv": sql([TIMING], "SELECT * FROM timing"),
    "golden_mismatches": sql(
        [*FULL, "r AS (SELECT b.scan_id, n_voxels, best_hyp, best_score, n_ground, n_clusters, n_small FROM best b JOIN clusters USING (scan_id) JOIN ground USING (scan_id))"],
        "SELECT *, got = want AS same FROM (" + " UNION ALL ".join(f"SELECT format('f{{:02d}}.bin', scan_id) AS file, '{c}' AS key, {c}::BIGINT AS got, {c}::BIGINT{' + scan_id % 2' if c == 'n_clusters' else ''} AS want FROM r" for c in GOLDEN) + ")",
    ),
    "colorize_voxels": sql(
        [*FULL, labelled(), "h AS (SELECT *, (greatest(label, 0)::UBIGINT * 2654435761) & 4294967295 AS h FROM vlab)",
         f"p AS (SELECT scan_id, key, 'ground' AS stage, CASE WHEN label = -2 THEN {_list(colors.GROUND)} ELSE {_list(colors.OFF_GROUND)} END AS c FROM h UNION ALL "
         f"SELECT scan_id, key, 'object', CASE label WHEN -2 THEN {_list(colors.GROUND_DIM)} WHEN -1 THEN {_list(colors.SMALL)} ELSE {PALETTE}[{_HASH} + 1] END FROM h)"],
        "SELECT scan_id, key, stage, c[1]::DOUBLE AS r, c[2]::DOUBLE AS g, c[3]::DOUBLE AS b FROM p",
    ),
    "latency_summary": sql(
        [TIMING, "s AS (SELECT impl, scan, median(h2d) AS h2d, median(voxel) AS voxel, median(ransac) AS ransac, median(cluster) AS cluster, median(d2h) AS d2h, median(total) AS total, median(prop_iters::DOUBLE) AS prop_iters FROM timing GROUP BY 1, 2)",
         "r AS (SELECT impl, median(h2d) AS h2d, median(voxel) AS voxel, median(ransac) AS ransac, median(cluster) AS cluster, median(d2h) AS d2h, median(total) AS total, quantile_cont(total, 0.95) AS total_p95, max(total) AS total_max, median(prop_iters) AS prop_iters_med FROM s GROUP BY 1)"],
        "SELECT impl, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("h2d", "voxel", "ransac", "cluster", "d2h", "total", "total_p95", "total_max", "prop_iters_med")) + ", round((SELECT total FROM r WHERE impl = 'cpu_t1') / total, 6) AS speedup_vs_t1 FROM r",
    ),
    "validation_summary": sql(
        [VALIDATION],
        "SELECT impl, count(*) FILTER (WHERE voxel_count_diff <> 0) AS voxel_count_differs, count(*) FILTER (WHERE key_mismatch > 0) AS keys_differ, max(max_centroid_diff) AS max_centroid_diff, count(*) FILTER (WHERE best_hyp_same = 0) AS best_hyp_differs, "
        "count(*) FILTER (WHERE score_diff <> 0) AS score_differs, max(abs(score_diff)) AS max_score_diff, count(*) FILTER (WHERE ground_diff <> 0) AS ground_differs, count(*) FILTER (WHERE label_mismatch > 0) AS labels_differ, count(*) FILTER (WHERE cluster_diff <> 0) AS clusters_differ FROM validation WHERE impl <> 'cpu_t1' GROUP BY 1",
    ),
    "input_scale": sql([TIMING, VALIDATION], "SELECT (SELECT count(DISTINCT scan) FROM timing) AS scans, (SELECT median(n_points::DOUBLE) FROM timing) AS points, median(n_voxels::DOUBLE) AS voxels, median(n_ground::DOUBLE) AS ground, median(n_clusters::DOUBLE) AS clusters FROM validation WHERE impl = 'cpu_t1'"),
    "upper_median": sql([TIMING], "SELECT impl, list_sort(list(total))[len(list(total)) // 2 + 1] AS total FROM timing GROUP BY 1"),
    "median_latency": sql([TIMING], "SELECT impl, round(median(total), 6) AS total FROM timing GROUP BY 1"),
    "rolling_median": sql([TIMING], "SELECT impl, rep, round(quantile_cont(total, 0.5) OVER (PARTITION BY impl ORDER BY rep ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 6) AS rolling FROM timing"),
    "seed_spread": "WITH f AS (SELECT user_id % 20 AS frame, CASE event_id % 3 WHEN 0 THEN 256 WHEN 1 THEN 1024 ELSE 4096 END AS iters, max(event_id % 97) - min(event_id % 97) AS ground, max(event_id % 31) - min(event_id % 31) AS clusters FROM events GROUP BY 1, 2) SELECT iters, median(ground::DOUBLE) AS ground_spread, median(clusters::DOUBLE) AS cluster_spread FROM f GROUP BY 1",
    "budget_pct": sql([TIMING], "SELECT impl, rep, round(total / 100.0 * 100.0, 6) AS pct FROM timing"),
    "tour_stage": "SELECT event_id, CASE WHEN k < 2 THEN 'raw' WHEN k < 4 THEN 'voxel' WHEN k < 6 THEN 'ground' ELSE 'object' END AS stage FROM (SELECT event_id, ((user_id - event_id) % 12 + 12) % 12 AS k FROM events)",
    "height_color": sql([POINTS], f"SELECT scan_id, idx, {_RAMP_K(1)} AS r, {_RAMP_K(2)} AS g, {_RAMP_K(3)} AS b FROM (SELECT scan_id, idx, {HEIGHT} AS t FROM pts)"),
    "label_color": f"SELECT label, ({PALETTE}[{_HASH} + 1])[1] AS r, ({PALETTE}[{_HASH} + 1])[2] AS g, ({PALETTE}[{_HASH} + 1])[3] AS b FROM (SELECT range AS label, (range::UBIGINT * 2654435761) & 4294967295 AS h FROM range(40000))",
    "max_points": sql([POINTS], "SELECT max(n) AS max_points FROM (SELECT count(*) AS n FROM pts GROUP BY scan_id)"),
    "report_order": sql([TIMING], "SELECT DISTINCT impl, list_position([" + ", ".join(f"'{x}'" for x in IMPLEMENTATIONS) + "], impl)::INTEGER AS place FROM timing"),
}
