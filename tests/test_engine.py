"""Operators against single-precision numpy models, hand-made scans, and between modes."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import colors, geometry, sequences
from pointloom.operators import detect, fingerprints, grid, report, validate, voxel
from pointloom.params import POINTS, PipelineParams
from pointloom.plans import pipeline
from pointloom.sources import scans, tables

P = PipelineParams()
f4 = np.float32


def points(spark, rows):
    return spark.createDataFrame([(s, i, float(x), float(y), float(z), 0.0) for i, (s, x, y, z) in enumerate(rows)], POINTS)


def scans_of(spark, n=1):
    return spark.createDataFrame([(i, 1000 + i) for i in range(n)], "scan_id long, seed long")


def model_key(x, y, z):
    x, y, z = f4(x), f4(y), f4(z)
    if not (f4(-40) <= x < f4(40) and f4(-40) <= y < f4(40) and f4(-3) <= z < f4(2)):
        return None
    ix, iy, iz = (min(int(np.floor(f4(f4(c - f4(lo)) / f4(0.2)))), n - 1) for c, lo, n in ((x, -40, 400), (y, -40, 400), (z, -3, 25)))
    return (iz * 400 + iy) * 400 + ix


def test_params():
    assert (P.nx, P.ny, P.nz, P.gw, P.gh) == (400, 400, 25, 200, 200)
    with pytest.raises(ValueError):
        PipelineParams(xmin=1, xmax=1)
    with pytest.raises(ValueError):
        PipelineParams(voxel=0.0001)


def test_voxel_keys_at_boundaries(spark):
    edge = [-40, -39.8, 39.999996, 40, float(np.nextafter(f4(40), f4(0))), -0.0, 0.0, float("nan"), float("inf"), 1e-30] + [0.2 * k for k in range(-199, 200, 7)] + [0.4 * k for k in range(-99, 100, 9)]
    rows = [(0, x, y, z) for x in edge for y, z in ((0, 0), (-40, -3), (39.9, 1.9999999), (1.2, 2))]
    df = points(spark, rows).select("idx", geometry.voxel_key(F.col("x"), F.col("y"), F.col("z"), P).alias("key"))
    got = {r.idx: r.key for r in df.collect()}
    assert got == {i: model_key(*r[1:]) for i, r in enumerate(rows)}


def test_cells_planes_and_steps(spark):
    rng = np.random.default_rng(5)
    v = rng.uniform(-45, 45, (300, 9)).astype(np.float32)
    v[:100, 2::3] *= f4(0.01)
    df = spark.createDataFrame([tuple(map(float, r)) for r in v], ", ".join(f"c{k} float" for k in range(9)))
    at = lambda k: F.struct(F.col(f"c{k}").alias("x"), F.col(f"c{k + 1}").alias("y"), F.col(f"c{k + 2}").alias("z"))
    got = df.select(
        geometry.plane3(at(0), at(3), at(6), P.min_nz).alias("p"), geometry.bev_cell(F.col("c0"), F.col("c1"), P).alias("cell"),
        geometry.quant(F.col("c0"), -40, 40).alias("q"), geometry.dequant(geometry.quant(F.col("c0"), -40, 40), -40, 40).alias("d"),
    ).collect()
    planes = np.vstack([detect.fit_planes(r.reshape(3, 3), np.array([0, 1, 2]), P.min_nz) for r in v])
    for r, g, w in zip(v, got, planes):
        assert (g.p is None) == bool(np.isnan(w[0])) and (g.p is None or np.array_equal(np.array([g.p.a, g.p.b, g.p.c, g.p.d], dtype=np.float32), w))
        cx, cy = (int(np.floor(f4(f4(c + f4(40)) / f4(0.4)))) for c in r[:2])
        assert g.cell == (cy * 200 + cx if 0 <= cx < 200 and 0 <= cy < 200 else None)
        q = min(65535, max(0, int(np.floor(f4(f4(r[0] + f4(40)) / f4(80)) * f4(65536)))))
        assert g.q == q and f4(g.d) == f4(-40) + (f4(q) + f4(0.5)) * f4(80 / 65536)


def test_sequences_and_hashes(spark):
    for seed in (0, 1, 1000, 4294967295):
        got = spark.range(1).select(sequences.random_sequence(F.lit(seed), 60)).first()[0]
        assert got == detect.random_states(seed, 60).tolist()
    assert detect.random_states(1, 1)[0] == 270369
    data = [0, 97, 255, 98]
    assert spark.range(1).select(sequences.fnv1a(F.array(*[F.lit(b) for b in data]))).first()[0] == fingerprints.fnv1a_bytes(bytes(data))
    assert fingerprints.fnv1a_bytes(b"a") == 0xE40C292C
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 300, 5000):
        data, want = rng.integers(0, 256, n, dtype=np.uint8).tobytes(), sequences.FNV_BASIS
        for b in data:
            want = (want ^ b) * sequences.FNV_PRIME & sequences.MASK
        assert fingerprints.fnv1a_bytes(data) == want


@pytest.mark.parametrize("gw, gh", [(1, 1), (7, 5), (40, 30)])
def test_label_grid_equals_search(gw, gh):
    rng = np.random.default_rng(gw)
    for share in (0, 0.2, 0.4, 0.6, 1):
        occupied = np.flatnonzero(rng.random(gw * gh) < share)
        want, left = {}, set(occupied.tolist())
        for cell in occupied.tolist():
            todo = [cell] if cell in left else []
            left -= {cell}
            while todo:
                at = todo.pop()
                want[at] = cell
                near = {(at // gw + dy) * gw + at % gw + dx for dy in (-1, 0, 1) for dx in (-1, 0, 1) if 0 <= at % gw + dx < gw} & left
                left -= near
                todo += near
        assert grid.label_grid(occupied, gw, gh).tolist() == [want[c] for c in occupied.tolist()]


def scan_cases():
    rng = np.random.default_rng(2)
    flat = [(float(x), float(y), -1.7) for x, y in rng.uniform(-30, 30, (300, 2))]
    wall = [(0.0, float(y), float(z)) for y, z in rng.uniform(-2, 1.9, (200, 2))]
    return {
        "outside": ([(50, 0, 0), (0, 0, 9), (float("nan"), 0, 0)], (0, -1, -1, 0, 0, 0)),
        "one_voxel": ([(1.01 + k / 1000, 1.01, 1.01) for k in range(10)], (1, -1, -1, 0, 0, 1)),
        "two_voxels": ([(1, 1, 1), (20, 20, 1)], (2, -1, -1, 0, 0, 2)),
        "flat": (flat, None),
        "wall_only": (wall, None),
    }


@pytest.mark.parametrize("ransac_mode", ["arrays", "joins"])
def test_hand_made_scans(spark, ransac_mode):
    cases = scan_cases()
    df = points(spark, [(k, *p) for k, (pts, _) in enumerate(cases.values()) for p in pts])
    seeds = scans_of(spark, len(cases) + 1)  # the last scan has no points
    r = pipeline.run(df, P, seeds, ransac_mode=ransac_mode)
    got = {x.scan_id: x for x in r.result.collect()}
    fast = {x.scan_id: x for x in pipeline.summary(df, P, seeds).collect()}
    for k, (name, (_, want)) in enumerate(cases.items()):
        for g in (got[k], fast[k]):
            own = (g.n_voxels, g.best_hyp, g.best_score, g.n_ground, g.n_clusters, g.n_small)
            if want:
                assert own == want, name
        if name == "flat":
            assert got[k].best_score == got[k].n_ground == got[k].n_voxels and got[k].n_clusters == 0
        if name == "wall_only":
            assert (got[k].best_hyp, got[k].best_score) == (-1, -1)
    last = got[len(cases)]
    assert (last.n_points, last.n_voxels, last.best_hyp, last.n_ground, last.n_clusters) == (0, 0, -1, 0, 0)


def cells(spark, *lists):
    return spark.createDataFrame([(k, int(c)) for k, cs in enumerate(lists) for c in cs], "scan_id long, cell int")


def snake(w, h):
    out = []
    for y in range(h):
        out += [y * w + x for x in range(w)] if y % 2 == 0 else [y * w + (w - 1 if y % 4 == 1 else 0)]
    return out


def test_components(spark):
    small = PipelineParams(xmin=-4, xmax=4, ymin=-4, ymax=4)
    w = small.gw
    parts = [w - 1, w], [0, 1, 2, w + 1], [0, w + 1, 2 * w + 2], snake(w, small.gh), [5]
    occ = cells(spark, *parts)
    want = {(0, w - 1): w - 1, (0, w): w, **{(1, c): 0 for c in parts[1]}, **{(2, c): 0 for c in parts[2]}, **{(3, c): 0 for c in parts[3]}, (4, 5): 5}
    as_map = lambda df: {(r.scan_id, r.cell): r.label for r in df.collect()}
    assert as_map(grid.connected_cells(occ, small)) == want
    assert as_map(grid.hooked_components(occ, small)) == want
    short = cells(spark, *(parts[:3] + parts[4:]))
    for propagate in (grid.propagate_labels, grid.propagate_by_joins):
        labels, rounds = propagate(short, small)
        assert as_map(labels) == {(s if s < 4 else 3, c): v for (s, c), v in want.items() if s != 3}
        assert {r.scan_id: r.prop_iters for r in rounds.collect()} == {0: 1, 1: 3, 2: 3, 3: 1}
        _, rounds = propagate(short, small, every=16)
        assert {r.prop_iters for r in rounds.collect()} == {16}
    assert as_map(grid.propagate_labels(occ, small)[0]) == want
    with pytest.raises(RuntimeError):
        grid.propagate_by_joins(occ, small, max_rounds=2)
    sizes = grid.component_sizes(grid.connected_cells(occ, small))
    counts = {r.scan_id: (r.n_clusters, r.n_small) for r in grid.cluster_counts(scans_of(spark, 6), sizes, small).collect()}
    assert counts == {0: (0, 2), 1: (1, 0), 2: (1, 0), 3: (1, 0), 4: (0, 1), 5: (0, 0)}


def test_exact_and_fast_agree_and_order_is_free(spark):
    df = scans.fixture_points(spark, "/root/testdata/sf0.001")
    a, b = pipeline.run(df, P, voxel_mode="exact"), pipeline.run(df.orderBy(F.rand(3)).repartition(7), P)
    diff = validate.compare(*({"voxels": r.voxels, "labels": r.labels, "result": r.result} for r in (a, b))).collect()
    for r in diff:
        assert (r.voxel_count_diff, r.key_mismatch, r.best_hyp_same, r.score_diff, r.ground_diff, r.label_mismatch, r.cluster_diff) == (0, 0, 1, 0, 0, 0, 0)
        assert r.max_centroid_diff < 1e-5
    labels = pipeline.label_voxels(df, P)
    n = {r.scan_id: r for r in a.result.collect()}
    for r in labels.groupBy("scan_id").agg(F.count_if(F.col("label") == -2).alias("g"), F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("c")).collect():
        assert (r.g, r.c) == (n[r.scan_id].n_ground, n[r.scan_id].n_clusters)


def test_fingerprints(spark):
    df = scans.fixture_points(spark, "/root/testdata/sf0.001").filter("scan_id = 0")
    r = pipeline.run(df, P)
    got = r.fingerprints.first()
    vox = sorted(r.voxels.collect(), key=lambda v: v.key)
    dense = np.full(P.gw * P.gh, -1, dtype="<i4")
    for c in r.labels.collect():
        dense[c.cell] = c.label
    assert got.h_keys == fingerprints.fnv1a_bytes(b"".join(struct.pack("<I", v.key) for v in vox))
    assert got.h_centroids == fingerprints.fnv1a_bytes(b"".join(struct.pack("<3f", v.x, v.y, v.z) for v in vox))
    assert got.h_labels == fingerprints.fnv1a_bytes(dense.tobytes())


def test_sources_round_trip(spark, tmp_path):
    rng = np.random.default_rng(9)
    raw = rng.uniform(-50, 50, (3, 100, 4)).astype("<f4")
    raw[:, :, 2] /= 20
    for k, s in ((0, 0), (1, 9), (2, 18)):
        (tmp_path / f"{s:010d}.bin").write_bytes(raw[k].tobytes() + b"xyz" * (k == 1))
    (tmp_path / ".bin").write_bytes(b"")
    (tmp_path / "note.txt").write_text("no")
    got = scans.read_scans(spark, str(tmp_path)).orderBy("scan_id", "idx").collect()
    assert np.array_equal(np.array([[r.x, r.y, r.z, r.i] for r in got], dtype="<f4"), raw.reshape(-1, 4))
    assert scans.read_scans(spark, str(tmp_path), 2).select("scan_id").distinct().count() == 2
    assert [r.scan_id for r in scans.pick_scans(spark, str(tmp_path), 0, 9, 3).orderBy("frame").collect()] == [0, 9, 18]
    with pytest.raises(Exception, match="no scan 27"):
        scans.pick_scans(spark, str(tmp_path), 0, 9, 4).collect()
    packed = scans.pack_points(scans.read_scans(spark, str(tmp_path)), P)
    frames = tables.write_frames(packed, str(tmp_path / "frames.parquet"))
    out = tmp_path / "out"
    out.mkdir()
    tables.export_frames(frames, str(out))
    back = scans.read_frames(spark, str(out))
    order = lambda df: [tuple(r)[2:] for r in df.orderBy("scan_id", "idx").collect()]
    assert order(back) == order(packed) and (out / "f00.bin").exists()


def test_tables_round_trip(spark, tmp_path):
    rows = [(0, "cpu_t1", k, 10, 5, 0.0, 1.0 + k, 2.0, 3.0, 0.0, 6.0 + k, 0) for k in range(3)] + [(0, "gpu_hash_uf", 0, 10, 5, 0.5, 1.0, 1.0, 1.0, 0.5, 3.5, 0)]
    tables.write_csv(spark.createDataFrame(rows, tables.TIMING), str(tmp_path / "t.csv"))
    t = tables.read_csv(spark, str(tmp_path / "t.csv"), tables.TIMING)
    got = {r.impl: r for r in report.in_report_order(report.latency_summary(t)).collect()}
    assert list(got) == ["cpu_t1", "gpu_hash_uf"] and got["gpu_hash_uf"].speedup_vs_t1 == 2.0 and got["cpu_t1"].total_max == 7.0
    frames = spark.createDataFrame([(f"f{k:02d}.bin", k, k * 2) for k in range(9)], "file string, points long, voxels long")
    tables.write_golden(frames, str(tmp_path / "g.json"))
    golden = tables.read_golden(spark, str(tmp_path / "g.json"))
    checks = validate.golden_check(frames.withColumn("voxels", F.col("voxels") + 1).filter("points < 8"), golden, ("points", "voxels"))
    assert checks.filter("same").count() == 8 and len(validate.first_mismatches(checks).collect()) == 6


def test_stream_of_scans(spark, tmp_path):
    from pointloom.streaming.frames import follow

    rng = np.random.default_rng(4)
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k:010d}.bin").write_bytes(rng.uniform(-2, 1.5, (200, 4)).astype("<f4").tobytes())
    q = follow(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), P)
    q.awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch").orderBy("scan_id").collect()
    want = pipeline.summary(scans.read_scans(spark, str(tmp_path / "in")), P).orderBy("scan_id").collect()
    assert got == want and spark.read.parquet(str(tmp_path / "out_ms")).count() == 3


def test_colours_and_medians(spark):
    row = spark.range(1).select(
        colors.tour_stage(F.lit(12)).alias("a"), colors.tour_stage(F.lit(-1)).alias("b"), colors.budget_pct(F.lit(8.64)).alias("c"), colors.budget_pct(F.lit(25.0)).alias("d"),
        colors.colorize(F.lit("ground"), F.lit(0.0), F.lit(-2)).alias("e"), colors.colorize(F.lit("object"), F.lit(0.0), F.lit(-1)).alias("f"), colors.colorize(F.lit("object"), F.lit(0.0), F.lit(777)).alias("g"), colors.label_color(F.lit(777)).alias("h"),
    ).first()
    assert (row.a, row.b, round(row.c, 2), row.d) == ("raw", "object", 8.64, 25.0)
    assert row.e == [52, 96, 150] and row.f == [92, 104, 120] and row.g == row.h
    every = spark.range(40000).select(colors.label_color(F.col("id")).alias("c"))
    assert every.filter("c is null").isEmpty() and every.distinct().count() == 12
    heights = [sum(r.c) for r in spark.createDataFrame([(z,) for z in (-50.0, -2.2, -1.7, 0.0, 1.2, 50.0)], "z double").select(colors.height_color(F.col("z")).alias("c")).collect()]
    assert heights == sorted(heights) and 0 <= min(heights) and max(heights) <= 765
    t = spark.createDataFrame([(1.0,), (4.0,), (2.0,), (3.0,)], "v double")
    assert t.agg(F.median("v"), report.upper_median("v")).first()[:] == (2.5, 3.0)


def test_voxel_mode_names(spark):
    with pytest.raises(ValueError):
        voxel.voxel_downsample(points(spark, [(0, 0, 0, 0)]), P, "other")
    with pytest.raises(ValueError):
        pipeline.run(points(spark, [(0, 0, 0, 0)]), P, cluster_mode="other")


def scan_bytes(spark, seed=4, n=3000):
    """Three scans: ground, a wall and outliers with NaN and a partial record; no points; null."""
    rng = np.random.default_rng(seed)
    xyz = np.column_stack([rng.uniform(-42, 42, (n, 2)), rng.normal(-1.7, 0.05, n)])
    xyz[: n // 4] = np.column_stack([rng.uniform(3, 6, n // 4), rng.uniform(3, 3.3, n // 4), rng.uniform(-1.4, 2.2, n // 4)])
    xyz[5] = np.nan
    data = np.column_stack([xyz, np.ones(n)]).astype("<f4")
    return data, spark.createDataFrame([(7, data.tobytes() + b"abc"), (8, b""), (9, None)], "scan_id long, content binary")


def test_whole_scans_equal_the_tables(spark):
    from pointloom.operators import whole

    data, contents = scan_bytes(spark)
    df = points(spark, [(7, *r[:3]) for r in data])
    seeds = spark.createDataFrame([(s, 1000 + s) for s in (7, 8, 9)], "scan_id long, seed long")
    r = pipeline.run(df, P, seeds, voxel_mode="exact")
    got = {x.scan_id: x for x in pipeline.summary_of_scans(contents, P).collect()}
    fields = ("n_points", "n_voxels", "best_hyp", "best_score", "n_ground", "n_clusters", "n_small")
    assert {s: tuple(x[c] for c in fields) for s, x in got.items()} == {x.scan_id: tuple(x[c] for c in fields) for x in r.result.collect()}
    assert got[7].n_points == len(data) and got[7].n_cells == r.occ.count() and got[8].best_hyp == got[9].best_hyp == -1
    # centroids are equal bit for bit, labels too
    bits = lambda rows: sorted((x.scan_id, x.key, *np.array([x.x, x.y, x.z], dtype=np.float32).view(np.uint32).tolist(), x.label) for x in rows)
    assert bits(whole.label_voxels(contents, P).collect()) == bits(r.voxel_labels.select("scan_id", "key", "x", "y", "z", "label").collect())
    labelled = lambda t: sorted(tuple(x) for x in t.select("scan_id", "idx", "label").collect())
    assert labelled(whole.label_points(contents, P)) == labelled(r.point_labels)


def test_whole_frames_and_large_grids(spark, tmp_path):
    from pointloom.operators import whole

    data, contents = scan_bytes(spark, 6, 500)
    packed = scans.pack_points(points(spark, [(0, *r[:3]) for r in data]), P).orderBy("idx").collect()
    frame = np.array([(x.qx, x.qy, x.qz) for x in packed], dtype="<u2").tobytes()
    unpacked = scans.unpack_points(spark.createDataFrame([(0, i, x.qx, x.qy, x.qz) for i, x in enumerate(packed)], "scan_id long, idx long, qx int, qy int, qz int"), P)
    want = [[x.x, x.y, x.z] for x in unpacked.orderBy("idx").collect()]
    assert np.array_equal(whole.decode(frame, True, P), np.array(want, dtype=np.float32).T)
    key = np.array([5, 1, 5, 9])
    for size in (16, 1 << 25):
        keys, own = whole.ranked(key, size)
        assert keys.tolist() == [1, 5, 9] and own.tolist() == [1, 0, 1, 2]
    (tmp_path / "0000000012.bin").write_bytes(data.tobytes())
    assert [r.scan_id for r in scans.scan_contents(spark, str(tmp_path)).collect()] == [12]
    assert "Exchange" not in pipeline.summary_of_scans(contents, P)._jdf.queryExecution().toString()


@pytest.mark.parametrize("n, spread, flat", [(1, 5, 1), (40, 0.5, 1), (3000, 40, 0.02), (3000, 5, 1), (500, 1e4, 1), (40_000, 20, 0.02)])
def test_bounded_plane_search_equals_counting_all(n, spread, flat):
    rng = np.random.default_rng(n)
    xyz = (rng.normal(0, spread, (n, 3)) * [1, 1, flat]).astype(np.float32)
    for points in (xyz, np.round(xyz * 5) / np.float32(5)):  # the second has ties and voxels on edges of boxes
        planes = detect.fit_planes(points, detect.random_states(7, 3 * 128), 0.0)
        planes = planes[~np.isnan(planes[:, 0])]
        if not len(planes):
            continue
        counts = detect.count_inliers(planes, points, 0.2)
        assert (detect.possible_inliers(planes, points, 0.2).sum(axis=1) >= counts).all()
        assert detect.most_inliers(planes, points, 0.2) == (int(counts.argmax()), int(counts.max()))
