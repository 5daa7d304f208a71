"""The reference's whole seed sweep against every hypothesis as a table."""

from dataclasses import replace

from pyspark.sql import functions as F

from pointloom.plans import pipeline
from pointloom.plans.queries import QUERIES, P
from pointloom.sources.scans import fixture_points

D = "/root/testdata/sf0.001"


def test_whole_sweep(spark):
    got = {(r.frame, r.iters, r.seed): (r.best_score, r.ground, r.clusters) for r in QUERIES["seed_sweep_reference"](spark, D).collect()}
    assert set(got) == {(f, k, s) for f in range(4) for k in (256, 1024, 4096) for s in range(1, 51)}
    points = fixture_points(spark, D)
    scans = points.select("scan_id").distinct()
    for k, s in ((256, 1), (256, 50), (1024, 23)):
        each = pipeline.run(points, replace(P, ransac_iters=k), seed=scans.withColumn("seed", F.lit(s * 7919).cast("long")), ransac_mode="joins", cluster_mode="hooked")
        for r in each.result.collect():
            assert got[r.scan_id, k, s] == (r.best_score, r.n_ground, r.n_clusters)
    for f in range(4):
        for s in range(1, 51):
            assert got[f, 256, s][0] <= got[f, 1024, s][0] <= got[f, 4096, s][0]
