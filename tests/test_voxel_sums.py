"""Centroids of voxels that hold many points: the registered query against its SQL, ordered sums against numpy."""

import duckdb
import numpy as np
import pytest

from pointloom.operators import voxel
from pointloom.plans.queries import QUERIES, P, oracles
from pointloom.sources.scans import fixture_points


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """A ``lineitem`` whose points all lie on 0.2 m of the fixture's wall: dozens to a voxel."""
    d = tmp_path_factory.mktemp("crowded")
    near = "SELECT range AS k FROM range(2, 40000000, 10) WHERE (range * 48271) % 2147483647 % 6007 BETWEEN 5983 AND 6002"
    duckdb.sql(f"COPY (SELECT k // 8 AS l_orderkey, (k % 8)::INTEGER AS l_linenumber, 1.0::DOUBLE AS l_quantity FROM ({near})) TO '{d}/lineitem.parquet' (FORMAT parquet)")
    return str(d)


def test_crowded_voxels_equal_sql(spark, crowded):
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{crowded}/lineitem.parquet'")
    want = con.sql(oracles()["voxel_downsample_exact"])
    got = QUERIES["voxel_downsample_exact"](spark, crowded).select(*want.columns).collect()
    assert max(r.n for r in got) > 50
    assert sorted(tuple(r) for r in got) == sorted(want.fetchall())


@pytest.mark.parametrize("mode, kind", [("exact", np.float32), ("exact64", np.float64)])
def test_sums_in_point_order(spark, crowded, mode, kind):
    points = fixture_points(spark, crowded)
    keyed = voxel.roi_filter(points, P).withColumn("key", voxel.voxel_number(points.x, points.y, points.z, P))
    want = {}
    for r in sorted(keyed.collect(), key=lambda r: (r.scan_id, r.key, r.idx)):
        n, total = want.get((r.scan_id, r.key), (0, np.zeros(3, dtype=kind)))
        want[r.scan_id, r.key] = n + 1, total + np.array([r.x, r.y, r.z], dtype=np.float32).astype(kind)
    got = {(r.scan_id, r.key): r for r in voxel.voxel_downsample(points, P, mode).collect()}
    assert set(got) == set(want)
    for k, (n, total) in want.items():
        assert got[k].n == n and np.array_equal(np.array([got[k].x, got[k].y, got[k].z], dtype=np.float32), (total / kind(n)).astype(np.float32))
