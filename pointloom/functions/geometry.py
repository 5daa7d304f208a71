"""Geometry in single precision.

Spark keeps FLOAT for + - *, but widens division and square root to DOUBLE;
``f32`` narrows those back.  One operation in double, rounded once, equals the
single-precision operation, so results are the same as all-FLOAT arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import PipelineParams, single


def f32(c: Column) -> Column:
    return c.cast("float")


def lit32(v: float) -> Column:
    return F.lit(single(v)).cast("float")


def in_roi(x: Column, y: Column, z: Column, p: PipelineParams) -> Column:
    """Half-open box; NaN counts as larger than any number, so it is outside."""
    bounds = ((x, p.xmin, p.xmax), (y, p.ymin, p.ymax), (z, p.zmin, p.zmax))
    tests = [t for c, lo, hi in bounds for t in (c >= lit32(lo), c < lit32(hi))]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _index(c: Column, lo: float, edge: float) -> Column:
    return F.floor(f32((c - lit32(lo)) / lit32(edge)))


def voxel_number(x: Column, y: Column, z: Column, p: PipelineParams) -> Column:
    """Voxel number of a point known to be inside the region."""
    ix, iy, iz = (F.least(_index(c, lo, p.voxel), F.lit(n - 1)) for c, lo, n in ((x, p.xmin, p.nx), (y, p.ymin, p.ny), (z, p.zmin, p.nz)))
    return (iz * p.ny + iy) * p.nx + ix


def voxel_key(x: Column, y: Column, z: Column, p: PipelineParams) -> Column:
    """Voxel number of a point inside the region (null outside)."""
    return F.when(in_roi(x, y, z, p), voxel_number(x, y, z, p))


def bev_cell(x: Column, y: Column, p: PipelineParams) -> Column:
    """Ground-grid cell of a position, null outside the grid."""
    cx, cy = _index(x, p.xmin, p.cell), _index(y, p.ymin, p.cell)
    return F.when(cx.between(0, p.gw - 1) & cy.between(0, p.gh - 1), (cy * p.gw + cx).cast("int"))


def plane3(a: Column, b: Column, c: Column, min_nz: float) -> Column:
    """Plane struct (a, b, c, d) through three points (structs x, y, z); null if degenerate or steep."""
    ux, uy, uz = b["x"] - a["x"], b["y"] - a["y"], b["z"] - a["z"]
    vx, vy, vz = c["x"] - a["x"], c["y"] - a["y"], c["z"] - a["z"]
    return _unit(F.struct((uy * vz - uz * vy).alias("p"), (uz * vx - ux * vz).alias("q"), (ux * vy - uy * vx).alias("r")), a, min_nz)


def _unit(n: Column, at: Column, min_nz: float) -> Column:
    length = f32(F.sqrt(n["p"] * n["p"] + n["q"] * n["q"] + n["r"] * n["r"]))
    whole = F.when(length >= lit32(1e-6), length)  # null length makes null components: no division by zero
    a, b, c = (f32(n[k] / whole) for k in "pqr")
    d = -(a * at["x"] + b * at["y"] + c * at["z"])
    return F.when(F.abs(c) >= lit32(min_nz), F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")))


def is_inlier(plane: Column, x: Column, y: Column, z: Column, threshold: float) -> Column:
    return F.abs(plane["a"] * x + plane["b"] * y + plane["c"] * z + plane["d"]) < lit32(threshold)


def quant(v: Column, lo: float, hi: float) -> Column:
    """16-bit step of a coordinate within [lo, hi)."""
    span = single(single(hi) - single(lo))
    step = f32((v - lit32(lo)) / lit32(span)) * lit32(65536.0)
    return F.greatest(F.lit(0), F.least(F.lit(65535), F.floor(step))).cast("int")


def dequant(q: Column, lo: float, hi: float) -> Column:
    """Middle of a 16-bit step."""
    step = single(single(single(hi) - single(lo)) / 65536.0)
    return lit32(lo) + (q.cast("float") + lit32(0.5)) * lit32(step)
