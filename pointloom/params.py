"""Pipeline parameters and the point schema."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import types as T

POINTS = T.StructType([
    T.StructField("scan_id", T.LongType()), T.StructField("idx", T.LongType()),
    T.StructField("x", T.FloatType()), T.StructField("y", T.FloatType()), T.StructField("z", T.FloatType()), T.StructField("i", T.FloatType()),
])


@dataclass(frozen=True)
class PipelineParams:
    """Region of interest, voxel and cell edges, plane search and cluster size; grid sizes follow from them."""

    xmin: float = -40.0
    xmax: float = 40.0
    ymin: float = -40.0
    ymax: float = 40.0
    zmin: float = -3.0
    zmax: float = 2.0
    voxel: float = 0.2
    ransac_iters: int = 256
    ransac_thresh: float = 0.2
    min_nz: float = 0.9
    cell: float = 0.4
    min_cells: int = 3

    def __post_init__(self):
        if not (self.xmin < self.xmax and self.ymin < self.ymax and self.zmin < self.zmax):
            raise ValueError("the region of interest is empty")
        if self.voxel <= 0 or self.cell <= 0 or self.ransac_thresh <= 0 or self.ransac_iters < 0 or self.min_cells < 1:
            raise ValueError("edges and threshold must be positive, counts not negative")
        if self.nx * self.ny * self.nz >= 2**32:
            raise ValueError("voxel keys would not fit in 32 bits")

    @staticmethod
    def _cells(lo: float, hi: float, edge: float) -> int:
        return max(1, round((hi - lo) / edge))

    @property
    def nx(self) -> int:
        return self._cells(self.xmin, self.xmax, self.voxel)

    @property
    def ny(self) -> int:
        return self._cells(self.ymin, self.ymax, self.voxel)

    @property
    def nz(self) -> int:
        return self._cells(self.zmin, self.zmax, self.voxel)

    @property
    def gw(self) -> int:
        return self._cells(self.xmin, self.xmax, self.cell)

    @property
    def gh(self) -> int:
        return self._cells(self.ymin, self.ymax, self.cell)


def single(v: float) -> float:
    """The nearest single-precision value."""
    return float(np.float32(v))
