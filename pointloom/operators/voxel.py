"""Region crop and voxel centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import f32, in_roi, voxel_number
from ..params import PipelineParams

#: Type of the sums of each mode that adds in point order.
_SUM_TYPES = {"exact": "float", "exact64": "double"}


def roi_filter(points: DataFrame, p: PipelineParams) -> DataFrame:
    return points.filter(in_roi(F.col("x"), F.col("y"), F.col("z"), p))


def voxel_downsample(points: DataFrame, p: PipelineParams, mode: str = "fast") -> DataFrame:
    """(scan_id, key, n, x, y, z): one centroid per occupied voxel.

    ``fast`` averages in double with map-side partial aggregation and rounds
    once.  ``exact`` adds in single precision in the order of ``idx``: it
    gathers a voxel's points, so use it where bits must match a serial sum.
    That sum's error grows with n; ``exact64`` gathers and orders alike, but
    adds in double and rounds once.
    """
    keyed = roi_filter(points, p).select("scan_id", "idx", "x", "y", "z", voxel_number(F.col("x"), F.col("y"), F.col("z"), p).alias("key"))
    if mode == "fast":
        means = [F.avg(F.col(c).cast("double")).cast("float").alias(c) for c in "xyz"]
        return keyed.groupBy("scan_id", "key").agg(F.count("*").alias("n"), *means)
    if mode not in _SUM_TYPES:
        raise ValueError(f"unknown voxel mode {mode!r}")
    grouped = keyed.groupBy("scan_id", "key").agg(F.array_sort(F.collect_list(F.struct("idx", "x", "y", "z"))).alias("pts"))
    kind = _SUM_TYPES[mode]
    count = F.size("pts").cast(kind)
    zero = F.lit(0.0).cast(kind)

    def mean(c: str):
        return f32(F.aggregate("pts", zero, lambda s, e: s + e[c].cast(kind)) / count).alias(c)

    return grouped.select("scan_id", "key", F.size("pts").cast("long").alias("n"), *[mean(c) for c in "xyz"])


def voxel_rank(voxels: DataFrame) -> DataFrame:
    """Add rn: position of the voxel in its scan by ascending key, from 0.  A scan has at most nx * ny * nz voxels."""
    return voxels.withColumn("rn", F.row_number().over(Window.partitionBy("scan_id").orderBy("key")).cast("long") - 1)
