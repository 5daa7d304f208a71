"""Labels of voxels and points: -2 ground, -1 small piece or nothing, otherwise the component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import bev_cell, voxel_key
from ..params import PipelineParams


def voxel_labels(flagged: DataFrame, cells: DataFrame, sizes: DataFrame, p: PipelineParams) -> DataFrame:
    """(scan_id, key, x, y, z, label) from voxels with ``ground``, labelled cells and component sizes."""
    large = cells.join(sizes.filter(F.col("cells") >= p.min_cells), ["scan_id", "label"]).select("scan_id", "cell", F.col("label").alias("object"))
    placed = flagged.withColumn("cell", bev_cell(F.col("x"), F.col("y"), p)).join(large, ["scan_id", "cell"], "left")
    label = F.when(F.col("ground"), F.lit(-2)).otherwise(F.coalesce("object", F.lit(-1)))
    return placed.select("scan_id", "key", "x", "y", "z", label.cast("int").alias("label"))


def point_labels(points: DataFrame, labelled: DataFrame, p: PipelineParams) -> DataFrame:
    """(scan_id, idx, x, y, z, label): each point takes its voxel's label, -1 outside the region."""
    keyed = points.select("scan_id", "idx", "x", "y", "z", voxel_key(F.col("x"), F.col("y"), F.col("z"), p).alias("key"))
    own = keyed.join(labelled.select("scan_id", "key", "label"), ["scan_id", "key"], "left")
    return own.select("scan_id", "idx", "x", "y", "z", F.coalesce("label", F.lit(-1)).alias("label"))
