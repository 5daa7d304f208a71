"""The pipeline: voxels, ground plane, occupancy grid, components - as lazy tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detect import best_planes, detect, detect_labels
from ..operators.fingerprints import centroid_hash, key_hash, label_hash
from ..operators.grid import cluster_counts, component_sizes, connected_cells, hooked_components, occupancy, propagate_labels
from ..operators.labels import point_labels, voxel_labels
from ..operators.ransac import find_ground, ground_flag
from ..operators.voxel import voxel_downsample
from ..operators.whole import summarize
from ..params import PipelineParams
from ..sources.scans import seeds


@dataclass
class PipelineResult:
    """Tables of a run; nothing is computed until one is used."""

    params: PipelineParams
    points: DataFrame
    scans: DataFrame
    voxels: DataFrame
    best: DataFrame
    flagged: DataFrame
    occ: DataFrame
    labels: DataFrame
    sizes: DataFrame
    prop_iters: DataFrame | None = None

    @property
    def result(self) -> DataFrame:
        """One row per scan."""
        n = self.points.groupBy("scan_id").agg(F.count("*").alias("n_points"))
        v = self.flagged.groupBy("scan_id").agg(F.count("*").alias("n_voxels"), F.count_if("ground").alias("n_ground"))
        out = self.best.join(n, "scan_id", "left").join(v, "scan_id", "left").join(cluster_counts(self.scans, self.sizes, self.params), "scan_id")
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return out.select("scan_id", zero("n_points"), zero("n_voxels"), "best_hyp", "best_score", zero("n_ground"), "n_clusters", "n_small", "plane")

    @property
    def voxel_labels(self) -> DataFrame:
        return voxel_labels(self.flagged, self.labels, self.sizes, self.params)

    @property
    def point_labels(self) -> DataFrame:
        return point_labels(self.points, self.voxel_labels, self.params)

    @property
    def fingerprints(self) -> DataFrame:
        out = self.scans.select("scan_id").join(key_hash(self.voxels), "scan_id", "left")
        return out.join(label_hash(self.scans, self.labels, self.params), "scan_id", "left").join(centroid_hash(self.voxels), "scan_id", "left")


def run(points: DataFrame, p: PipelineParams | None = None, seed: DataFrame | int = 1000, voxel_mode: str = "fast", cluster_mode: str = "components", ransac_mode: str = "arrays") -> PipelineResult:
    """Run the operators over every scan of ``points``.

    ``seed`` is a table (scan_id, seed), which may name scans without points,
    or a base to which scan_id is added.  cluster_mode: ``components`` (one
    grouped map), ``hooked`` (DataFrame loop), ``propagate``, ``propagate16``.
    ransac_mode: ``arrays`` (one grouped map) or ``joins`` (DataFrame operators).
    """
    p = p or PipelineParams()
    scans = seeds(points, seed) if isinstance(seed, int) else seed
    voxels = voxel_downsample(points, p, voxel_mode)
    best = (find_ground if ransac_mode == "joins" else best_planes)(voxels, scans, p)
    flagged = ground_flag(voxels, best, p)
    occ = occupancy(flagged, p)
    rounds = None
    if cluster_mode == "components":
        labels = connected_cells(occ, p)
    elif cluster_mode == "hooked":
        labels = hooked_components(occ, p)
    elif cluster_mode in ("propagate", "propagate16"):
        every = 16 if cluster_mode == "propagate16" else 1
        labels, rounds = propagate_labels(occ, p, every)
        rounds = scans.select("scan_id").join(rounds, "scan_id", "left").select("scan_id", F.coalesce("prop_iters", F.lit(every)).alias("prop_iters"))
    else:
        raise ValueError(f"unknown cluster mode {cluster_mode!r}")
    return PipelineResult(p, points, scans, voxels, best, flagged, occ, labels, component_sizes(labels), rounds)


def summary(points: DataFrame, p: PipelineParams | None = None, seed: DataFrame | int = 1000) -> DataFrame:
    """The fast path: the voxel aggregate, then one vectorised pass per scan; one row per scan."""
    p = p or PipelineParams()
    return detect(voxel_downsample(points, p), seeds(points, seed) if isinstance(seed, int) else seed, p)


def summary_of_scans(scans: DataFrame, p: PipelineParams | None = None, seed: int = 1000, packed: bool = False) -> DataFrame:
    """The path without a shuffle, for scans that are whole files (scan_id, content[, seed]); see ``operators.whole``."""
    return summarize(scans, p or PipelineParams(), seed, packed)


def label_voxels(points: DataFrame, p: PipelineParams | None = None, seed: int = 1000) -> DataFrame:
    p = p or PipelineParams()
    return detect_labels(voxel_downsample(points, p), seeds(points, seed), p)


def label_points(points: DataFrame, p: PipelineParams | None = None, seed: int = 1000) -> DataFrame:
    p = p or PipelineParams()
    return point_labels(points, label_voxels(points, p, seed), p)


def seed_sweep(points: DataFrame, p: PipelineParams, n_seeds: int, iters: tuple[int, ...] = (256, 1024, 4096), factor: int = 7919) -> DataFrame:
    """(frame, iters, seed, best_score, ground, clusters) for seeds 1..n times ``factor``; the voxel table is computed once per scan."""
    from dataclasses import replace

    voxels = voxel_downsample(points, p)
    spark = points.sparkSession
    runs = spark.range(1, n_seeds + 1).select(F.col("id").alias("sd"))
    scans = points.select("scan_id").distinct()
    out = None
    for k in iters:
        # a scan and a seed make a virtual scan
        pairs = scans.join(runs, how="cross").select(F.col("scan_id").alias("frame"), "sd", (F.col("scan_id") * n_seeds + F.col("sd") - 1).alias("scan_id"), (F.col("sd") * factor).alias("seed"))
        many = voxels.withColumnRenamed("scan_id", "frame").join(pairs.select("frame", "scan_id"), "frame").select("scan_id", "key", "x", "y", "z")
        found = detect(many, pairs.select("scan_id", "seed"), replace(p, ransac_iters=k)).join(pairs.select("scan_id", "frame", "sd"), "scan_id")
        found = found.select("frame", F.lit(k).alias("iters"), F.col("sd").alias("seed"), "best_score", F.col("n_ground").alias("ground"), F.col("n_clusters").alias("clusters"))
        out = found if out is None else out.unionByName(found)
    return out


#: Position of each number in a scan's statistics.
STATS = ("n_points", "n_voxels", "best_hyp", "best_score", "n_ground", "n_clusters", "n_small")


def stat(result: DataFrame, k: int) -> DataFrame:
    """(scan_id, value): the k-th statistic, -1 for a number that does not exist."""
    return result.select("scan_id", (F.col(STATS[k]).cast("long") if 0 <= k < len(STATS) else F.lit(-1).cast("long")).alias("value"))
