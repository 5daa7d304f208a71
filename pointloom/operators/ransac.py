"""Ground plane: seeded hypotheses, planes, scores, best plane."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import is_inlier, plane3
from ..functions.sequences import random_sequence
from ..params import PipelineParams
from .detect import count_inliers
from .voxel import voxel_rank

PLANE = "struct<a:float,b:float,c:float,d:float>"


def hypotheses(scans: DataFrame, iters: int) -> DataFrame:
    """(scan_id, hyp, slot, s) for scans with a ``seed``: three random states per hypothesis.

    The states depend on the seed alone; the voxel count enters by a join.
    """
    drawn = scans.select("scan_id", F.posexplode(random_sequence(F.col("seed"), 3 * iters)).alias("k", "s"))
    return drawn.select("scan_id", F.floor(F.col("k") / 3).cast("int").alias("hyp"), (F.col("k") % 3).alias("slot"), "s")


def plane_fit(ranked: DataFrame, hyps: DataFrame, p: PipelineParams) -> DataFrame:
    """(scan_id, hyp, plane): valid planes only.  A scan without voxels has none."""
    counts = ranked.groupBy("scan_id").agg(F.count("*").alias("nv"))
    picks = hyps.join(counts, "scan_id").select("scan_id", "hyp", "slot", (F.col("s") % F.col("nv")).alias("rn"))
    corner = picks.join(ranked.select("scan_id", "rn", F.struct("x", "y", "z").alias("v")), ["scan_id", "rn"])
    three = corner.groupBy("scan_id", "hyp").agg(*[F.max(F.when(F.col("slot") == k, F.col("v"))).alias(f"v{k}") for k in range(3)])
    return three.select("scan_id", "hyp", plane3(F.col("v0"), F.col("v1"), F.col("v2"), p.min_nz).alias("plane")).filter("plane is not null")


def plane_scores(voxels: DataFrame, planes: DataFrame, hyps: DataFrame, p: PipelineParams) -> DataFrame:
    """(scan_id, hyp, score): inliers of each hypothesis, -1 where its plane is invalid.

    Voxels and planes of a scan meet in one task (both bounded by the grid and
    the number of hypotheses) and are compared as single-precision arrays, so
    their pairs never become rows.
    """

    def one(key: tuple, v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        xyz, abcd = v[["x", "y", "z"]].to_numpy(dtype=np.float32), q[["a", "b", "c", "d"]].to_numpy(dtype=np.float32)
        return pd.DataFrame({"scan_id": key[0], "hyp": q["hyp"].to_numpy(), "score": count_inliers(abcd, xyz, p.ransac_thresh).astype(np.int32)})

    flat = planes.select(F.col("scan_id").alias("sid"), "hyp", *[F.col(f"plane.{c}").alias(c) for c in "abcd"])
    pairs = voxels.select("scan_id", "x", "y", "z").groupBy("scan_id").cogroup(flat.groupBy("sid"))
    counted = pairs.applyInPandas(one, "scan_id long, hyp int, score int")
    every = hyps.select("scan_id", "hyp").distinct()
    return every.join(counted, ["scan_id", "hyp"], "left").select("scan_id", "hyp", F.coalesce("score", F.lit(-1)).alias("score"))


def best_plane(scans: DataFrame, scores: DataFrame, planes: DataFrame) -> DataFrame:
    """(scan_id, best_hyp, best_score, plane): most inliers, then the lowest number; (-1, -1, null) without a valid plane."""
    valid = scores.filter("score >= 0").join(planes, ["scan_id", "hyp"])
    top = valid.groupBy("scan_id").agg(F.max_by(F.struct("hyp", "score", "plane"), F.struct("score", -F.col("hyp"))).alias("b"))
    out = scans.select("scan_id").join(top, "scan_id", "left")
    return out.select("scan_id", F.coalesce("b.hyp", F.lit(-1)).alias("best_hyp"), F.coalesce("b.score", F.lit(-1)).alias("best_score"), F.col("b.plane").alias("plane"))


def find_ground(voxels: DataFrame, scans: DataFrame, p: PipelineParams) -> DataFrame:
    """Best plane of every scan (``scans``: scan_id, seed)."""
    hyps = hypotheses(scans, p.ransac_iters)
    planes = plane_fit(voxel_rank(voxels), hyps, p)
    return best_plane(scans, plane_scores(voxels, planes, hyps, p), planes)


def ground_flag(voxels: DataFrame, best: DataFrame, p: PipelineParams) -> DataFrame:
    """Add ``ground`` to voxels; false in scans without a plane."""
    joined = voxels.join(best.select("scan_id", "plane"), "scan_id", "left")
    hit = F.coalesce(is_inlier(F.col("plane"), F.col("x"), F.col("y"), F.col("z"), p.ransac_thresh), F.lit(False))
    return joined.withColumn("ground", hit).drop("plane")
