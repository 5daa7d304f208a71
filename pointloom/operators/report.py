"""Reports over timing, validation and seed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGES = ("h2d", "voxel", "ransac", "cluster", "d2h", "total")
#: The order of implementations in reports; the first is the base of speedups.
IMPLEMENTATIONS = ("cpu_t1", "cpu_t2", "cpu_t4", "cpu_t8", "cpu_t16", "gpu_thrust_uf", "gpu_hash_uf", "gpu_hash_prop", "gpu_hash_prop16")


def latency_summary(timing: DataFrame, base: str = "cpu_t1") -> DataFrame:
    """Per impl: median over scans of per-scan medians, p95 and maximum of the total, speedup against ``base``."""
    scan = timing.groupBy("impl", "scan").agg(*[F.median(c).alias(c) for c in (*STAGES, "prop_iters")])
    rows = scan.groupBy("impl").agg(
        *[F.median(c).alias(c) for c in STAGES],
        F.percentile("total", F.lit(0.95)).alias("total_p95"), F.max("total").alias("total_max"), F.median("prop_iters").alias("prop_iters_med"),
    )
    unit = rows.filter(F.col("impl") == base).select(F.col("total").alias("_base"))
    # one row: safe to broadcast
    return rows.join(F.broadcast(unit), how="cross").withColumn("speedup_vs_t1", F.try_divide("_base", "total")).drop("_base")


def in_report_order(df: DataFrame) -> DataFrame:
    """Known implementations in report order; others are left out."""
    place = F.array_position(F.array(*[F.lit(x) for x in IMPLEMENTATIONS]), F.col("impl"))
    return df.withColumn("_o", place).filter("_o > 0").orderBy("_o").drop("_o")


def input_scale(timing: DataFrame, validation: DataFrame, base: str = "cpu_t1") -> DataFrame:
    """One row: scans, and median points, voxels, ground and clusters."""
    a = timing.agg(F.count_distinct("scan").alias("scans"), F.median("n_points").alias("points"))
    b = validation.filter(F.col("impl") == base).agg(*[F.median(f"n_{c}").alias(c) for c in ("voxels", "ground", "clusters")])
    return a.join(b, how="cross")


def validation_summary(validation: DataFrame, base: str = "cpu_t1") -> DataFrame:
    """Per impl but the base: scans that differ, by kind of difference, and the largest differences."""
    n = lambda c, name: F.count_if(c).alias(name)
    return validation.filter(F.col("impl") != base).groupBy("impl").agg(
        n(F.col("voxel_count_diff") != 0, "voxel_count_differs"), n(F.col("key_mismatch") > 0, "keys_differ"),
        F.max("max_centroid_diff").alias("max_centroid_diff"), n(F.col("best_hyp_same") == 0, "best_hyp_differs"),
        n(F.col("score_diff") != 0, "score_differs"), F.max(F.abs("score_diff")).alias("max_score_diff"),
        n(F.col("ground_diff") != 0, "ground_differs"), n(F.col("label_mismatch") > 0, "labels_differ"), n(F.col("cluster_diff") != 0, "clusters_differ"),
    )


def upper_median(name: str) -> Column:
    """The middle value of a column; of an even number, the larger of the two."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{name}` DESC)")


def rolling_median(df: DataFrame, value: str, order: list[str], by: list[str], width: int = 12) -> DataFrame:
    """Add ``rolling``: median of the last ``width`` values."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(width - 1), 0)
    return df.withColumn("rolling", F.percentile(value, F.lit(0.5)).over(w))


def seed_spread(runs: DataFrame) -> DataFrame:
    """Per iters: median over frames of (max - min) of ground and clusters over seeds."""
    frame = runs.groupBy("frame", "iters").agg(*[(F.max(c) - F.min(c)).alias(c) for c in ("ground", "clusters")])
    return frame.groupBy("iters").agg(F.median("ground").alias("ground_spread"), F.median("clusters").alias("cluster_spread"))
