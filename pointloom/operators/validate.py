"""Comparison of two results, scan by scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .voxel import voxel_rank


def compare(ref: dict[str, DataFrame], other: dict[str, DataFrame]) -> DataFrame:
    """Eight differences per scan (other minus reference).

    Both sides hold tables ``voxels``, ``labels`` and ``result`` (scan_id,
    n_voxels, best_hyp, best_score, n_ground, n_clusters).
    """
    a, b = (voxel_rank(t["voxels"]).select("scan_id", "rn", "key", "x", "y", "z") for t in (ref, other))
    pairs = a.alias("a").join(b.alias("b"), ["scan_id", "rn"])
    same = F.col("a.key") == F.col("b.key")
    apart = F.greatest(*[F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in "xyz"]).cast("double")
    by_voxel = pairs.groupBy("scan_id").agg(F.count_if(~same).alias("key_mismatch"), F.coalesce(F.max(F.when(same, apart)), F.lit(0.0)).alias("max_centroid_diff"))
    u, v = (t["labels"].select("scan_id", "cell", F.col("label").alias(n)) for t, n in ((ref, "u"), (other, "v")))
    grid = u.join(v, ["scan_id", "cell"], "full").groupBy("scan_id").agg(F.count_if(F.coalesce("u", F.lit(-1)) != F.coalesce("v", F.lit(-1))).alias("label_mismatch"))
    r, s = ref["result"].alias("r"), other["result"].alias("s")
    diff = lambda c: (F.col(f"s.{c}") - F.col(f"r.{c}")).cast("int")
    out = r.join(s, "scan_id").join(by_voxel, "scan_id", "left").join(grid, "scan_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int").alias(c)
    return out.select(
        "scan_id", diff("n_voxels").alias("voxel_count_diff"), zero("key_mismatch"), F.coalesce("max_centroid_diff", F.lit(0.0)).alias("max_centroid_diff"),
        (F.col("s.best_hyp") == F.col("r.best_hyp")).cast("int").alias("best_hyp_same"), diff("best_score").alias("score_diff"),
        diff("n_ground").alias("ground_diff"), zero("label_mismatch"), diff("n_clusters").alias("cluster_diff"),
    )


def occupancy_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(scan_id, occ_diff): cells occupied on one side only; scans without any cell are left out."""
    u, v = a.select("scan_id", "cell", F.lit(1).alias("u")), b.select("scan_id", "cell", F.lit(1).alias("v"))
    return u.join(v, ["scan_id", "cell"], "full").groupBy("scan_id").agg(F.count_if(F.col("u").isNull() | F.col("v").isNull()).alias("occ_diff"))


def golden_check(actual: DataFrame, golden: DataFrame, fields: tuple[str, ...], on: str = "file") -> DataFrame:
    """(file, key, got, want, same) for each field of each frame; a missing frame has null ``got``."""
    long = lambda df, n: df.unpivot([on], [F.col(c).cast("long").alias(c) for c in fields], "key", n)
    both = long(golden.select(on, *[F.col(c).cast("long").alias(c) for c in fields]), "want").join(long(actual.select(on, *[F.col(c).cast("long").alias(c) for c in fields]), "got"), [on, "key"], "left")
    return both.select(on, "key", "got", "want", F.coalesce(F.col("got") == F.col("want"), F.lit(False)).alias("same"))


def first_mismatches(checks: DataFrame, n: int = 6, on: str = "file") -> DataFrame:
    return checks.filter("not same").orderBy(on, "key").limit(n)
