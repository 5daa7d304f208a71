"""Occupancy grid and its connected components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import bev_cell
from ..params import PipelineParams
from ..sources.folders import scratch_folder


def occupancy(flagged: DataFrame, p: PipelineParams) -> DataFrame:
    """(scan_id, cell): cells with a voxel that is not ground, by its centroid."""
    cells = flagged.filter("not ground").select("scan_id", bev_cell(F.col("x"), F.col("y"), p).alias("cell"))
    return cells.filter("cell is not null").distinct()


def label_grid(occupied: np.ndarray, gw: int, gh: int) -> np.ndarray:
    """Smallest cell reachable over eight neighbours, for each occupied cell (sorted ascending)."""
    place = np.full((gh + 2, gw + 2), -1, dtype=np.int64)
    y, x = occupied // gw + 1, occupied % gw + 1
    place[y, x] = np.arange(len(occupied))
    # links to the neighbour on the right and the three below; places ascend as cells do
    near = np.concatenate([place[y + dy, x + dx] for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])
    own = np.tile(np.arange(len(occupied)), 4)[near >= 0]
    near = near[near >= 0]
    root = np.arange(len(occupied))
    while True:
        a, b = root[own], root[near]
        apart = a != b
        if not apart.any():
            return occupied.astype(np.int64)[root]
        own, near, a, b = own[apart], near[apart], a[apart], b[apart]
        # the larger root takes the smaller one, then everyone follows to the end
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up


def connected_cells(occ: DataFrame, p: PipelineParams) -> DataFrame:
    """(scan_id, cell, label): label is the smallest cell of the 8-connected component.

    One task per scan holds at most gw * gh cells.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = np.sort(pdf["cell"].to_numpy())
        return pd.DataFrame({"scan_id": pdf["scan_id"].iloc[0], "cell": cells.astype(np.int32), "label": label_grid(cells.astype(np.int64), p.gw, p.gh).astype(np.int32)})

    return occ.groupBy("scan_id").applyInPandas(one, "scan_id long, cell int, label int")


def neighbours(occ: DataFrame, p: PipelineParams) -> DataFrame:
    """(scan_id, u, v): both directions of every pair of neighbouring cells, without wrapping at row ends."""
    near = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]))
    a = occ.select("scan_id", F.col("cell").alias("u"), near.alias("o"))
    a = a.filter((F.col("u") % p.gw + F.col("o.dx")).between(0, p.gw - 1)).select("scan_id", "u", (F.col("u") + F.col("o.dy") * p.gw + F.col("o.dx")).alias("v"))
    return a.join(occ.select("scan_id", F.col("cell").alias("v")), ["scan_id", "v"]).select("scan_id", "u", "v")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of an iterative plan by a table in the shared folder."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(occupied: np.ndarray, gw: int, gh: int) -> tuple[np.ndarray, int]:
    """Labels by synchronous propagation, and the rounds up to the first that changes nothing."""
    grid = np.full((gh + 2, gw + 2), gw * gh, dtype=np.int64)
    y, x = occupied // gw + 1, occupied % gw + 1
    lab, rounds = occupied.astype(np.int64), 0
    while True:
        grid[y, x] = lab
        low = np.minimum.reduce([grid[y + dy, x + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        rounds += 1
        if (low == lab).all():
            return lab, rounds
        lab = low


def propagate_labels(occ: DataFrame, p: PipelineParams, every: int = 1) -> tuple[DataFrame, DataFrame]:
    """Synchronous label propagation; returns labels and (scan_id, prop_iters).

    A scan's rounds are counted until one changes nothing, rounded up to a
    multiple of ``every``.  One task per scan holds at most gw * gh cells.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = np.sort(pdf["cell"].to_numpy()).astype(np.int64)
        lab, rounds = spread(cells, p.gw, p.gh)
        return pd.DataFrame({"scan_id": pdf["scan_id"].iloc[0], "cell": cells.astype(np.int32), "label": lab.astype(np.int32), "prop_iters": -(-rounds // every) * every})

    out = occ.groupBy("scan_id").applyInPandas(one, "scan_id long, cell int, label int, prop_iters int")
    return out.select("scan_id", "cell", "label"), out.groupBy("scan_id").agg(F.max("prop_iters").alias("prop_iters"))


def propagate_by_joins(occ: DataFrame, p: PipelineParams, every: int = 1, max_rounds: int = 4096) -> tuple[DataFrame, DataFrame]:
    """``propagate_labels`` with DataFrame operations, one join and aggregate per round; raises after ``max_rounds``."""
    occ = _kept(occ, "occ")
    edges = _kept(neighbours(occ, p), "edges")
    now = occ.select("scan_id", "cell", F.col("cell").alias("label"), F.lit(0).alias("moved"))
    for k in range(1, max_rounds + 1):
        low = edges.join(now.select("scan_id", F.col("cell").alias("v"), "label"), ["scan_id", "v"]).groupBy("scan_id", F.col("u").alias("cell")).agg(F.min("label").alias("low"))
        step = now.join(low, ["scan_id", "cell"], "left").select("scan_id", "cell", F.least("label", F.coalesce("low", "label")).alias("new"), "label", "moved")
        now = _kept(step.select("scan_id", "cell", F.col("new").alias("label"), F.when(F.col("new") < F.col("label"), k).otherwise(F.col("moved")).alias("moved")), "labels")
        if now.filter(F.col("moved") == k).isEmpty():
            rounds = now.groupBy("scan_id").agg((F.ceil((F.max("moved") + 1) / every) * every).cast("int").alias("prop_iters"))
            return now.select("scan_id", "cell", "label"), rounds
    raise RuntimeError(f"labels did not settle in {max_rounds} rounds")


def hooked_components(occ: DataFrame, p: PipelineParams) -> DataFrame:
    """The components with DataFrame operations alone: hook roots to smaller neighbours, then follow pointers."""
    occ = _kept(occ, "occ")
    edges = _kept(neighbours(occ, p), "edges")
    now = occ.select("scan_id", "cell", F.col("cell").alias("label"))
    while True:
        right = now.select("scan_id", F.col("cell").alias("v"), F.col("label").alias("lv"))
        seen = edges.join(right, ["scan_id", "v"]).join(now.select("scan_id", F.col("cell").alias("u"), F.col("label").alias("lu")), ["scan_id", "u"])
        hooks = seen.filter("lv < lu").groupBy("scan_id", F.col("lu").alias("label")).agg(F.min("lv").alias("to"))
        hooks = _kept(hooks, "hooks")
        if hooks.isEmpty():
            return now
        now = now.join(hooks, ["scan_id", "label"], "left").select("scan_id", "cell", F.coalesce("to", "label").alias("label"))
        up = now.select("scan_id", F.col("cell").alias("label"), F.col("label").alias("up"))
        now = _kept(now.join(up, ["scan_id", "label"]).select("scan_id", "cell", F.col("up").alias("label")), "labels")


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("scan_id", "label").agg(F.count("*").alias("cells"))


def cluster_counts(scans: DataFrame, sizes: DataFrame, p: PipelineParams) -> DataFrame:
    """(scan_id, n_clusters, n_small) of every scan."""
    found = sizes.groupBy("scan_id").agg(F.count_if(F.col("cells") >= p.min_cells).alias("n_clusters"), F.count_if(F.col("cells") < p.min_cells).alias("n_small"))
    out = scans.select("scan_id").join(found, "scan_id", "left")
    return out.select("scan_id", F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"), F.coalesce("n_small", F.lit(0)).alias("n_small"))
