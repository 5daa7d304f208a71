"""Ground, grid and clusters of each scan in one vectorised grouped map.

After the voxel aggregate a scan holds at most nx * ny * nz centroids, however
many points it had, so one task per scan is bounded.  Plane scoring is the
heavy step (hypotheses x voxels): here it runs on single-precision arrays,
block by block, and makes no rows.  Results equal the DataFrame operators of
``ransac`` and ``grid``; tests compare them.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import PipelineParams
from .grid import label_grid

SUMMARY = "scan_id long, n_voxels long, best_hyp int, best_score int, n_ground int, n_cells int, n_clusters int, n_small int"
_BLOCK = 8192
#: Voxels of one plane's pass: three columns and two buffers stay in cache.
_RUN = 16384
#: Parts of a scan's voxels for which boxes bound a plane's count each by itself, at most.
_PARTS = 8
#: Edges of the boxes of voxels that bound a plane's count.
_BOX = np.array([3.2, 3.2, 0.4])
f4 = np.float32


@lru_cache(maxsize=4096)
def random_states(seed: int, n: int) -> np.ndarray:
    s, out = seed & 0xFFFFFFFF or 1, []
    for _ in range(n):
        s ^= s << 13 & 0xFFFFFFFF
        s ^= s >> 17
        s ^= s << 5 & 0xFFFFFFFF
        out.append(s)
    return np.array(out, dtype=np.int64)


def fit_planes(xyz: np.ndarray, states: np.ndarray, min_nz: float) -> np.ndarray:
    """(hypotheses, 4) planes in single precision; NaN where invalid."""
    v = xyz[(states % len(xyz)).reshape(-1, 3)]
    u, w = v[:, 1] - v[:, 0], v[:, 2] - v[:, 0]
    n = np.stack([u[:, 1] * w[:, 2] - u[:, 2] * w[:, 1], u[:, 2] * w[:, 0] - u[:, 0] * w[:, 2], u[:, 0] * w[:, 1] - u[:, 1] * w[:, 0]], axis=1)
    length = np.sqrt(n[:, 0] * n[:, 0] + n[:, 1] * n[:, 1] + n[:, 2] * n[:, 2])
    with np.errstate(divide="ignore", invalid="ignore"):
        n = n / length[:, None]
    d = -(n[:, 0] * v[:, 0, 0] + n[:, 1] * v[:, 0, 1] + n[:, 2] * v[:, 0, 2])
    ok = (length >= f4(1e-6)) & (np.abs(n[:, 2]) >= f4(min_nz))
    return np.where(ok[:, None], np.column_stack([n, d]), f4(np.nan)).astype(np.float32)


def inliers(planes: np.ndarray, xyz: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean (planes, voxels); a NaN plane has none."""
    a, b, c, d = (planes[:, k, None] for k in range(4))
    out = a * xyz[:, 0]
    out += b * xyz[:, 1]
    out += c * xyz[:, 2]
    out += d
    return np.abs(out, out=out) < f4(threshold)


def count_inliers(planes: np.ndarray, xyz: np.ndarray, threshold: float) -> np.ndarray:
    """Voxels on each plane, a block of voxels at a time."""
    total = np.zeros(len(planes), dtype=np.int64)
    for a in range(0, len(xyz), _BLOCK):
        total += np.count_nonzero(inliers(planes, xyz[a : a + _BLOCK], threshold), axis=1)
    return total


def _part_ends(n: int) -> list[int]:
    """Ends of the parts of ``n`` voxels, each of whole runs."""
    runs = -(-n // _RUN)
    parts = min(_PARTS, runs)
    return [min(n, (k + 1) * runs // parts * _RUN) for k in range(parts)]


def _boxes(xyz: np.ndarray, ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float] | None:
    """(centres, voxels of each part in each, half edges, bound of rounding) of the boxes that hold voxels; None where a grid of boxes does not pay."""
    if not len(xyz) or len(xyz) >= 1 << 24:
        return None
    low, high = xyz.min(axis=0).astype(np.float64), xyz.max(axis=0).astype(np.float64)
    if not np.isfinite(high - low).all():
        return None
    shape = np.floor((high - low) / _BOX).astype(np.int64) + 1
    if shape.prod() > 16 * len(xyz):
        return None
    place = np.zeros(len(xyz), dtype=np.int32)
    for c, lo, edge, n in zip(xyz.T, low, _BOX, shape):
        # rounding may put a voxel one box too far; that is inside the bound
        place *= np.int32(n)
        place += np.minimum(((c - f4(lo)) * f4(1 / edge)).astype(np.int32), np.int32(n - 1))
    held = np.flatnonzero(np.bincount(place))
    size = np.stack([np.bincount(place[a:b], minlength=held[-1] + 1)[held] for a, b in zip([0, *ends], ends)], axis=1)
    centres = low + (np.stack(np.unravel_index(held, shape), axis=1) + 0.5) * _BOX
    # 24 bits of a number up to the largest coordinate, three products and sums of them, here and in the pass itself
    return centres.astype(np.float32), size.astype(np.float32), (_BOX / 2).astype(np.float32), float(np.abs([low, high]).max() * 2e-5 + 1e-6)


def possible_inliers(planes: np.ndarray, xyz: np.ndarray, threshold: float) -> np.ndarray:
    """For each plane and part of the voxels at least as many as lie on it: those of every box that it comes near."""
    ends = _part_ends(len(xyz))
    boxes = _boxes(xyz, ends)
    if boxes is None:
        return np.tile(np.diff([0, *ends]), (len(planes), 1))
    centres, size, half, rounding = boxes
    reach = np.abs(planes[:, :3]) @ half + f4(threshold + rounding)
    out = np.empty((len(planes), len(ends)), dtype=np.int64)
    for a in range(0, len(planes), 32):
        far = planes[a : a + 32, :3] @ centres.T
        far += planes[a : a + 32, 3:]
        out[a : a + 32] = (np.abs(far, out=far) <= reach[a : a + 32, None]).astype(np.float32) @ size
    return out


def most_inliers(planes: np.ndarray, xyz: np.ndarray, threshold: float) -> tuple[int, int]:
    """(first plane with most voxels on it, how many).

    Planes come in descending order of what boxes of voxels leave possible, until
    that is less than the best so far; then one plane after the other over blocks
    that stay in cache, left as soon as what is possible in those still to come
    cannot lift it.
    """
    columns = np.ascontiguousarray(xyz.T)
    blocks = [tuple(np.ascontiguousarray(c[a : a + _RUN]) for c in columns) for a in range(0, len(xyz), _RUN)]
    out, term, near = np.empty(_RUN, np.float32), np.empty(_RUN, np.float32), np.empty(_RUN, bool)
    best, most, limit = -1, -1, f4(threshold)
    possible, ends = possible_inliers(planes, xyz, threshold), _part_ends(len(xyz))
    whole = possible.sum(axis=1)
    # the part that each block is in, and what is possible in the parts after each
    part = np.searchsorted(ends, [min(a + _RUN, len(xyz)) for a in range(0, len(xyz), _RUN)])
    later = np.flip(np.cumsum(np.flip(possible, axis=1), axis=1), axis=1) - possible
    for k in np.argsort(-whole, kind="stable"):
        if whole[k] < most:
            break
        a, b, c, d = planes[k]
        total, seen = 0, 0
        for i, (x, y, z) in zip(part, blocks):
            n = len(x)
            v, w, m = out[:n], term[:n], near[:n]
            np.multiply(x, a, out=v)
            v += np.multiply(y, b, out=w)
            v += np.multiply(z, c, out=w)
            v += d
            np.less(np.abs(v, out=v), limit, out=m)
            total += np.count_nonzero(m)
            seen += n
            # the rest of this part counts in full, the parts after it by their boxes
            if total + ends[i] - seen + later[k, i] < most:
                break
        if total > most or (total == most and k < best):
            best, most = int(k), total
    return best, int(most)


def best_plane_arrays(xyz: np.ndarray, seed: int, p: PipelineParams) -> tuple[int, int, np.ndarray | None, np.ndarray]:
    """(hypothesis, score, plane, ground flags); (-1, -1, None, no ground) without a valid plane."""
    ground = np.zeros(len(xyz), dtype=bool)
    if not len(xyz) or not p.ransac_iters:
        return -1, -1, None, ground
    planes = fit_planes(xyz, random_states(seed, 3 * p.ransac_iters), p.min_nz)
    valid = np.flatnonzero(~np.isnan(planes[:, 0]))
    if not len(valid):
        return -1, -1, None, ground
    k, score = most_inliers(planes[valid], xyz, p.ransac_thresh)
    best = planes[valid[k]]
    return int(valid[k]), score, best, inliers(best[None, :], xyz, p.ransac_thresh)[0]


def detect_arrays(xyz: np.ndarray, seed: int, p: PipelineParams) -> dict:
    """Results for the centroids of one scan in ascending key order."""
    best, score, _, ground = best_plane_arrays(xyz, seed, p)
    cx = np.floor((xyz[:, 0] - f4(p.xmin)) / f4(p.cell)).astype(np.int64)
    cy = np.floor((xyz[:, 1] - f4(p.ymin)) / f4(p.cell)).astype(np.int64)
    inside = (cx >= 0) & (cy >= 0) & (cx < p.gw) & (cy < p.gh)
    cells = np.where(inside, cy * p.gw + cx, -1)
    occupied = np.unique(cells[~ground & inside])
    labels = label_grid(occupied, p.gw, p.gh) if len(occupied) else occupied
    roots, sizes = np.unique(labels, return_counts=True)
    return {"best_hyp": best, "best_score": score, "ground": ground, "cells": cells, "occupied": occupied, "labels": labels, "roots": roots, "sizes": sizes}


def _scan_arrays(pdf: pd.DataFrame, p: PipelineParams) -> tuple[pd.DataFrame, dict]:
    pdf = pdf.sort_values("key", ignore_index=True)
    return pdf, detect_arrays(pdf[["x", "y", "z"]].to_numpy(dtype=np.float32), int(pdf["seed"].iloc[0]), p)


def detect(voxels: DataFrame, scans: DataFrame, p: PipelineParams) -> DataFrame:
    """One summary row per scan of ``scans`` (scan_id, seed); scans without voxels have best (-1, -1) and zeros."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, r = _scan_arrays(pdf, p)
        large = int((r["sizes"] >= p.min_cells).sum())
        return pd.DataFrame([[int(pdf["scan_id"].iloc[0]), len(pdf), r["best_hyp"], r["best_score"], int(r["ground"].sum()), len(r["occupied"]), large, len(r["sizes"]) - large]], columns=[c.split()[0] for c in SUMMARY.split(", ")])

    seeded = voxels.select("scan_id", "key", "x", "y", "z").join(scans.select("scan_id", "seed"), "scan_id")
    found = seeded.groupBy("scan_id").applyInPandas(one, SUMMARY)
    out = scans.select("scan_id").join(found, "scan_id", "left")
    return out.select("scan_id", *[F.coalesce(c, F.lit(-1 if c.startswith("best") else 0).cast(found.schema[c].dataType)).alias(c) for c in found.columns[1:]])


def best_planes(voxels: DataFrame, scans: DataFrame, p: PipelineParams) -> DataFrame:
    """The table of ``ransac.find_ground``, from single-precision arrays."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ignore_index=True)
        hyp, score, plane, _ = best_plane_arrays(pdf[["x", "y", "z"]].to_numpy(dtype=np.float32), int(pdf["seed"].iloc[0]), p)
        abcd = [None] * 4 if plane is None else [float(v) for v in plane]
        return pd.DataFrame([[int(pdf["scan_id"].iloc[0]), hyp, score, *abcd]], columns=["scan_id", "best_hyp", "best_score", *"abcd"])

    seeded = voxels.select("scan_id", "key", "x", "y", "z").join(scans.select("scan_id", "seed"), "scan_id")
    found = seeded.groupBy("scan_id").applyInPandas(one, "scan_id long, best_hyp int, best_score int, a float, b float, c float, d float")
    out = scans.select("scan_id").join(found, "scan_id", "left")
    plane = F.when(F.col("a").isNotNull(), F.struct("a", "b", "c", "d"))
    return out.select("scan_id", F.coalesce("best_hyp", F.lit(-1)).alias("best_hyp"), F.coalesce("best_score", F.lit(-1)).alias("best_score"), plane.alias("plane"))


def detect_labels(voxels: DataFrame, scans: DataFrame, p: PipelineParams) -> DataFrame:
    """(scan_id, key, x, y, z, label) of every voxel."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, r = _scan_arrays(pdf, p)
        size = r["sizes"][np.searchsorted(r["roots"], r["labels"])]
        known = np.where(size >= p.min_cells, r["labels"], -1)
        at = np.searchsorted(r["occupied"], r["cells"])
        at[at == len(r["occupied"])] = 0
        own = np.full(len(pdf), -1) if not len(known) else np.where(r["occupied"][at] == r["cells"], known[at], -1)
        pdf["label"] = np.where(r["ground"], -2, own).astype(np.int32)
        return pdf[["scan_id", "key", "x", "y", "z", "label"]]

    seeded = voxels.select("scan_id", "key", "x", "y", "z").join(scans.select("scan_id", "seed"), "scan_id")
    return seeded.groupBy("scan_id").applyInPandas(one, "scan_id long, key long, x float, y float, z float, label int")
