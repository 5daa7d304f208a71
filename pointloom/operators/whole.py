"""Whole scans as one value each: every stage in the task that read the file, no shuffle.

A scan file is one row (scan_id, content), so its points are together from the
start and nothing has to be grouped.  A task holds one scan at a time besides
the batch it came in; work and memory grow with the files a task reads, the
number of tasks with the input.  Centroids are added in single precision in point
order, so results equal ``voxel_mode="exact"`` bit for bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import PipelineParams
from .detect import detect_arrays, f4

SUMMARY = "scan_id long, n_points long, n_voxels long, best_hyp int, best_score int, n_ground int, n_cells int, n_clusters int, n_small int"
#: Up to this many voxels, places are looked up in a dense table.
_DENSE = 1 << 24


def decode(content: bytes, packed: bool, p: PipelineParams) -> np.ndarray:
    """(3, n) coordinates of a raw scan or a packed frame; a partial record at the end is dropped."""
    if not packed:
        n = len(content) // 16
        return np.ascontiguousarray(np.frombuffer(content, dtype="<f4", count=4 * n).reshape(n, 4)[:, :3].T)
    n = len(content) // 6
    steps = np.frombuffer(content, dtype="<u2", count=3 * n).reshape(n, 3).T.astype(np.float32)
    for k, (lo, hi) in enumerate(((p.xmin, p.xmax), (p.ymin, p.ymax), (p.zmin, p.zmax))):
        steps[k] = f4(lo) + (steps[k] + f4(0.5)) * f4((f4(hi) - f4(lo)) / f4(65536))
    return steps


def voxel_keys(xyz: np.ndarray, p: PipelineParams) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the points inside the region, their voxel numbers)."""
    inside = np.ones(xyz.shape[1], dtype=bool)
    for c, lo, hi in zip(xyz, (p.xmin, p.ymin, p.zmin), (p.xmax, p.ymax, p.zmax)):
        inside &= c >= f4(lo)
        inside &= c < f4(hi)
    at = np.flatnonzero(inside)
    key = np.zeros(len(at), dtype=np.int64)
    for c, lo, n in zip(xyz[::-1], (p.zmin, p.ymin, p.xmin), (p.nz, p.ny, p.nx)):
        # not negative inside the region, so the cast is the floor
        step = ((c[at] - f4(lo)) / f4(p.voxel)).astype(np.int32)
        key = key * n + np.minimum(step, n - 1)
    return at, key


@lru_cache(maxsize=1)
def _places(size: int) -> np.ndarray:
    """A worker's table from voxel number to place, used anew by each scan."""
    return np.zeros(size, dtype=np.int32)


def ranked(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys ascending, place of each key among them)."""
    if size > _DENSE:
        return np.unique(key, return_inverse=True)
    key = key.astype(np.int32)
    keys = np.sort(key)
    new = np.ones(len(keys), dtype=bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    keys, place = keys[new], _places(size)
    place[keys] = np.arange(len(keys), dtype=np.int32)
    return keys.astype(np.int64), place[key]


def centroids(xyz: np.ndarray, p: PipelineParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys ascending, counts, (voxels, 3) centroids, indices of points inside, their voxels)."""
    at, key = voxel_keys(xyz, p)
    keys, own = ranked(key, p.nx * p.ny * p.nz)
    n = np.bincount(own, minlength=len(keys))
    out = np.zeros((3, len(keys)), dtype=np.float32)
    for total, c in zip(out, xyz):
        np.add.at(total, own, c[at])  # one after the other, in point order
        total /= n.astype(np.float32)
    return keys, n, out.T, at, own


def _scans(batches: Iterator[pa.RecordBatch], packed: bool, p: PipelineParams):
    """(scan_id, points, keys, counts, centroids, indices inside, their voxels, results) of each scan."""
    for batch in batches:
        for scan, seed, content in zip(*(batch.column(k) for k in range(3))):
            xyz = decode(content.as_buffer() if content.is_valid else b"", packed, p)
            keys, n, xyzs, at, own = centroids(xyz, p)
            yield scan.as_py(), xyz.shape[1], keys, n, xyzs, at, own, detect_arrays(xyzs, seed.as_py(), p)


def _seeded(scans: DataFrame, seed: int) -> DataFrame:
    return scans.select("scan_id", F.col("seed") if "seed" in scans.columns else (F.col("scan_id") + seed).alias("seed"), "content")


def summarize(scans: DataFrame, p: PipelineParams, seed: int = 1000, packed: bool = False) -> DataFrame:
    """One summary row per row of ``scans`` (scan_id, content[, seed]); null content is a scan without points."""
    names = [c.split()[0] for c in SUMMARY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for scan, points, keys, _, _, _, _, r in _scans(batches, packed, p):
            large = int((r["sizes"] >= p.min_cells).sum())
            row = (scan, points, len(keys), r["best_hyp"], r["best_score"], int(r["ground"].sum()), len(r["occupied"]), large, len(r["sizes"]) - large)
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if k < 3 else pa.int32()) for k, v in enumerate(row)], names)

    return _seeded(scans, seed).mapInArrow(run, SUMMARY)


def voxel_label_array(r: dict, p: PipelineParams) -> np.ndarray:
    """-2 ground, -1 outside the grid or in a small component, else the component's label."""
    size = r["sizes"][np.searchsorted(r["roots"], r["labels"])]
    known = np.where(size >= p.min_cells, r["labels"], -1)
    if not len(known):
        return np.where(r["ground"], -2, -1).astype(np.int32)
    at = np.minimum(np.searchsorted(r["occupied"], r["cells"]), len(known) - 1)
    return np.where(r["ground"], -2, np.where(r["occupied"][at] == r["cells"], known[at], -1)).astype(np.int32)


def label_voxels(scans: DataFrame, p: PipelineParams, seed: int = 1000, packed: bool = False) -> DataFrame:
    """(scan_id, key, n, x, y, z, label) of every voxel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for scan, _, keys, n, xyz, _, _, r in _scans(batches, packed, p):
            columns = [np.full(len(keys), scan, dtype=np.int64), keys.astype(np.int64), n.astype(np.int64), *np.ascontiguousarray(xyz.T), voxel_label_array(r, p)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["scan_id", "key", "n", "x", "y", "z", "label"])

    return _seeded(scans, seed).mapInArrow(run, "scan_id long, key long, n long, x float, y float, z float, label int")


def label_points(scans: DataFrame, p: PipelineParams, seed: int = 1000, packed: bool = False) -> DataFrame:
    """(scan_id, idx, label) of every point; -1 outside the region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for scan, points, _, _, _, at, own, r in _scans(batches, packed, p):
            label = np.full(points, -1, dtype=np.int32)
            label[at] = voxel_label_array(r, p)[own]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(points, scan, dtype=np.int64)), pa.array(np.arange(points)), pa.array(label)], ["scan_id", "idx", "label"])

    return _seeded(scans, seed).mapInArrow(run, "scan_id long, idx long, label int")
