"""FNV-1a fingerprints of a scan's ordered results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import FNV_BASIS, FNV_PRIME, fnv1a, little_endian
from ..params import PipelineParams


def fnv1a_bytes(data: bytes) -> int:
    """FNV-1a without a step per byte.

    The low byte of a state depends on low bytes alone, and each of its bits on a
    running xor and on the bits below it: eight passes give them all.  An xor with
    a byte is then a known addition, and the hash a polynomial in the prime.
    """
    b = np.frombuffer(data, dtype=np.uint8)
    mixed = np.zeros(len(b), dtype=np.uint8)
    for j in range(8):
        bit = (b >> j) & 1
        bit[1:] ^= ((mixed * np.uint8(FNV_PRIME & 0xFF)) >> j)[:-1] & 1
        bit[:1] ^= FNV_BASIS >> j & 1
        mixed |= np.bitwise_xor.accumulate(bit) << j
    added = mixed.astype(np.int32) - (mixed ^ b)
    powers = np.multiply.accumulate(np.full(len(b), FNV_PRIME, dtype=np.uint32), dtype=np.uint32)
    first = FNV_BASIS * pow(FNV_PRIME, len(b), 1 << 32)
    return (first + int((added.astype(np.uint32) * powers[::-1]).sum(dtype=np.uint32))) & 0xFFFFFFFF


def key_hash(voxels: DataFrame) -> DataFrame:
    """(scan_id, h_keys): keys in ascending order, four bytes each."""
    keys = voxels.groupBy("scan_id").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    return keys.select("scan_id", fnv1a(F.flatten(F.transform("keys", lambda k: little_endian(k)))).alias("h_keys"))


def label_hash(scans: DataFrame, cells: DataFrame, p: PipelineParams) -> DataFrame:
    """(scan_id, h_labels): labels of the dense grid, -1 in empty cells, four bytes each."""

    def dense(cell: np.ndarray, label: np.ndarray) -> int:
        grid = np.full(p.gw * p.gh, -1, dtype="<i4")
        grid[cell] = label
        return fnv1a_bytes(grid.tobytes())

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"scan_id": [pdf["scan_id"].iloc[0]], "h_labels": [dense(pdf["cell"].to_numpy(), pdf["label"].to_numpy())]})

    found = cells.select("scan_id", "cell", "label").groupBy("scan_id").applyInPandas(one, "scan_id long, h_labels long")
    none = np.zeros(0, dtype=np.int64)
    return scans.select("scan_id").join(found, "scan_id", "left").select("scan_id", F.coalesce("h_labels", F.lit(dense(none, none))).alias("h_labels"))


def centroid_hash(voxels: DataFrame) -> DataFrame:
    """(scan_id, h_centroids): the bits of x, y, z by ascending key.  Float bits have no SQL form: one task per scan."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        xyz = pdf.sort_values("key")[["x", "y", "z"]].to_numpy(dtype="<f4")
        return pd.DataFrame({"scan_id": [pdf["scan_id"].iloc[0]], "h_centroids": [fnv1a_bytes(np.ascontiguousarray(xyz).tobytes())]})

    return voxels.select("scan_id", "key", "x", "y", "z").groupBy("scan_id").applyInPandas(one, "scan_id long, h_centroids long")
