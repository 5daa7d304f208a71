"""Scan and frame readers; a point-cloud fixture from a relational table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import dequant, in_roi, quant
from ..params import POINTS, PipelineParams
from .folders import scratch_folder


def list_scans(spark: SparkSession, folder: str, max_scans: int = 0) -> DataFrame:
    """(scan_id, path, length): ``.bin`` files in path order; scan_id counts from 0.

    Paths are dealt out by ranges and numbered in each; a range starts after those before it.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "?*.bin").load(folder).select("path", "length")
    listing = scratch_folder(spark, "listing")
    files.repartitionByRange("path").withColumn("part", F.spark_partition_id()).write.parquet(listing)
    dealt = spark.read.schema("path string, length long, part int").parquet(listing)
    first, before = [0], 0
    for r in dealt.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        first += [0] * (r.part + 1 - len(first))
        first[r.part], before = before, before + r.n
    start = F.get(F.array(*[F.lit(n).cast("long") for n in first]), F.col("part"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("path"))
    out = dealt.select((start + own - 1).alias("scan_id"), "path", "length")
    return out.filter(F.col("scan_id") < max_scans) if max_scans else out


def pick_scans(spark: SparkSession, folder: str, start: int, step: int, count: int) -> DataFrame:
    """Files ``%010d.bin`` for start, start + step, ...; a missing one is an error."""
    want = spark.range(count).select(F.col("id").alias("frame"), (F.lit(start) + F.col("id") * step).alias("scan_id"))
    have = list_scans(spark, folder).select(F.regexp_extract("path", r"([0-9]{10})\.bin$", 1).alias("name"), "path", "length").filter("name <> ''")
    out = want.join(have, F.format_string("%010d", F.col("scan_id")) == F.col("name"), "left")
    there = F.when(F.col("path").isNotNull(), F.col("path")).otherwise(F.raise_error(F.format_string("no scan %d", F.col("scan_id"))))
    return out.select("frame", "scan_id", there.alias("path"), "length")


def _decode(dtype: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for scan, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len(content) // (np.dtype(dtype).itemsize * width)  # a partial record at the end is dropped
                rows = np.frombuffer(content, dtype=dtype, count=n * width).reshape(n, width)
                ids = [pa.array(np.full(n, scan, dtype=np.int64)), pa.array(np.arange(n))]
                kind = np.int32 if width == 3 else np.float32
                names = ["qx", "qy", "qz"] if width == 3 else ["x", "y", "z", "i"]
                for a in range(0, max(n, 1), 1 << 16):
                    yield pa.RecordBatch.from_arrays([c.slice(a, 1 << 16) for c in ids] + [pa.array(rows[a : a + (1 << 16), k].astype(kind)) for k in range(width)], ["scan_id", "idx", *names])

    return run


def _contents(spark: SparkSession, folder: str, scans: DataFrame) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "?*.bin").load(folder).select("path", "content")
    return files.join(scans.select("path", "scan_id"), "path").select("scan_id", "content")


def scan_contents(spark: SparkSession, folder: str, scans: DataFrame | None = None) -> DataFrame:
    """(scan_id, content) of every ``.bin`` file, whole.

    Without ``scans`` (scan_id, path) the number in the file's name is its
    scan_id, and files go from the reader to the operator without a join; a
    name without a number is an error.
    """
    if scans is not None:
        return _contents(spark, folder, scans)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "?*.bin").load(folder)
    number = F.regexp_extract("path", r"([0-9]+)\.bin$", 1)
    known = F.when(number != "", number.cast("long")).otherwise(F.raise_error(F.concat(F.lit("no number in the name of "), "path")))
    return files.select(known.alias("scan_id"), "content")


def read_scans(spark: SparkSession, folder: str, max_scans: int = 0, scans: DataFrame | None = None) -> DataFrame:
    """Points of raw scans (four little-endian floats each)."""
    scans = list_scans(spark, folder, max_scans) if scans is None else scans
    return _contents(spark, folder, scans).mapInArrow(_decode("<f4", 4), POINTS)


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    """(scan_id, idx, qx, qy, qz) of packed frames (three little-endian 16-bit steps each)."""
    return _contents(spark, folder, list_scans(spark, folder)).mapInArrow(_decode("<u2", 3), "scan_id long, idx long, qx int, qy int, qz int")


def pack_points(points: DataFrame, p: PipelineParams) -> DataFrame:
    """16-bit steps of the points inside the region."""
    inside = points.filter(in_roi(F.col("x"), F.col("y"), F.col("z"), p))
    steps = [quant(F.col(c), getattr(p, f"{c}min"), getattr(p, f"{c}max")).alias(f"q{c}") for c in "xyz"]
    return inside.select("scan_id", "idx", *steps)


def unpack_points(packed: DataFrame, p: PipelineParams) -> DataFrame:
    """Points in the middle of their steps; intensity 0."""
    xyz = [dequant(F.col(f"q{c}"), getattr(p, f"{c}min"), getattr(p, f"{c}max")).alias(c) for c in "xyz"]
    return packed.select("scan_id", "idx", *xyz, F.lit(0.0).cast("float").alias("i"))


# A point's coordinates follow from its number k alone.  They are computed once, below the aggregate: as
# aggregates themselves they keep filters on coordinates from being rewritten into one huge predicate on the scan.
FIXTURE_SQL = """
SELECT scan_id, k AS idx,
       CAST(CAST(min(xc) AS DOUBLE)/100 AS {F}) AS x, CAST(CAST(min(yc) AS DOUBLE)/100 AS {F}) AS y,
       CAST(CAST(min(zc) AS DOUBLE)/100 AS {F}) AS z, CAST(min(l_quantity) AS {F}) AS i
FROM (SELECT k, scan_id, l_quantity,
        CASE WHEN o=1 THEN ((a % 11)*700 - 3500) + (a % 181) WHEN o=2 THEN (a % 6007) - 3003 ELSE (a % 8387) - 4193 END AS xc,
        CASE WHEN o=1 THEN ((b % 11)*700 - 3500) + (b % 173) WHEN o=2 THEN 1500 + (b % 37) ELSE (b % 8389) - 4194 END AS yc,
        CASE WHEN o>=1 THEN (c % 263) - 110 ELSE (c % 31) - 185 END AS zc
      FROM (SELECT k, scan_id, l_quantity, (k*48271) % 2147483647 AS a, (k*69621 + 7) % 2147483647 AS b, (k*16807 + 13) % 2147483647 AS c,
                   CASE WHEN k % 10 < 2 THEN 1 WHEN k % 10 = 2 THEN 2 ELSE 0 END AS o
            FROM (SELECT l_orderkey*8 + l_linenumber AS k, l_orderkey % 4 AS scan_id, l_quantity FROM {lineitem}) q0) q1) q2
GROUP BY k, scan_id
"""


def fixture_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point cloud of four scans made from ``lineitem`` by integer arithmetic: ground, objects on a lattice, a wall."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(FIXTURE_SQL.format(F="FLOAT", lineitem="{lineitem}"), lineitem=lineitem)


def seeds(points: DataFrame, base: int = 1000) -> DataFrame:
    """(scan_id, seed): one row per scan."""
    return points.select("scan_id").distinct().withColumn("seed", F.col("scan_id") + base)
