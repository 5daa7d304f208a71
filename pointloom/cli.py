"""Command line: ``python -m pointloom.cli summary|label|pack|ref|seeds|bench|analyze ...``"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.report import in_report_order, input_scale, latency_summary, validation_summary
from .operators.validate import compare, occupancy_diff
from .params import PipelineParams
from .plans import pipeline
from .sources.scans import list_scans, pack_points, pick_scans, read_frames, read_scans, scan_contents, unpack_points
from .sources.tables import TIMING, VALIDATION, export_frames, read_csv, write_csv, write_frames, write_golden

P = PipelineParams()
#: Implementations that the benchmark compares: name, voxel, cluster and plane search mode.
MODES = {"exact": ("exact", "components", "arrays"), "fast": ("fast", "components", "arrays"), "joins": ("fast", "components", "joins"), "hooked": ("fast", "hooked", "arrays"), "propagate": ("fast", "propagate", "arrays"), "propagate16": ("fast", "propagate16", "arrays")}


def bench(spark: SparkSession, folder: str, prefix: str, reps: int, max_scans: int, modes: list[str]) -> None:
    """Timing and validation tables of several modes against the first."""
    points = read_scans(spark, folder, max_scans).persist()
    runs = {}
    times = []
    for name in modes:
        v, c, r = MODES[name]
        for rep in range(reps):
            began = time.perf_counter()
            runs[name] = pipeline.run(points, P, voxel_mode=v, cluster_mode=c, ransac_mode=r)
            n = runs[name].result.agg(F.count("*").alias("s"), F.sum("n_points").alias("p"), F.sum("n_voxels").alias("v")).first()
            ms = (time.perf_counter() - began) * 1000 / max(1, n.s)
            rounds = runs[name].prop_iters.agg(F.max("prop_iters")).first()[0] if runs[name].prop_iters is not None else 0
            times.append((0, name, rep, n.p // max(1, n.s), n.v // max(1, n.s), 0.0, 0.0, 0.0, 0.0, 0.0, ms, rounds))
    write_csv(spark.createDataFrame(times, TIMING), f"{prefix}_timing.csv", "overwrite")
    sides = {n: {"voxels": r.voxels, "labels": r.labels, "result": r.result} for n, r in runs.items()}
    out: DataFrame | None = None
    for name, side in sides.items():
        numbers = side["result"].select("scan_id", "n_voxels", F.col("n_ground").cast("int").alias("n_ground"), F.col("n_clusters").cast("int").alias("n_clusters"))
        one = compare(sides[modes[0]], side).join(numbers, "scan_id").withColumn("impl", F.lit(name)).withColumnRenamed("scan_id", "scan")
        out = one if out is None else out.unionByName(one)
    write_csv(out.select(*[c.split()[0] for c in VALIDATION.split(", ")]), f"{prefix}_validate.csv", "overwrite")


def analyze(spark: SparkSession, prefix: str, base: str) -> DataFrame:
    t, v = read_csv(spark, f"{prefix}_timing.csv", TIMING), read_csv(spark, f"{prefix}_validate.csv", VALIDATION)
    rows = latency_summary(t, base)
    in_report_order(rows).show(truncate=False) if base == "cpu_t1" else rows.show(truncate=False)
    input_scale(t, v, base).show()
    validation_summary(v, base).show(truncate=False)
    write_csv(rows, f"{prefix}_summary.csv", "overwrite")
    return rows


def pack(spark: SparkSession, folder: str, out: str, start: int, step: int, count: int) -> DataFrame:
    """Packed frames in ``out`` and a report of raw against packed results."""
    picked = pick_scans(spark, folder, start, step, count)
    points = read_scans(spark, folder, scans=picked)
    packed = pack_points(points, P)
    frames = packed.join(F.broadcast(picked.select("scan_id", "frame")), "scan_id").drop("scan_id").withColumnRenamed("frame", "scan_id")
    export_frames(write_frames(frames, f"{out}/_frames.parquet"), out)
    scans = picked.select("scan_id", (F.col("scan_id") + 1000).alias("seed"))
    a, b = pipeline.run(points, P, scans), pipeline.run(unpack_points(packed, P), P, scans)
    keep = ("n_points", "n_voxels", "n_ground", "n_clusters")
    side = lambda r, t: r.result.select("scan_id", *[F.col(c).alias(c + t) for c in keep])
    return side(a, "").join(side(b, "_packed"), "scan_id").join(occupancy_diff(a.occ, b.occ), "scan_id", "left")


def ref(spark: SparkSession, folder: str, out: str, start: int, step: int, reps: int) -> None:
    """Golden file of packed frames; scan = start + frame * step, seed = 1000 + scan."""
    points = unpack_points(read_frames(spark, folder), P)
    scans = points.select("scan_id").distinct().withColumn("seed", F.col("scan_id") * step + (start + 1000))
    times = []
    for _ in range(reps):
        began = time.perf_counter()
        pipeline.summary(points, P, scans).write.format("noop").mode("overwrite").save()
        times.append((time.perf_counter() - began) * 1000)
    r = pipeline.run(points, P, scans, voxel_mode="exact")
    total = sorted(times)[len(times) // 2] if times else 0.0
    rows = r.result.join(r.fingerprints, "scan_id").join(scans, "scan_id").select(
        F.format_string("f%02d.bin", "scan_id").alias("file"), (F.col("seed") - 1000).alias("scan"), "seed", F.col("n_points").alias("points"), F.col("n_voxels").alias("voxels"),
        "best_hyp", "best_score", F.col("n_ground").alias("ground"), F.col("n_clusters").alias("clusters"), F.col("n_small").alias("small"), "h_keys", "h_labels", "h_centroids",
        F.struct(F.lit(total).alias("total")).alias("native_ms"),
    )
    write_golden(rows, out)


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="pointloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a[0], **({"type": a[1]} if len(a) > 1 else {}), **({"nargs": "?", "default": a[2]} if len(a) > 2 else {}))
        return p

    command("summary", ("folder",), ("out",), ("max_scans", int, 0))
    command("label", ("folder",), ("out",), ("max_scans", int, 0))
    command("bench", ("folder",), ("prefix",), ("reps", int, 5), ("max_scans", int, 0)).add_argument("--modes", nargs="+", default=["exact", "fast", "joins", "hooked"], choices=MODES)
    command("analyze", ("prefix",)).add_argument("--base", default="cpu_t1")
    command("pack", ("folder",), ("out",), ("start", int), ("step", int), ("count", int))
    command("seeds", ("folder",), ("out",), ("n_seeds", int))
    command("ref", ("folder",), ("out",), ("start", int), ("step", int), ("reps", int, 5))
    a = top.parse_args(argv)
    spark = SparkSession.builder.appName("pointloom").getOrCreate()
    if a.command == "summary":
        pipeline.summary_of_scans(scan_contents(spark, a.folder, list_scans(spark, a.folder, a.max_scans)), P).write.parquet(a.out)
    elif a.command == "label":
        pipeline.label_points(read_scans(spark, a.folder, a.max_scans), P).write.partitionBy("scan_id").parquet(a.out)
    elif a.command == "bench":
        bench(spark, a.folder, a.prefix, a.reps, a.max_scans, a.modes)
    elif a.command == "analyze":
        analyze(spark, a.prefix, a.base)
    elif a.command == "pack":
        pack(spark, a.folder, a.out, a.start, a.step, a.count).show()
    elif a.command == "seeds":
        write_csv(pipeline.seed_sweep(unpack_points(read_frames(spark, a.folder), P), P, a.n_seeds), a.out)
    else:
        ref(spark, a.folder, a.out, a.start, a.step, a.reps)


if __name__ == "__main__":
    main()
