"""Frame loop: each micro-batch takes one new scan file and appends its summary.

The pipeline keeps no state between scans.  Each batch writes its rows
into a folder named by the batch id, so a batch that is run again after a
failure replaces itself; the checkpoint decides which files are still to do.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..params import PipelineParams
from ..plans.pipeline import summary_of_scans

FILES = "path string, modificationTime timestamp, length long, content binary"


def frame_stream(spark: SparkSession, folder: str, per_batch: int = 1) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "?*.bin").option("maxFilesPerTrigger", per_batch).load(folder)


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, p: PipelineParams | None = None, per_batch: int = 1) -> StreamingQuery:
    """Start the loop; ends when the files now present are done.  The number in a file's name is its scan_id."""
    p = p or PipelineParams()

    def batch(df: DataFrame, batch_id: int) -> None:
        began = time.perf_counter()
        scans = df.select(F.regexp_extract("path", r"([0-9]+)\.bin$", 1).cast("long").alias("scan_id"), "content")
        rows = summary_of_scans(scans, p).drop("n_points")
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        took = spark.createDataFrame([((time.perf_counter() - began) * 1000,)], "total double")
        took.write.mode("overwrite").parquet(f"{out}_ms/batch={batch_id}")

    return frame_stream(spark, folder, per_batch).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
