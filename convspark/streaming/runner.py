"""Run a streaming plan over the driver tables to completion (``availableNow``).

Sources are file streams over the parquet tables; sinks are parquet folders
(exactly-once with a checkpoint) under the shared checkpoint dir, or
``foreachBatch`` for complete-mode aggregates.
"""

import logging
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_path, cut_lineage
from .fold import Fold


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = 1) -> DataFrame:
    """File-source stream over ``{sf_dir}/{name}.parquet``, a file or a directory of part files (schema
    from the footers).  The one-letter glob makes the source take either.  Without ``max_files`` all files there
    are one micro-batch."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{path[:-1]}[t]")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this module has written."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def make_folder(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def drain(writer, name: str = "stream") -> int:
    """Run a writer over all files that its source holds, with ``trigger(availableNow=True)``.

    Returns how many rows a watermark has left out (over the batches whose progress Spark keeps), and
    reports them as a warning."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    late = sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    if late:
        logging.getLogger(__name__).warning("%s: %d rows later than the watermark were left out", name, late)
    return late


def fold_writers(f: Fold, out: str, checkpoint: str) -> list:
    """One writer per level of a fold: the leaves' rows go to ``<out>/0``, and each level reads what the one below has
    committed.  Start them together for a live fold, or drain them in turn; ``f.answers`` reads the last."""
    spark = f.leaves.sparkSession
    writers, rows = [], f.leaves
    for n, level in enumerate([None, *f.levels]):
        if level is not None:
            rows = level(spark.readStream.schema(f.leaves.schema).parquet(f"{out}/{n - 1}"))
        writers.append(rows.writeStream.outputMode("append").format("parquet").option("path", f"{out}/{n}")
                       .option("checkpointLocation", f"{checkpoint}/{n}"))
        make_folder(spark, f"{out}/{n}")  # the level above may be planned before the first file is there
    return writers


def run_to_table(df: DataFrame | Fold, name: str, mode: str = "append") -> DataFrame:
    """Drain ``df`` into a fresh parquet folder; read it back.

    The rows are checkpointed and the run's folder (output and stream state) is removed."""
    spark = (df.leaves if isinstance(df, Fold) else df).sparkSession
    run = checkpoint_path(spark, "streams", f"{name}-{uuid.uuid4().hex[:12]}")
    out, chk = f"{run}/out", f"{run}/chk"
    if isinstance(df, Fold):
        for writer in fold_writers(df, out, chk):
            drain(writer, name)
        result = cut_lineage(df.answers(spark.read.schema(df.leaves.schema).parquet(f"{out}/{len(df.levels)}")))
        remove_folder(spark, run)
        return result
    if mode == "complete":
        def write(batch: DataFrame, epoch: int):
            batch.write.mode("overwrite").parquet(out)
        writer = df.writeStream.outputMode("complete").foreachBatch(write)
    else:
        writer = df.writeStream.outputMode(mode).format("parquet").option("path", out)
    drain(writer.option("checkpointLocation", chk), name)
    result = cut_lineage(spark.read.schema(df.schema).parquet(out))
    remove_folder(spark, run)
    return result


@contextmanager
def session_time_zone(spark: SparkSession, tz: str = "UTC"):
    """Build and run a stream under a fixed session time zone, then restore it.

    Time-zone-dependent expressions (NTZ <-> TIMESTAMP casts, window alignment)
    capture the zone when the DataFrame is analysed, so everything built inside
    the block keeps ``tz`` even after the block ends."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", tz)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
