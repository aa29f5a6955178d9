"""Structured Streaming versions of the incremental operators.

* ``append_stream`` (X1 / U7): new files are cleaned batch by batch and appended;
  each micro-batch writes its own ``batch_id=`` partition with dynamic
  partition overwrite, so a retried batch replaces itself (idempotent sink).
* ``upsert_stream`` (X2 / U4): each micro-batch keeps the last row per key
  (``max_by``) and rewrites the hash buckets its keys fall in (``keyed_table``).
* ``kpi_windows`` (X3 / C10+C13): watermark + event-time window aggregates.

Checkpoints live under the session's ``spark.checkpoint.dir`` (a shared
folder on a cluster), so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from briskbi.operators import profile_state
from briskbi.session import ensure_checkpoint_dir
from briskbi.streaming import keyed_table


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/briskbi-{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """Streaming file source with a declared schema (no inference on a stream)."""
    r = spark.readStream.format(fmt).schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def kpi_windows(stream: DataFrame, ts: str, value: str, keys: list[str], window: str = "1 day",
                watermark: str = "1 day", scale: int | None = None) -> DataFrame:
    """Per (window, keys) row count and value sum, late data bounded by the watermark."""
    v = F.col(value).cast(f"decimal(38,{scale})") if scale is not None else F.col(value)
    ntz = isinstance(stream.schema[ts].dataType, T.TimestampNTZType)
    # Watermarks need TIMESTAMP: wall-clock (NTZ) event times become the UTC instant
    # of the same wall time, so windows align with wall-clock days in any session zone.
    et = "_event_time"
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    event = F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col(ts))) if ntz else F.col(ts)
    agg = (stream.withColumn(et, event).withWatermark(et, watermark)
           .groupBy(F.window(F.col(et), window).alias("w"), *keys)
           .agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total")))
    total = F.col("total").cast("double") if scale is not None else F.col("total")
    start, end = F.col("w.start"), F.col("w.end")
    if ntz:
        start = F.timestamp_add("MICROSECOND", F.unix_micros(start), epoch)
        end = F.timestamp_add("MICROSECOND", F.unix_micros(end), epoch)
    return agg.select(start.alias("window_start"), end.alias("window_end"), *keys, "n", total.alias("total"))


def run_available_now(df: DataFrame, sink: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Process everything available, then stop (batch-like, restartable)."""
    q = (df.writeStream.format(fmt).outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def append_stream(stream: DataFrame, target: str, checkpoint: str,
                  transform: Callable[[DataFrame], DataFrame] | None = None, profile: str | None = None) -> None:
    """Clean each new batch and append it (no dedup), idempotently per batch.

    With ``profile``, a folder, the profile of all rows is kept up to date there (``profile_state``), and a batch
    whose columns or types differ from the first one's fails before it is appended.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        known = profile_state.known_columns(batch.sparkSession, profile) if profile else None
        if known:
            profile_state.check_schema(out, known)
        (out.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(target))
        if profile:
            profile_state.update(out, profile, batch_id)

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def upsert_stream(stream: DataFrame, target: str, checkpoint: str, key: list[str], order: list[str], buckets: int = 64) -> None:
    """Last row per key wins across batches; a batch rewrites only the buckets of its keys.

    A batch that is tried again starts from the state before it, so it never merges with itself.
    ``keyed_table.read`` gives the current rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        keyed_table.upsert(batch, target, key, order, batch_id, buckets)

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def run_updates(df: DataFrame, target: str, checkpoint: str) -> None:
    """Update-mode aggregate → changelog: each batch's changed rows in ``batch_id=``.

    Windows are emitted as soon as they change (also those the watermark has
    not closed yet); a retried batch overwrites its own partition.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(target))

    q = (df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_latest(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """Current state of an update-mode changelog: newest row per key."""
    log = spark.read.parquet(target)
    rest = [c for c in log.columns if c not in keys and c != "batch_id"]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch_id")).alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
