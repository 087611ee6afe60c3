"""Streams: windowed counts with a watermark, sessions, and idempotent upserts of micro-batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery.sources.tables import append_table, load_table, upsert_table


def windowed(events: DataFrame, time_col: str, width: str, keys: Sequence[str] = (), slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """n and total per window and key; works on a stream (rows later than ``late`` are dropped there) and on a table."""
    source = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    source = source.withWatermark(time_col, late) if events.isStreaming else source
    grouped = source.groupBy(F.window(time_col, width, slide).alias("w"), *keys)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time_col: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """One row per session: a key's events without a pause of ``gap``."""
    source = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    source = source.withWatermark(time_col, late) if events.isStreaming else source
    return source.groupBy(F.session_window(time_col, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upsert_stream(stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str, order_col: str | None = None) -> StreamingQuery:
    """Upsert every micro-batch into a table by key; a batch that is replayed gives the same table.

    Inside a batch the last row of a key by ``order_col`` wins.
    """

    def put(batch: DataFrame, _: int) -> None:
        rows = batch
        if order_col:
            rows = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), order_col).alias("_r")).select(*keys, "_r.*")
        upsert_table(rows.select(*batch.columns), path, keys)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every micro-batch once: rows carry their batch, and a batch already in the table is skipped on replay."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marked = batch.withColumn("_batch", F.lit(number).cast("long"))
        done = load_table(spark, path, ["_batch"], missing_ok=True, schema=marked.schema)
        if done.where(F.col("_batch") == number).isEmpty():
            append_table(marked, path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
