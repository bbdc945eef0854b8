"""Structured Streaming: pages as they arrive, and windowed event counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.rules import lid_gate
from weftline.session import shared_dir
from weftline.sources.readers import PAGE


def ingest_pages(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = PAGE) -> StreamingQuery:
    """Append the pages of new JSON files that pass the language gate to a table by language; restarts go on where they ended."""
    pages = spark.readStream.schema(schema).option("lineSep", "\n").json(source)
    kept = pages.where(lid_gate(F.col("lang"), F.col("lid_prob")))
    return kept.writeStream.format("parquet").partitionBy("lang").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, key: str = "event_type", ts: str = "ts", id_col: str = "event_id", length: str = "1 hour", late: str = "30 days") -> DataFrame:
    """Counts and sums of distinct events by tumbling window; an event that comes twice within ``late`` counts once."""
    once = events.withWatermark(ts, late).dropDuplicatesWithinWatermark([id_col])
    return once.groupBy(key, F.window(ts, length).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def run_windowed_counts(spark: SparkSession, folder: str, pattern: str, schema: str) -> DataFrame:
    """All files of a folder that match, as a stream run to its end; the last complete result is written and read back."""
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = windowed_counts(events).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")
    save = lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/result")
    query = counts.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/result")
