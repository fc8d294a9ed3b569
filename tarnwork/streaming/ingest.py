"""Streaming forms (an extension): idempotent manifest ingestion, event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnwork.operators.manifest import merge_keep_first


def ingest(stream: DataFrame, store: str, checkpoint: str, id_col: str, identity_col: str, order: list[str]) -> StreamingQuery:
    """Append to the parquet table ``store`` what it does not hold yet; replayed batches change nothing."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        try:
            prior = spark.read.schema(batch.schema).parquet(store)
        except Exception as e:  # the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            prior = spark.createDataFrame([], batch.schema)
        merged = merge_keep_first(prior.withColumn("_old", F.lit(True)), batch.withColumn("_old", F.lit(False)), id_col, identity_col, order)
        merged.where("NOT _old").drop("_old").write.mode("append").parquet(store)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_counts(events: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and their value by window and type; works on streams and tables."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    out = source.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
