"""Structured Streaming ingest (S1, A9, section 2.11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DELTA = "instance_id string, run_id string, probe string, payload_sequence long, hits_total long"


def delta_stream(spark: SparkSession, path: str, schema: str = DELTA, files: int = 100) -> DataFrame:
    """Decoded deltas that land as Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def total_state(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """The highest total of each counter and run. max is idempotent, so late and repeated rows are harmless and no watermark is needed."""
    return deltas.groupBy("instance_id", "run_id", *keys).agg(F.max("hits_total").alias("hits"), F.max("payload_sequence").alias("payload_sequence"))


def chunk_state(chunks: DataFrame) -> DataFrame:
    """Scans with the number of their chunks that have arrived; complete once all have."""
    valid = chunks.where("scanned_at > 0 and chunk_count >= 1 and chunk_index >= 0 and chunk_index < chunk_count")
    got = valid.groupBy("instance_id", "scanned_at").agg(F.size(F.collect_set("chunk_index")).alias("chunks"), F.max("chunk_count").alias("chunk_count"))
    return got.withColumn("complete", F.col("chunks") == F.col("chunk_count"))


def to_memory(df: DataFrame, name: str) -> StreamingQuery:
    """A complete-mode query into an in-memory table, for tests and small dimensions."""
    return df.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()


def upsert(df: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Each batch's changed rows go to a folder of their own, once: a batch that is run again overwrites the same folder.
    ``latest`` reads the newest row of each key."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in values])


def settled(table: DataFrame, predicate: str) -> bool:
    """Q29: whether a streaming table meets a predicate; callers poll it."""
    return not table.where(predicate).isEmpty()
