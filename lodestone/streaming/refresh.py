"""Streaming variants: files that arrive are indexed in micro-batches; session lines are sealed as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions import text as T
from lodestone.operators import sessions

DOCUMENT = "locator string, text string, version bigint"
#: Folders of a history by the hash of the session: a batch reads those of its own sessions only.
BUCKETS = 64


def refresh_units(spark: SparkSession, incoming: str, store: str, checkpoint: str) -> StreamingQuery:
    """Takes JSON files of documents (locator, text, version if there is one) into the unit table ``store``, then stops.

    Each micro-batch replaces the units of the locators it brings; a batch that is run again writes the same rows.  Of
    several texts of one locator in a batch the highest version counts, then the newest file.
    """

    def absorb(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("locator").agg(F.max_by("text", F.struct(F.coalesce("version", F.lit(0)), "arrived", "file", "text")).alias("text"))
        new = last.select("locator", F.posexplode(F.split("text", "\n\n", -1)).alias("ordinal", "evidence_text"))
        new = new.select("locator", F.col("ordinal").cast("long").alias("ordinal"), "evidence_text", T.estimate_tokens(F.col("evidence_text")).alias("token_count"), T.content_hash(F.col("evidence_text")).alias("content_hash"), F.lit(number).cast("long").alias("batch"))
        new.write.mode("overwrite").parquet(f"{store}/batch={number}")

    stream = spark.readStream.schema(DOCUMENT).json(incoming).select("*", F.col("_metadata.file_modification_time").alias("arrived"), F.col("_metadata.file_path").alias("file"))
    return stream.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_units(spark: SparkSession, store: str) -> DataFrame:
    """The newest units of each locator."""
    rows = spark.read.parquet(store)
    newest = rows.groupBy("locator").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["locator", "batch"], "left_semi")


def sealed_turns(spark: SparkSession, incoming: str, checkpoint: str, sink: Callable[[DataFrame], None], history: str) -> StreamingQuery:
    """Appends session lines (session, line_no, type, text) to ``history`` and hands on the sealed prefixes of the sessions that a batch brings; lines past a seal wait."""

    def absorb(batch: DataFrame, number: int) -> None:
        placed = batch.withColumn("bucket", F.pmod(F.xxhash64("session"), F.lit(BUCKETS)).cast("int"))
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{history}/batch={number}")
        touched = [r.bucket for r in placed.select("bucket").distinct().collect()]
        every = spark.read.parquet(history).filter(F.col("bucket").isin(touched)).join(batch.select("session").distinct(), "session", "left_semi")
        every = every.select("session", "line_no", "type", "text").dropDuplicates(["session", "line_no"])
        sink(sessions.sealed(every, F.col("type") == "compaction"))

    stream = spark.readStream.schema("session string, line_no bigint, type string, text string").json(incoming)
    return stream.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


