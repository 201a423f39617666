"""Incremental evaluation of model responses with Structured Streaming.

Responses land as files; every parser (T3-T15) is a stateless column
expression, so it runs unchanged on the stream. The running confusion counts
are a streaming aggregation (state kept in the checkpoint location, so a
restarted or failed query resumes exactly); metrics are derived from the
counts table. It has ``prompts x classes^2`` rows while answers parse; each distinct
answer that stays unparsed is one more class, and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.functions.labels import with_multi_stage_label

RESPONSE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("prompt_id", T.StringType()),
    T.StructField("correct", T.StringType()), T.StructField("response", T.StringType()),
])


def parsed_stream(spark: SparkSession, source_dir: str, schema: T.StructType = RESPONSE_SCHEMA,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    s = r.parquet(source_dir)
    return with_multi_stage_label(s.withColumn("__lr", F.lower(F.col("response"))), "__lr", "predicted").drop("__lr")


def running_confusion(parsed: DataFrame, keys: tuple[str, ...] = ("prompt_id",)) -> DataFrame:
    return parsed.groupBy(*keys, "correct", "predicted").agg(F.count(F.lit(1)).alias("n"))


def run_confusion(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                  max_files_per_trigger: int | None = None) -> str:
    """Process every file present now (``availableNow``), keep the running
    counts in streaming state and publish the full counts table of each
    micro-batch under its batch id (a repeated batch rewrites its own folder
    only, so readers of an older one are not disturbed). Returns the newest
    table's path."""
    counts = running_confusion(parsed_stream(spark, source_dir, max_files_per_trigger=max_files_per_trigger))

    newest = ""

    def publish(batch: DataFrame, batch_id: int) -> None:
        nonlocal newest
        path = f"{sink_dir.rstrip('/')}/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        newest = path

    q = (counts.writeStream.outputMode("complete").foreachBatch(publish)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()
    return newest
