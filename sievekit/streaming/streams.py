"""Streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage


def ingest_stream(spark: SparkSession, landing: str, schema: T.StructType, sink: str, checkpoint: str,
                  files_per_trigger: int = 1) -> DataFrame:
    """Accumulate landed files into an append-only table, one micro-batch
    per file (the reference rewrote its output after each fetched item)."""
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
           .parquet(landing))
    q = (src.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(schema).parquet(sink)


def running_metric_stream(spark: SparkSession, stream: DataFrame, group: str, correct: F.Column,
                          sink: str, checkpoint: str) -> DataFrame:
    """R2 + U6: running (correct, total) per group — summable state kept by the
    streaming aggregation, the ratio computed only at read time.  Each
    micro-batch's complete result replaces the sink table (foreachBatch)."""
    agg = stream.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(correct.cast("long")).alias("n_correct"))

    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(sink)

    q = (agg.writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    res = spark.read.parquet(sink)
    return res.withColumn("accuracy", F.coalesce(F.try_divide(F.col("n_correct").cast("double"), F.col("n")),
                                                 F.lit(0.0)))


def decontaminate_stream(spark: SparkSession, stream: DataFrame, held_keys: DataFrame, key: str,
                         sink: str, checkpoint: str) -> DataFrame:
    """Arriving rows minus a fixed held-out key set (stream–static anti join).

    The distinct keys are written once, so a batch reads keys and never the held-out texts.  The merge hint
    keeps them from the driver: a broadcast would collect them there again in every batch."""
    kept = stream.join(cut_lineage(held_keys.select(key).distinct()).hint("merge"), key, "left_anti")
    q = (kept.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink)
