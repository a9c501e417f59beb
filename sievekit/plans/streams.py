"""Streaming queries: the driver tables are landed as several files in a
fresh folder under the shared checkpoint directory and consumed as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import text_key
from ..session import scratch_path
from ..sources import table
from ..streaming import decontaminate_stream, ingest_stream, running_metric_stream, state
from .registry import query


def land(df, name, spark, by):
    """Write ``df`` to a landing folder, range-partitioned on ``by`` over the shuffle partitions."""
    path = scratch_path(spark, name)
    df.repartitionByRange(by).write.parquet(path)
    return path


@query("stream_ingest", oracle="SELECT event_id, user_id, event_type, value FROM events")
def stream_ingest(spark, sf_dir):
    """Events landed as 4 files, ingested one file per micro-batch."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    landing = land(ev, "landing-events", spark, "event_id")
    out = ingest_stream(spark, landing, ev.schema, scratch_path(spark, "sink-events"),
                        scratch_path(spark, "ckpt-events"))
    return out


@query("stream_metric", oracle="""
SELECT event_type, count(*) AS n, CAST(sum(((event_type = 'click') = (value >= 10))::BIGINT) AS BIGINT) AS n_correct,
       round(sum(((event_type = 'click') = (value >= 10))::BIGINT) / count(*), 6) AS accuracy
FROM events GROUP BY event_type
""")
def stream_metric(spark, sf_dir):
    """R2 + U6: running accuracy of the rule 'value ≥ 10 ⇒ click' per event type."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    landing = land(ev, "landing-metric", spark, "event_id")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    correct = (F.col("event_type") == "click") == (F.col("value") >= 10)
    return running_metric_stream(spark, stream, "event_type", correct, scratch_path(spark, "sink-metric"),
                                 scratch_path(spark, "ckpt-metric"))


@query("stream_decontaminate", oracle="""
WITH k AS (SELECT doc_id, md5(trim(lower(text))) AS key FROM documents)
SELECT a.doc_id, a.key FROM k a
WHERE a.doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM k b WHERE b.doc_id % 2 = 0 AND b.key = a.key)
""")
def stream_decontaminate(spark, sf_dir):
    """Odd-half documents arrive as a stream and are decontaminated against
    the static even-half key set."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_key("text").alias("key"))
    landing = land(docs.filter(F.col("doc_id") % 2 == 1), "landing-docs", spark, "doc_id")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    held = docs.filter(F.col("doc_id") % 2 == 0)
    return decontaminate_stream(spark, stream, held, "key", scratch_path(spark, "sink-docs"),
                                scratch_path(spark, "ckpt-docs"))


@query("stream_auc", oracle="""
WITH h AS (SELECT CAST(user_id % 10 AS VARCHAR) AS segment, CAST(floor(value) AS BIGINT) AS bin,
                  sum((event_type = 'click')::BIGINT) AS pos, sum((event_type <> 'click')::BIGINT) AS neg
           FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL),
w AS (SELECT *, pos * (coalesce(sum(neg) OVER (PARTITION BY segment ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING
                       AND 1 PRECEDING), 0) + neg / 2) AS won FROM h)
SELECT segment, CAST(sum(pos + neg) AS BIGINT) AS n, round(sum(won) / nullif(sum(pos)::DOUBLE * sum(neg), 0), 6) AS auc
FROM w GROUP BY segment
""")
def stream_auc(spark, sf_dir):
    """R2 + U6: per user segment the area under the ROC curve of ``value`` for clicks, from a histogram that
    arbitrary stateful processing keeps over the stream of landed files."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    landing = land(ev, "landing-auc", spark, "event_id")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 4).parquet(landing)
    sink = scratch_path(spark, "sink-auc")
    state.histogram_stream(spark, stream, F.col("user_id") % 10, F.col("event_id"), F.floor("value"),
                           F.col("event_type") == "click", sink, scratch_path(spark, "ckpt-auc"))
    return state.area_under_roc(state.reduced(spark, sink)).select(F.col("grp").alias("segment"), "n", "auc")


@query("record_stream", oracle="""
SELECT 'P' || p_partkey AS unique_id, p_type || '|' || p_brand AS types, p_name || ' ' || p_name AS common_name,
       p_size AS size FROM part
""")
def record_stream(spark, sf_dir):
    """S3 + R1: parts written as ``//``-ended records with a wrapped value, read as a stream by the records data
    source into an append-only table."""
    from ..functions.text import first_value
    from ..sources.records import RecordSource
    pa = table(spark, sf_dir, "part")
    s = lambda c: F.col(c).cast("string")
    rec = F.concat_ws("\n", F.concat(F.lit("UNIQUE-ID - P"), s("p_partkey")), F.concat(F.lit("TYPES - "), "p_type"),
                      F.concat(F.lit("TYPES - "), "p_brand"), F.lit("# a comment"), F.concat(F.lit("COMMON-NAME - "), "p_name"),
                      F.concat(F.lit("/"), "p_name"), F.concat(F.lit("SIZE - "), s("p_size")), F.lit("//"))
    landing = scratch_path(spark, "landing-records")
    pa.select(rec.alias("value")).repartitionByRange("value").write.text(landing)
    spark.dataSource.register(RecordSource)
    sink = scratch_path(spark, "sink-records")
    q = (spark.readStream.format("sievekit_records").load(landing).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", scratch_path(spark, "ckpt-records")).trigger(availableNow=True).start())
    q.awaitTermination()
    a = F.col("attrs")
    return spark.read.parquet(sink).select(
        first_value(a, "UNIQUE-ID").alias("unique_id"), F.array_join(F.element_at(a, "TYPES"), "|").alias("types"),
        first_value(a, "COMMON-NAME").alias("common_name"), first_value(a, "SIZE").cast("int").alias("size"))
