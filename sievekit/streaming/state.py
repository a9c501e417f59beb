"""Metrics whose state two sums cannot hold, kept per group by arbitrary stateful processing.

A metric has the reference's four steps: ``init`` an empty state, ``update`` it with rows, ``reduce``
two states to one, and ``compute`` the value.  Here the state is a map from a key to counts, such as
the histogram of scores from which the area under the ROC curve follows.

The stream keeps one state per (group, salt) with ``transformWithStateInPandas``; rows of one group are
salted by their id, so a group with a third of all rows is updated by ``SALTS`` tasks.  A batch writes the
map entries that it changed, with their counts so far, under its own number, so a repeated
batch replaces its files.  Reading takes every entry's latest counts, reduces over the salts and computes.
State and offsets live in the checkpoint folder, and a restart goes on from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SALTS = 8
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENTRIES = "grp string, salt int, bin long, pos long, neg long"


class HistogramState(StatefulProcessor):
    """Counts of positive and negative rows per score bin, one map state per (group, salt)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bins = handle.getMapState("bins", "bin bigint", "pos bigint, neg bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch: dict[int, list[int]] = {}
        for pdf in rows:
            for b, p, n in pdf.groupby("bin")["positive"].agg(["sum", "count"]).itertuples():
                held = batch.setdefault(int(b), [0, 0])
                held[0] += int(p)
                held[1] += int(n) - int(p)
        out = []
        for b, (pos, neg) in batch.items():
            if self.bins.containsKey((b,)):
                before = self.bins.getValue((b,))
                pos, neg = pos + before[0], neg + before[1]
            self.bins.updateValue((b,), (pos, neg))
            out.append((key[0], int(key[1]), b, pos, neg))
        yield pd.DataFrame(out, columns=["grp", "salt", "bin", "pos", "neg"])

    def close(self) -> None:
        pass


def histogram_stream(spark: SparkSession, stream: DataFrame, group: Column, row_id: Column, score_bin: Column,
                     positive: Column, sink: str, checkpoint: str) -> None:
    """Run over all that the stream has; call again with the same folders to go on."""
    salt = F.pmod(F.xxhash64(row_id), F.lit(SALTS)).cast("int")
    rows = stream.select(group.cast("string").alias("grp"), salt.alias("salt"), score_bin.cast("long").alias("bin"),
                         positive.cast("long").alias("positive")).filter("bin is not null and positive is not null")
    state = rows.groupBy("grp", "salt").transformWithStateInPandas(HistogramState(), ENTRIES, "Update", "None")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        q = (state.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def reduced(spark: SparkSession, sink: str) -> DataFrame:
    """(grp, bin, pos, neg): every entry's latest counts, salts reduced."""
    held = spark.read.schema(ENTRIES + ", epoch long").parquet(sink)
    latest = held.groupBy("grp", "salt", "bin").agg(F.max_by(F.struct("pos", "neg"), "epoch").alias("s"))
    return latest.groupBy("grp", "bin").agg(F.sum("s.pos").alias("pos"), F.sum("s.neg").alias("neg"))


def area_under_roc(histogram: DataFrame) -> DataFrame:
    """(grp, n, auc) from (grp, bin, pos, neg); ties inside a bin count one half, one class alone gives null."""
    below = Window.partitionBy("grp").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    won = histogram.select("*", (F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") / 2)).alias("won"))
    return won.groupBy("grp").agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.try_divide(
        F.sum("won"), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))
