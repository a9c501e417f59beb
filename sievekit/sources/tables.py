"""Driver tables: one parquet file per table under ``sf_dir``.

Reading with ``spark.read.parquet`` keeps column pruning and predicate
pushdown: every plan selects only the columns it needs, and the scan's
``ReadSchema`` / ``PushedFilters`` show it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
