"""Session construction and shared-storage helpers.

Cluster rule: lineage is cut with a table written into the shared folder named by
``spark.checkpoint.dir``.  We read that setting from the session; where it is
unset, a cluster session is refused and a local one (tests) gets a scratch folder.
``localCheckpoint`` is never used.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpointed RDDs carry preferred locations; do not idle waiting for them
    "spark.locality.wait": "0s",
}


def ship_package(spark: SparkSession) -> None:
    """Make ``sievekit`` importable on every Python worker (Arrow UDF kernels are
    pickled by module reference): zip the package once per SparkContext and
    register it with ``addPyFile``, which Spark distributes to executors."""
    sc = spark.sparkContext
    if getattr(sc, "_sievekit_shipped", False):
        return
    import shutil
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="sievekit-pkg-")
    archive = shutil.make_archive(os.path.join(out, "sievekit"), "zip",
                                  root_dir=os.path.dirname(pkg), base_dir=os.path.basename(pkg))
    sc.addPyFile(archive)
    sc._sievekit_shipped = True


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "sievekit", extra: dict | None = None) -> SparkSession:
    """Local/test session.  On a cluster the submitter's session is used as-is."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint dir, setting a scratch one only if unset."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="sievekit-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written intermediates."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written into the shared checkpoint folder.

    Survives executor loss like ``checkpoint()``, but the re-read table gets
    its statistics from the real file sizes.  ``Dataset.checkpoint`` keeps the
    original plan's size estimate, and in iterative joins that estimate is
    multiplied round after round until planning itself takes minutes."""
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

