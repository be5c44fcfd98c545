"""Session and lineage helpers."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults that matter for every job in this package.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # correctness guard: with AQE, a union of two branches of one hash-partitioned
    # input was reported as partitioned like its children and a later join skipped
    # its shuffle (duplicate matches).  See README.
    "spark.sql.unionOutputPartitioning": "false",
}


def apply_guards(spark: SparkSession) -> None:
    """Runtime settings this package relies on: correct plans, and joins on hot keys split
    at run time."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


def get_session(master: str | None = None, app: str = "tessera",
                shuffle_partitions: int | None = None, conf: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (conf or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    apply_guards(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; pick one only when it is unset and the
    master is ``local`` (driver and tasks are then one process).  A cluster without the
    setting is refused: no other folder is known to be shared.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:
            configured = None
    if not configured:
        if sc.master.startswith("local"):
            configured = tempfile.mkdtemp(prefix="tessera-ckpt-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written in the shared checkpoint folder.

    A parquet round trip rather than ``Dataset.checkpoint``: a checkpointed plan keeps
    the output partitioning its producer claimed, and after adaptive coalescing that
    claim need not describe the stored partitions, so a later join on a prefix of
    the same keys could skip a required shuffle.  Reading the files back claims
    nothing, and they survive executor loss like a checkpoint does.
    """
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), "tessera-tables", uuid.uuid4().hex)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


FEW_ROWS = 100_000


def broadcast_few(table: DataFrame, key: str) -> DataFrame:
    """``table`` (one row per ``key``), marked for broadcast when it has few rows.  Counting it
    first keeps the other side of a join where it is: shuffled by a key of few values, all rows
    of a value would be read by one task."""
    few = table.select(key).limit(FEW_ROWS + 1).count() <= FEW_ROWS
    return table.hint("broadcast") if few else table


def spread_width(spark: SparkSession) -> int:
    """Partitions for an explicit spread: the session's shuffle width, which the user
    sizes to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store, whatever file system that is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
