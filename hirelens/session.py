"""Session helpers.

The library never creates its own cluster settings: it reads what the session
was started with.  ``local_session`` exists for tests, the bench and the
smoke entry; on a cluster the caller's session is used unchanged.
"""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "hirelens") -> SparkSession:
    """A local session for tests and benchmarks (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is.  Where it is unset, a session whose tasks all run in this
    process (``local[...]``: tests, bench) gets a fresh scratch folder; any
    other session is refused, as its executors could not read such a folder.
    """
    sc = spark.sparkContext
    current = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY, None)
    if current:
        sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="hirelens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set(CHECKPOINT_KEY, path)
    sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediates."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def stored(df: DataFrame, name: str = "kept") -> DataFrame:
    """``df`` written below the shared checkpoint folder and read back: lineage ends
    there and survives lost executors."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Shuffle files go when the driver finds their plan unused.  The garbage of
    finished plans is collected here, as the driver's heap may not fill up for hours;
    the second time takes what listeners still held at the first."""
    for pause in (0.5, 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def materialize(df: DataFrame, name: str = "materialized") -> DataFrame:
    """Reliable copy of a large frame (lineage cut, in the shared checkpoint folder
    of the session; never ``localCheckpoint``).  Columnar files take a small part of
    what checkpointed rows take, and what was shuffled for them is let go."""
    out = stored(df, name)
    let_go(df.sparkSession)
    return out
