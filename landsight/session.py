"""Session helpers: a tuned SparkSession for local runs, and the shared folder
used to cut lineage (``spark.checkpoint.dir``)."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings this library relies on or benefits from.  They are applied only by
# ``get_session``; a session handed in by a cluster keeps its own settings.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # The JVM never compiles a method of more than 8,000 bytes; Spark's generated
    # code beyond that ran 4 to 5 times slower here than its smaller methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def get_session(
    master: str | None = None,
    app_name: str = "landsight",
    shuffle_partitions: int | None = None,
    extra_conf: dict | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    ``shuffle_partitions`` defaults to the number of local cores for ``local[N]``
    masters; on a cluster leave it to the cluster configuration and AQE.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is None and master and master.startswith("local"):
        inner = master[master.find("[") + 1 : master.find("]")] if "[" in master else "1"
        shuffle_partitions = os.cpu_count() if inner == "*" else int(inner)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` (set by the cluster).  Only when it is
    unset on a ``local`` master -- local runs and tests -- a private folder is
    created and registered; on a cluster an unset folder is an error, since a
    driver-local folder is not shared with the executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 -- Spark Connect sessions have no SparkContext
        sc = None
    if not configured and sc is not None:
        configured = sc.getCheckpointDir()
    if not configured:
        master = spark.conf.get("spark.master", "") or ""
        if not master.startswith("local"):
            # a folder on the driver's disk is not visible to executors
            raise RuntimeError("spark.checkpoint.dir is not set; point it at a folder every executor shares")
        configured = tempfile.mkdtemp(prefix="landsight-ckpt-")
        if sc is None:
            spark.conf.set("spark.checkpoint.dir", configured)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


# Tasks of calls (models, fetches) for each task slot: a task then holds a small
# share of a long list, and a lost one costs little.
CALL_TASKS_PER_SLOT = 4


def call_tasks(spark: SparkSession) -> int:
    """Over how many tasks calls are spread; as many run at once as there are slots."""
    slots = default_parallelism(spark) or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return CALL_TASKS_PER_SLOT * slots


def default_parallelism(spark: SparkSession) -> int | None:
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 -- Connect sessions have no SparkContext
        return None
