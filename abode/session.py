"""Session helpers: a local session for tests/bench and the shared scratch
folder (taken from ``spark.checkpoint.dir``) for written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8,
                  app: str = "abode", extra: dict | None = None) -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
        # one BLAS thread per Python worker: Spark already runs one task per core
        "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
        "spark.executorEnv.OMP_NUM_THREADS": "1",
    }
    conf.update(extra or {})
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_conf(executors: int, cores_per_executor: int) -> dict[str, str]:
    """Settings this library is planned against on a real cluster (apply them
    when building the session; ``spark.checkpoint.dir`` comes from the cluster).

    Partition sizes keep a task's input and shuffle blocks near 256 MB; AQE
    coalesces small shuffles and splits skewed join partitions (a hot request
    key); the broadcast threshold equals the byte budget the operators check
    before broadcasting; the external shuffle service and decommissioning keep
    shuffle output when an executor is lost, so stages resume, not restart."""
    slots = max(1, executors * cores_per_executor)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
        "spark.sql.shuffle.partitions": str(slots * 3),
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.autoBroadcastJoinThreshold": "64m",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.worker.reuse": "true",
        "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
        "spark.executorEnv.OMP_NUM_THREADS": "1",
        "spark.shuffle.service.enabled": "true",
        "spark.decommission.enabled": "true",
        "spark.storage.decommission.enabled": "true",
        "spark.storage.decommission.shuffleBlocks.enabled": "true",
        "spark.task.maxFailures": "8",
        "spark.ui.enabled": "false",
    }


def shared_dir(spark: SparkSession) -> str:
    """Cluster-shared folder for written tables and checkpoints.

    Reads ``spark.checkpoint.dir`` from the session (the cluster's shared
    location).  Only when it is unset on a local master — tests — a fresh
    folder under the system temp dir is created and registered as the
    checkpoint dir; on a cluster it must be set.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset
            d = None
    if not d:
        d = sc.getCheckpointDir()
    if not d and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(d)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared folder (never reused, never cleared)."""
    return f"{shared_dir(spark)}/abode/{name}-{uuid.uuid4().hex[:12]}"
