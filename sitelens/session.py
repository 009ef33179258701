"""Session helpers: a tuned local session for tests/bench and shared-folder handling.

Library operators never create sessions; they take DataFrames.  Only tests,
``bench.py`` and scripts call :func:`get_session`.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter at 100 TB as much as on local[8]: AQE re-plans shuffles at
# runtime (coalescing small partitions, splitting skewed join partitions), and
# the broadcast threshold stays at a small, explicit value.  Only fixed tables are
# hinted; sides that come from data are left to the optimizer's measured sizes.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "sitelens", extra: dict | None = None) -> SparkSession:
    master = master or os.environ.get("SITELENS_MASTER", "local[8]")
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("SITELENS_DRIVER_MEMORY", "16g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster names it in ``spark.checkpoint.dir``; we only read it.  When it
    is unset, a private folder is made on a local master; on a cluster, where each
    machine would see a folder of its own, that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.sparkContext.getCheckpointDir()
        except Exception:  # pragma: no cover - connect sessions have no context
            d = None
    if not d and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="sitelens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(d)
    except Exception:  # pragma: no cover
        pass
    return d


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared checkpoint folder (for written tables)."""
    base = ensure_checkpoint_dir(spark)
    base = base.rstrip("/")
    return f"{base}/sitelens-{name}-{uuid.uuid4().hex[:12]}"
