"""Spark session and checkpoint-directory helpers.

The library never creates machine-local scratch space on a cluster: lineage is cut with
``DataFrame.checkpoint()`` into the shared folder the cluster names in ``spark.checkpoint.dir``.
Only a local-mode session without that setting (unit tests, laptops) gets a private folder under
the system temp directory.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_DIRS: dict[int, str] = {}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "toposcope",
                  extra: dict[str, str] | None = None, checkpoint_dir: str | None = None) -> SparkSession:
    """Session with the settings the library is tuned for (AQE on, UI off). ``checkpoint_dir`` names the
    folder for checkpoints and written intermediate tables; on a cluster it must be shared (there it
    usually comes from the cluster's own ``spark.checkpoint.dir``). Checkpoint files are removed with
    the tables they belong to."""
    builder = (
        SparkSession.builder.master(master)
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
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, configuring it from the session if needed.

    Order: an already-set SparkContext checkpoint dir, then ``spark.checkpoint.dir`` from the
    session conf, then (local master only) a fresh private temp folder. A cluster session with
    neither setting is an error, because a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster session")
    key = id(sc)
    if key not in _LOCAL_DIRS:
        _LOCAL_DIRS[key] = tempfile.mkdtemp(prefix="toposcope-ckpt-")
    sc.setCheckpointDir(_LOCAL_DIRS[key])
    return _LOCAL_DIRS[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint directory for written intermediate tables."""
    import uuid

    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")
