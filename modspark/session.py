"""Session construction and the shared checkpoint folder.

On a cluster the operator of the cluster names a shared folder in
``spark.checkpoint.dir``; we only read it.  A folder of our own is set only
when the setting is absent (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Rows go to Python by the ten thousand: with texts that is tens of MB a batch,
# held by the JVM and by every Python worker of a chain.  The corpus pipeline
# bounds the bytes (below ``llm.common.BATCH_BYTES``, so that no batch is cut
# in two); a longer row is a batch of its own.
BATCH_SETTING, BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch", str(3 << 19)

# Fixed session settings the numeric and time contracts depend on.
_BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "modspark",
    extra: dict | None = None,
) -> SparkSession:
    """Return a session with the UTC / AQE settings the operators expect."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in _BASE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_session_settings(spark)
    return spark


def ensure_session_settings(spark: SparkSession) -> None:
    """Pin the settings results depend on (time zone) on an existing session;
    a bound that :func:`bound_batches` set earlier is lifted."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get(BATCH_SETTING, None) == BATCH_LIMIT:
        spark.conf.unset(BATCH_SETTING)
    checkpoint_dir(spark)


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, unless the user has set a bound."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_LIMIT)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: ``spark.checkpoint.dir`` when the
    cluster names one, otherwise a fresh scratch folder, on local masters
    only: on a cluster other executors could not read it."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="modspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)
