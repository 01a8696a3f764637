"""Session helpers: building a local session for tests/benchmarks and
resolving the shared checkpoint directory used to cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Conf key for the halo/scan block size (rows of one series per block).
BLOCK_CONF = "chronoframe.block.size"
DEFAULT_BLOCK = 1 << 16


def get_spark(master: str | None = None, app: str = "chronoframe",
              shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """Session for tests and the benchmark. On a cluster the caller's session is used instead."""
    b = (
        SparkSession.builder.master(master or "local[*]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CHRONOFRAME_DRIVER_MEMORY", "8g"))
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory named by the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that is used
    as is. Only a local master without one gets a scratch folder; on a cluster
    the executors would not share it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="chronoframe-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def block_size(spark: SparkSession, size: int | None = None) -> int:
    if size is not None:
        return int(size)
    v = spark.conf.get(BLOCK_CONF, None)
    return int(v) if v else DEFAULT_BLOCK


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def configure_for_input(spark: SparkSession, input_bytes: int, partition_bytes: int = 256 << 20,
                        min_partitions: int = 200) -> dict:
    """Size shuffles and scans for an input of ``input_bytes``.

    Shuffle partitions are chosen so that a partition holds about
    ``partition_bytes`` (AQE then coalesces small ones and splits skewed ones),
    Parquet splits are of the same size, and the broadcast threshold stays at a
    fixed bound so no data-sized side is ever broadcast.  Returns the settings
    applied; keys already set by the cluster administrator are left alone."""
    n = max(min_partitions, -(-int(input_bytes) // partition_bytes))
    wanted = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }
    applied = {}
    for k, v in wanted.items():
        if k == "spark.sql.shuffle.partitions" or spark.conf.get(k, None) in (None, ""):
            spark.conf.set(k, v)
            applied[k] = v
    return applied


_SHIPPED: dict[str, str] = {}


def ship_package(spark: SparkSession) -> str | None:
    """Make the package importable in the executors' Python workers: zip it
    on the driver and ``addPyFile`` it (Spark distributes the file), once per
    application.  Returns the zip's path, or None if it was shipped before."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return None
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    # read by the driver's own file server, which hands it to the executors
    target = os.path.join(tempfile.mkdtemp(prefix="chronoframe-"), "chronoframe.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(target)
    _SHIPPED[app] = target
    return target
