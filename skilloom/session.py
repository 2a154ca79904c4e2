"""Session helpers: one place for the settings the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter on a cluster as much as on a laptop.  AQE re-plans joins
# from measured sizes (broadcast only when the real side is small) and splits
# skewed shuffle partitions, which is what keeps popular jobs from becoming one
# long task.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128MB",
    # The JVM never compiles a method of more than 8000 bytes; beyond that Spark splits a projection into methods that it does compile.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "skilloom", cores: str = "*", shuffle_partitions: int | None = None,
                  driver_memory: str | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """Local session for tests and benches; on a cluster pass your own session."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in RUNTIME_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    return b.getOrCreate()


class NoSharedFolder(ValueError):
    """The session names no folder that driver and executors share."""


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a
    session with one machine (``local[n]``, as in tests) gets a fresh folder of
    its own, and a session on a cluster an error: a machine-local folder there
    would lose rows.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[app]


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/skilloom-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Used where one expensive result feeds several branches: it is computed
    once (when the query is built), survives lost executors, and later scans
    prune its columns.  ``release`` deletes the tables of a session.
    """
    path = f"{_home(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session, when no DataFrame that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_home(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
