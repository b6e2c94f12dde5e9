"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every operator relies on: UTC session time, AQE with partition
# coalescing and skew-join splitting.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a repeated key in a log line keeps its last value, as the logs' readers do
    "spark.sql.variant.allowDuplicateKeys": "true",
    # a generated method longer than this is never compiled by the JIT (the JSONL
    # parser's are): such a stage runs without fusion, its expressions in small methods
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


# The JSONL parser generates large methods; let the JIT compile them.
JIT_OPTION = "-XX:-DontCompileHugeMethods"


def get_spark(master: str | None = None, app: str = "meterline",
              shuffle_partitions: int | None = None,
              conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(BASE_CONF)
    for key in ("spark.driver.extraJavaOptions", "spark.executor.extraJavaOptions"):
        settings[key] = JIT_OPTION
    # checkpoint files of frames no longer referenced are removed by the cleaner
    settings["spark.cleaner.referenceTracking.cleanCheckpoints"] = "true"
    if master and master.startswith("local"):
        # one machine: listing files with Spark jobs only adds scheduling
        settings["spark.sql.sources.parallelPartitionDiscovery.threshold"] = "1000000"
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k, v in BASE_CONF.items():
        spark.conf.set(k, v)
    return spark


def ensure_session(spark: SparkSession) -> SparkSession:
    """Apply the session settings the operators rely on (UTC session time,
    AQE) to a session created elsewhere."""
    for k, v in BASE_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the deployment (a shared file system).
    Only a local-mode session without the setting gets a private scratch
    folder, which is what tests use.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; a shared folder is required on a cluster")
        configured = tempfile.mkdtemp(prefix="meterline-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


class session_conf:
    """Temporarily set session options for the jobs run inside the block."""

    def __init__(self, spark: SparkSession, **options: str):
        self.spark, self.options, self.saved = spark, options, {}

    def __enter__(self):
        for k, v in self.options.items():
            key = k.replace("__", ".")
            self.saved[key] = self.spark.conf.get(key, None)
            self.spark.conf.set(key, v)
        return self

    def __exit__(self, *exc):
        for key, v in self.saved.items():
            if v is None:
                self.spark.conf.unset(key)
            else:
                self.spark.conf.set(key, v)
        return False


def materialize_checkpoint(df):
    """The rows of ``df`` as a parquet table in ``spark.checkpoint.dir``: the
    plan runs once, the lineage is cut (a lost executor reads files again), and
    later reads prune columns and push filters down.  The files are deleted
    when the application ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/meterline-tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)
