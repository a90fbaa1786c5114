"""Session settings and shared working folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators rely on; all are runtime SQL settings, so they can be
#: applied to a session somebody else created.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Joins on (page_id, x) may reuse a layout by page_id alone.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # lower() without the ICU tables, which take seconds to load on every executor
    "spark.sql.icu.caseMappings.enabled": "false",
    # Arrow batches of texts: few rows per batch, as one row may be a large page, and few bytes, so that what a Python
    # worker holds does not depend on which texts come together.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "2m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`RUNTIME_CONF` to a session and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", app: str = "pagewright", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus))
        .config("spark.driver.memory", "12g")
        # The page job has more generated classes than the default cache holds.
        .config("spark.sql.codegen.cache.maxEntries", "1000")
        # Checkpoints are compressed, and removed when nothing refers to them.
        .config("spark.checkpoint.compress", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Static: without a call site per column expression, plans build faster.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder for intermediate tables, in the shared folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only a local session
    without that setting gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="pagewright-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that later steps do not recompute it."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(work_dir(spark, "checkpoint"))
    return df.checkpoint(eager=True)


def cut_lineage_in_layout(df: DataFrame) -> DataFrame:
    """As :func:`cut_lineage`; windows, aggregates and joins on the keys that ``df`` is laid out by still need no shuffle.

    An adaptive plan does not tell its layout, so this one job is planned without.
    """
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # A new frame on the same plan: the one at hand may have been planned before.
        return cut_lineage(df.select("*"))
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan over all cores when it comes in fewer splits than there are cores.

    Costly per-row work on a handful of large Parquet row groups would otherwise
    leave cores idle. A table with enough splits, the normal case at scale, is
    returned unchanged and nothing is shuffled. Call it on plain scans only.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(2 * cores)
