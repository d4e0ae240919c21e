"""Session helpers: building a session and finding the shared work folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

UTC = "UTC"


def build_session(master: str = "local[8]", app: str = "corpusflow", shuffle_partitions: int = 8,
                  extra: dict | None = None) -> SparkSession:
    """Session used by tests and the benchmark. On a cluster, use the cluster's session
    and only make sure the time zone is UTC (see :func:`ensure_utc`)."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", UTC)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # rows carry whole pages / documents: keep Arrow batches to ~1,000 rows (not 10,000)
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_utc(spark)
    return spark


# Settings for a large cluster (about 100 TB of input, ~1000 executors); apply with
# ``SparkSession.builder.config(map=CLUSTER_CONF)`` or the cluster's defaults file.
CLUSTER_CONF = {
    "spark.sql.session.timeZone": UTC,
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.shuffle.partitions": "20000",          # an upper bound; AQE coalesces small stages
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.parquet.aggregatePushdown": "true",    # min/max/count from Parquet footers
    "spark.python.worker.reuse": "true",
}


def ensure_utc(spark: SparkSession) -> None:
    """All timestamps in this library are UTC instants; parsing and display depend on it."""
    if spark.conf.get("spark.sql.session.timeZone", None) != UTC:
        spark.conf.set("spark.sql.session.timeZone", UTC)


def work_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, snapshots and stream state.

    Read from ``spark.checkpoint.dir`` (the cluster's shared folder) or the context's
    checkpoint directory. A session on a cluster that has neither is an error; on a local
    master (tests, the smoke driver) a temporary folder is made and registered with ``setCheckpointDir`` (the config key itself
    cannot be changed at runtime).
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="corpusflow-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared work folder."""
    return "/".join([work_dir(spark), *parts])


def materialize(df):
    """Cut lineage at a stage boundary that is read several times downstream.

    A reliable checkpoint into the shared work folder (``spark.checkpoint.dir``): it
    survives executor loss, unlike a local checkpoint, and later stages stop re-running
    the upstream plan (Python UDFs, joins) once per consumer.
    """
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)


SPREAD_MAX_BYTES = 1 << 30


def spread(df, min_partitions: int | None = None, key: str | None = None):
    """Give CPU-heavy per-row work (HTML cleaning, chunking, hashing) at least the
    session's parallelism. A no-op when the input already has that many partitions or is
    more than ``SPREAD_MAX_BYTES`` in its files; small inputs stored as one row group are
    spread, by hash of ``key`` when given (deterministic on retry without sorting the rows),
    else round-robin."""
    n = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SPREAD_MAX_BYTES or df._jdf.rdd().getNumPartitions() >= n:
        return df
    return df.repartition(n, key) if key and key in df.columns else df.repartition(n)
