"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every job relies on. Timestamps are compared across feeds, so the zone is pinned; AQE
#: splits skewed join partitions, coalesces small shuffle partitions at run time and sends a side of a join that has turned
#: out to be of at most 64 MB, so that the other isn't dealt. The JVM never compiles a
#: method of more than 8000 bytes, so a stage of that many expressions runs operator by operator instead. Shuffle
#: files go when the query that wrote them ends, so a job of several queries holds those of one at a time.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to an existing session (cluster sessions are never rebuilt)."""
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the benchmark."""
    partitions = shuffle_partitions or (cores if isinstance(cores, int) else 8)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("priorwise")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests, a laptop) is a fresh temporary
    folder used. The checkpoint is reliable: it survives the loss of any executor.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _checkpoint_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or local_folder(spark))
    return context._jsc.sc().getCheckpointDir().get()


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder as compressed columns and read it from there.

    For tables of many columns: these take a fraction of a checkpoint's bytes, and whoever reads them reads only the
    columns it needs. Rows may come in another order. Survives the loss of any executor, too.
    """
    path = f"{_checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_folder(spark: SparkSession) -> str:
    """A temporary folder of this machine, for local masters only: executors elsewhere would not see it."""
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="priorwise-")
