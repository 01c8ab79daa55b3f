"""Session helpers: tables, the shared folder, partition counts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "ledgerlark", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, a parquet file or folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, a URI: the session's spark.checkpoint.dir. Only in local mode, where it may be unset,
    a temporary folder of this machine is set, once per session; on a cluster that's an error."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            conf = set_dir.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            conf = "file://" + tempfile.mkdtemp(prefix="ledgerlark-")
            spark.sparkContext.setCheckpointDir(conf)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return conf if "://" in conf or conf.startswith("file:") else "file://" + os.path.abspath(conf)


def partition_bound(df: DataFrame) -> int:
    """About how many partitions a plan has at most, without running it: what its last exchange is planned with, or for a scan
    its size over the size of a split."""
    plan = df._jdf.queryExecution()
    n = plan.executedPlan().outputPartitioning().numPartitions()
    if n:
        return n
    spark = df.sparkSession
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    return min(max(spark.sparkContext.defaultParallelism, -(-size // split)), 1 << 20)


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/ledgerlark/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder, which survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
