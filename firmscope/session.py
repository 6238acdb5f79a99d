"""Session helpers: a local session for tests and benchmarks, and the
reliable checkpoint directory every lineage cut goes through."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "firmscope") -> SparkSession:
    """A local session configured like the cluster one (AQE on, UI off)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # small memory pages: the default grows with the heap and every
        # sort/aggregate of a task allocates one, which dominates tiny tasks
        .config("spark.buffer.pageSize", "2m")
        .config("spark.driver.memory", os.environ.get("FIRMSCOPE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster in
    ``spark.checkpoint.dir``. Only a local-mode session (tests) gets a
    private folder when the setting is absent."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running firmscope on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="firmscope-ckpt-"))
    return sc.getCheckpointDir()


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system it lives on."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


class Scratch:
    """Tables that a fit writes for itself alone. They are removed when the
    block ends, by when their readers have brought their numbers to the
    driver or into another table."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        self.clear()

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{checkpoint_dir(self.spark).rstrip('/')}/firmscope-{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).select(*df.columns)

    def clear(self, keep: int = 0) -> None:
        """Remove all tables but the last ``keep``."""
        gone = self.paths[: len(self.paths) - keep]
        self.paths = self.paths[len(gone) :]
        for path in gone:
            remove_table(self.spark, path)


def own_method(df: DataFrame) -> DataFrame:
    """``df`` with its rows counted in passing (``observe``). Spark generates
    separate code for the steps before and after the count. A projection over
    wide rows that is fused with the one before it becomes a method of more
    than 8,000 bytes, which the JVM runs without compiling it."""
    return df.observe(f"rows-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def cut_lineage(df: DataFrame, name: str = "stage", partition_by: str | None = None) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder
    and read it back: one job, survives executor loss, starts a new lineage,
    and later reads get column pruning and filter pushdown (and partition
    pruning on ``partition_by``). The schema is kept as written."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/firmscope-{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back.select(*df.columns)
