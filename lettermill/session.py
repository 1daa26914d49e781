"""Session helpers: local sessions for tests, shared scratch space, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", name: str = "lettermill") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        # Small test data: keep shuffles in several tasks, not one.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    ``spark.checkpoint.dir`` decides. Only where nothing is set (single-machine
    tests) a temporary folder is made and becomes the checkpoint folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if sc.getCheckpointDir() is None:
        if configured is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="lettermill-")
        sc.setCheckpointDir(configured)
    return (configured or sc.getCheckpointDir()).rstrip("/")


def work_folder(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{shared_folder(spark)}/lettermill/{spark.sparkContext.applicationId}"


def new_work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the application's part of the shared folder."""
    return f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"


def drop_work(spark: SparkSession) -> None:
    """Delete all this application wrote as work tables; call it when results are stored."""
    where = spark._jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What an action shuffles in here is deleted as the action ends.

    Otherwise shuffle files stay until the driver happens to collect its garbage: the disk
    then holds those of all steps, not of one.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table below the shared folder and go on from the files.

    Columnar files survive lost executors and later steps read only the columns
    they need.
    """
    path = new_work_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Cut a table scan with fewer splits than cores into one part per core.

    A single small file is one task whatever runs on it. Large tables have more
    splits than cores and are returned as they are: no shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, key)
