"""Stage tables on shared storage: the chunk store, reuse of results, reports."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CHUNKS


def exists(spark: SparkSession, path: str) -> bool:
    """True if the path can be seen by the session's file systems."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(where))


def load_index(
    spark: SparkSession, path: str, index_name: str, schema: T.StructType = CHUNKS
) -> DataFrame:
    """Chunks of one index; a missing store or index is empty, not an error."""
    try:
        stored = spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return stored.where(F.col("index_name") == index_name).select(*schema.names)


def payload_schema(columns: T.StructType) -> T.StructType:
    """Row type of a payload table of documents with these columns."""
    return T.StructType(
        [
            T.StructField("doc_id", T.StringType()),
            T.StructField("payload", columns),
            T.StructField("index_name", T.StringType()),
        ]
    )


def store_chunks(chunks: DataFrame, path: str) -> None:
    """Append chunks or payloads to their store; indexes are partitions, duplicates are kept.

    Below an index every write has a folder of its own, as the batches of a stream have,
    so batch and stream can fill the same index.
    """
    batch = F.lit(f"set-{uuid.uuid4().hex[:12]}")
    chunks.withColumn("batch_id", batch).write.mode("append").partitionBy("index_name", "batch_id").parquet(path)


def index_folder(spark: SparkSession, path: str, index_name: str) -> str:
    """The partition folder of an index, its name escaped as the writer does."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return f"{path.rstrip('/')}/index_name={escape(index_name)}"


def replace_index(chunks: DataFrame, path: str) -> None:
    """Write the indexes in ``chunks`` anew and leave the others alone.

    The new rows are written beside the old ones, which are deleted afterwards.
    """
    spark = chunks.sparkSession
    written = f"whole-{uuid.uuid4().hex[:12]}"
    chunks.withColumn("batch_id", F.lit(written)).write.mode("append").partitionBy(
        "index_name", "batch_id"
    ).parquet(path)
    new = spark.read.parquet(path).where(F.col("batch_id") == written)
    for (name,) in new.select("index_name").distinct().collect():
        folder = spark._jvm.org.apache.hadoop.fs.Path(index_folder(spark, path, name))
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in fs.listStatus(folder):
            if found.getPath().getName() != f"batch_id={written}":
                fs.delete(found.getPath(), True)


def materialise(df: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Reuse the table at ``path`` if it is there, else (or if forced) write it.

    Only a finished write counts: the committer's ``_SUCCESS`` marker is checked.
    """
    spark = df.sparkSession
    if force or not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_report(scores: DataFrame, metrics: DataFrame, path: str) -> None:
    """Per-sample scores and the one-row summary as JSON with sorted keys."""
    for name, df in (("responses", scores), ("aggregate_metrics", metrics)):
        df.select(*sorted(df.columns)).write.json(f"{path.rstrip('/')}/{name}")
