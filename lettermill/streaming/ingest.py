"""Continuous ingest: new messages are cleaned, chunked, embedded and stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import cleaning
from ..operators.embedding import Model, build_index, index_chunks, payloads
from ..schema import PARTS
from ..sources.store import index_folder


def read_part_stream(
    spark: SparkSession, path: str, schema: T.StructType = PARTS, files_per_batch: int = 100
) -> DataFrame:
    """Message parts arriving as Parquet files in a folder."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def ingest(
    parts: DataFrame,
    store: str,
    checkpoint: str,
    addresses: list[str],
    index_name: str,
    chunk_size: int,
    chunk_overlap: int,
    model: Model | None = None,
    detect_language: Callable[[Column], Column] | None = None,
    recursive: bool = True,
    every: str | None = None,
) -> StreamingQuery:
    """Append every batch's clean chunks to ``store``/index_name=.../batch_id=stream-N.

    Takes what has arrived and stops, or goes on with a batch ``every`` interval.

    A batch that is run again after a failure overwrites its own folder, so each
    message is stored once. Read the store with ``ingested``.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        flagged = cleaning.flag_parts(batch, addresses, detect_language)
        emails = cleaning.clean_emails(flagged).select(
            F.concat_ws("#", "msg_id", F.col("part_no").cast("string")).alias("email_id"),
            "email",
            "subject",
            "thread",
            F.col("date_iso").alias("date"),
            F.lit(None).cast("string").alias("summary"),
        )
        build_index(
            emails, "email_id", index_name, model, chunk_size, chunk_overlap, recursive
        ).drop("index_name").write.mode("overwrite").parquet(
            f"{index_folder(parts.sparkSession, store, index_name)}/batch_id=stream-{batch_id}"
        )

    return (
        parts.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(**({"processingTime": every} if every else {"availableNow": True}))
        .start()
    )


def ingest_documents(
    docs: DataFrame,
    store: str,
    payload_store: str,
    checkpoint: str,
    id_col: str,
    body_col: str,
    index_name: str,
    chunk_size: int,
    chunk_overlap: int,
    model: Model | None = None,
    recursive: bool = True,
    every: str | None = None,
) -> StreamingQuery:
    """Append every batch's documents, of any columns, to an index: keyed chunks to ``store``,
    the documents to ``payload_store``.

    A batch that is run again overwrites its own two folders.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = docs.sparkSession
        chunks = index_chunks(batch, id_col, body_col, index_name, model, chunk_size, chunk_overlap, recursive)
        for rows, where in ((chunks, store), (payloads(batch, id_col, index_name), payload_store)):
            folder = f"{index_folder(spark, where, index_name)}/batch_id=stream-{batch_id}"
            rows.drop("index_name").write.mode("overwrite").parquet(folder)

    return (
        docs.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(**({"processingTime": every} if every else {"availableNow": True}))
        .start()
    )


def ingested(spark: SparkSession, store: str) -> DataFrame:
    """All chunks stored so far; ``batch_id`` is a partition column."""
    return spark.read.option("basePath", store).parquet(store)
