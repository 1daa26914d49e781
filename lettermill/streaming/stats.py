"""Statistics per day, kept up to date as rows arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import exists


def stats_by_day(rows: DataFrame, time_col: str, reason_col: str) -> DataFrame:
    """(day, reason, n), batch or streaming; one window per UTC day."""
    return (
        rows.groupBy(F.window(F.col(time_col), "1 day").alias("w"), F.col(reason_col).alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("day"), "reason", "n")
    )


def stream_stats(
    rows: DataFrame,
    time_col: str,
    reason_col: str,
    out: str,
    checkpoint: str,
    lateness: str | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Write changed counters of every batch to ``out``/batch_id=N.

    State is one counter per day and reason, so nothing has to be forgotten: without
    ``lateness`` every row counts, in whatever order days arrive. With it, days older than
    the newest day by more than that are closed, and ``late_rows`` tells what they missed.
    Re-run batches overwrite themselves. Takes what has arrived and stops, or runs
    ``every`` interval.
    """
    spark = rows.sparkSession

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    def keep_with_late(batch: DataFrame, batch_id: int) -> None:
        # Counted here and not by the state store, which counts partial sums, not rows.
        newest = _newest_before(spark, f"{out}-late", batch_id)
        day = F.date_trunc("day", F.col(time_col))
        closed = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {lateness}")
        late = F.coalesce(day + F.expr("INTERVAL 1 day") <= closed, F.lit(False))
        stats_by_day(batch.where(~late), time_col, reason_col).write.mode("overwrite").parquet(
            f"{out}/batch_id={batch_id}"
        )
        batch.agg(
            F.count(F.when(late, 1)).alias("late"),
            F.greatest(F.max(time_col), F.lit(newest).cast("timestamp")).alias("newest"),
        ).write.mode("overwrite").parquet(f"{out}-late/batch_id={batch_id}")

    counted = stats_by_day(rows, time_col, reason_col) if lateness is None else rows
    return (
        counted.writeStream.outputMode("update" if lateness is None else "append")
        .foreachBatch(keep if lateness is None else keep_with_late)
        .option("checkpointLocation", checkpoint)
        .trigger(**({"processingTime": every} if every else {"availableNow": True}))
        .start()
    )


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.option("basePath", path).parquet(path) if exists(spark, path) else None


def _newest_before(spark: SparkSession, path: str, batch_id: int):
    seen = _stored(spark, path)
    return None if seen is None else seen.where(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]


def latest_stats(spark: SparkSession, out: str) -> DataFrame:
    """The newest counter of each day and reason, of a stream without lateness."""
    return _stored(spark, out).groupBy("day", "reason").agg(F.max_by("n", "batch_id").alias("n"))


def closed_stats(spark: SparkSession, out: str) -> DataFrame:
    """The counters of a stream with lateness: every batch holds its own rows' counts."""
    return _stored(spark, out).groupBy("day", "reason").agg(F.sum("n").alias("n"))


def late_rows(spark: SparkSession, out: str) -> int:
    """Input rows that came too late, over all batches so far."""
    seen = _stored(spark, f"{out}-late")
    return 0 if seen is None else seen.agg(F.sum("late")).first()[0] or 0
