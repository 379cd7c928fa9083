"""Tracking files as they arrive: the same scan and explode on a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tracking import explode_players, read_tracking


def stream_players(spark: SparkSession, path: str, roster: DataFrame) -> DataFrame:
    """Player rows of new tracking files (stateless, so late files need no watermark)."""
    return explode_players(read_tracking(spark, path, stream=True), roster)


def append_available(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Append everything that has arrived to a parquet table partitioned by match, exactly once."""
    q = (
        rows.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .partitionBy("match_id")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
