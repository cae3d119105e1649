"""Workload lines as they arrive: the loader's expressions keep no state, so a stream of lines is loaded as a table is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cardscope.sources.workload_lines import classify_lines

LINE_SCHEMA = "line_id bigint, file_name string, file_format string, line_number string, raw_line string, received_at timestamp"


def stream_lines(spark: SparkSession, folder: str, days: int = 7) -> DataFrame:
    """Classified lines of the Parquet files that appear in a folder. A line delivered twice within that many days of event
    time counts once; its key is kept in state until the watermark passes it."""
    lines = spark.readStream.schema(LINE_SCHEMA).parquet(folder)
    once = lines.withWatermark("received_at", f"{days} days").dropDuplicatesWithinWatermark(["line_id"])
    return classify_lines(once)


def write_both(lines: DataFrame, accepted: str, rejected: str, checkpoint: str) -> Callable:
    """Starts a query that appends lines that load to one Parquet folder and the others, with their reason, to another; each
    batch is written under its own number, so one that is repeated after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for keep, path in (("reason is null", accepted), ("reason is not null", rejected)):
            batch.where(keep).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start
