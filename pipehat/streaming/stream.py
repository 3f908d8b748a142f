"""Messages as streams: the same columns over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import query, scan
from ..sources.files import split_messages


def stream_messages(spark: SparkSession, path: str, split: bool = False, max_files: int = 1000) -> DataFrame:
    """A stream of (message_id, source_path, message) over the files of a folder, a file at most once; see ``read_messages``."""
    files = spark.readStream.option("wholetext", "true").option("maxFilesPerTrigger", max_files).text(path)
    files = files.select(F.col("_metadata.file_name").alias("message_id"), F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("message"))
    return split_messages(files) if split else files


def with_header(messages: DataFrame) -> DataFrame:
    """``messages`` (batch or stream) with the header's control_id, message_type, trigger_event and event_time (null if it is no time)."""
    paths = {"control_id": "MSH-10", "message_type": "MSH-9.1", "trigger_event": "MSH-9.2", "event_time": "MSH-7"}
    rows = query(scan(messages), paths)
    first = lambda c: F.get(F.get(F.col(c), F.lit(0)), F.lit(0))
    time = F.try_to_timestamp(F.substring(first("event_time"), 1, 14), F.lit("yyyyMMddHHmmss"))
    rows = rows.withColumns({c: first(c) for c in list(paths)[:3]} | {"event_time": time})
    return rows.drop(*(f"{c}_error" for c in paths))


def without_repeats(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of ``with_header`` rows without those whose control id came before within ``delay`` of event time."""
    return messages.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["control_id"])


def counts_by_type(messages: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """(window, message_type, trigger_event, n) of a stream of ``with_header`` rows; late messages count up to ``delay``."""
    rows = messages.withWatermark("event_time", delay)
    return rows.groupBy(F.window("event_time", window), "message_type", "trigger_event").agg(F.count("*").alias("n"))
