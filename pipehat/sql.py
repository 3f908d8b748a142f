"""Messages for SQL users, and out of Spark: temporary views, Arrow tables and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import frames
from .plans.profile import Profile


def register(spark: SparkSession, messages: DataFrame, prefix: str, paths: dict[str, str], *, profile: Profile | None = None, id_column: str = "message_id", **options) -> None:
    """Temporary views over ``messages``: ``<prefix>_messages`` (scanned), ``<prefix>_segments`` (a row a segment) and ``<prefix>_values`` (a row a value, by the names of ``paths``).

    Nothing is computed here: the views are plans, and a query over them reads what it needs. ``options`` as in ``frames.query``.
    """
    scanned = frames.scan(messages)
    scanned.createOrReplaceTempView(f"{prefix}_messages")
    frames.segments_long(scanned, id_column, profile).createOrReplaceTempView(f"{prefix}_segments")
    frames.values_long(scanned, paths, id_column, profile=profile, **options).createOrReplaceTempView(f"{prefix}_values")


def arrow(df: DataFrame):
    """A result as one Arrow table on the driver: for results that fit there."""
    return df.toArrow()


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    """A result as Parquet files, in folders by the given columns."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
