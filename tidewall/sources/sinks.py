"""Audit sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_audit(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append events as JSON lines, one folder per day.

    The rows of a day are brought together, and adaptive execution splits a busy day over as many
    tasks as its size needs and joins small days, so files are neither tiny nor one per day.
    """
    dated = df.withColumn("event_date", F.to_date(ts))
    dated.hint("rebalance", "event_date").write.mode("append").partitionBy("event_date").json(path)


def read_audit(spark, path: str, schema: str) -> DataFrame:
    """A written log back, with ``event_date`` as a partition column for pruning."""
    return spark.read.schema(f"{schema}, event_date date").json(path)


def stream_audit(df: DataFrame, path: str, checkpoint: str, ts: str = "ts") -> StreamingQuery:
    """The streaming form: exactly once per event, by the sink's own commit log."""
    return (
        df.withColumn("event_date", F.to_date(ts))
        .writeStream.format("json")
        .partitionBy("event_date")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def write_lines(df: DataFrame, path: str, column: str = "line") -> None:
    """Export lines (CEF, template, JSON) as text files."""
    df.select(column).write.mode("append").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", "true").option("escape", '"').csv(path)
