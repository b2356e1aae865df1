"""Stream forms of the batch operators.

Sources are file streams: the checkpoint holds the set of files seen, so each file is read once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidewall.operators.lifecycle import classify_filename
from tidewall.operators.pii import doc_action, redact_text, with_matches
from tidewall.operators.policy import PolicyRule, abac_decide
from tidewall.rules.pii import TextRule


def watch_dir(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Rows of the files that arrive in a folder, each file once."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def checkpointed(writer: DataStreamWriter, checkpoint: str, available_now: bool = True) -> DataStreamWriter:
    """Give a stream a checkpoint to restart from: sources, state and sink go on where they stopped."""
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if available_now else writer


def to_folder(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream to a parquet folder up to what is available now."""
    return checkpointed(df.writeStream.format("parquet").outputMode(mode), checkpoint).start(path)


def stream_pii(source: DataFrame, key: str, text: str, rules: list[TextRule]) -> DataFrame:
    """Redacted text, match count and action of arriving documents. Stateless."""
    scanned = redact_text(with_matches(source.select(key, text), text, rules), text)
    return scanned.select(
        key, F.size("matches").cast("bigint").alias("match_count"), doc_action(F.col("matches")).alias("doc_action"), "redacted_text"
    )


def stream_counters(events: DataFrame, ts: str, by: list[str], window: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Events per tumbling window; rows later than the watermark are dropped."""
    return (
        events.withWatermark(ts, lateness)
        .groupBy(F.window(ts, window), *by)
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("window.start").alias("window_start"), *by, "events")
    )


def stream_rate(events: DataFrame, ts: str, key: str, window: str = "1 hour", slide: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Requests per key in sliding windows."""
    return (
        events.withWatermark(ts, lateness)
        .groupBy(F.window(ts, window, slide), key)
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(F.col("window.start").alias("window_start"), key, "requests")
    )


def stream_dedupe(events: DataFrame, ts: str, keys: list[str], ttl: str = "1 hour") -> DataFrame:
    """Let a key through once per TTL."""
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def stream_sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Activity sessions per key, closed by a silence of ``gap``."""
    return (
        events.withWatermark(ts, lateness)
        .groupBy(F.session_window(ts, gap), key)
        .agg(F.count(F.lit(1)).alias("events"))
        .select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events")
    )


class ReloadingRules:
    """Rules of a file, re-read for every batch.

    A version that does not load or does not pass the checks is refused and the last good one stays.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str = "policy"):
        from tidewall.sources.rules import load_rules

        self._load: Callable = lambda: load_rules(spark, path, kind)
        self.current = self._load()
        self.last_error: str | None = None

    def refresh(self):
        try:
            self.current = self._load()
            self.last_error = None
        except Exception as e:  # any bad version must leave the good one in force
            self.last_error = str(e)
        return self.current


def stream_decide(requests: DataFrame, rules_path: str, out: str, checkpoint: str, default: str = "deny") -> StreamingQuery:
    """Decide a request stream; a changed rule file takes effect with the next batch.

    A batch is written to a folder of its own, replaced if the batch is run again after a failure.
    """
    rules = ReloadingRules(requests.sparkSession, rules_path)

    def decide(batch: DataFrame, batch_id: int) -> None:
        now: list[PolicyRule] = rules.refresh()
        abac_decide(batch, now, default).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return checkpointed(requests.writeStream.foreachBatch(decide), checkpoint).start()


def stream_decision_files(
    spark: SparkSession,
    path: str,
    approved: str = "{file_id}.approved",
    rejected: str = "{file_id}.rejected",
    name_in_path: str = r"([^/]+)$",
) -> DataFrame:
    """State changes from the names of files that arrive in a folder; other names are left out.

    ``name_in_path`` picks the name out of the path. Spark reads no rows from empty files, so a
    decision file holds at least one byte.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(F.regexp_extract("path", name_in_path, 1).alias("name"), F.col("modificationTime").alias("decided_at"))
    )
    return classify_filename(files, "name", approved, rejected).where(F.col("target_state").isNotNull())


def as_event_time(df: DataFrame, ts: str) -> DataFrame:
    """Zone-less timestamps as UTC instants, which watermarks need (session time zone UTC)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))

