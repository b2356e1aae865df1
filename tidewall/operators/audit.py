"""Audit-log analytics: schema, query, paging, statistics, retention, exports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewall.functions.ordered import time_bucket, with_previous, with_running_sum

# --- fixed values: audit columns, event severities, export columns, retention presets ---
AUDIT_COLUMNS = (
    ("event_id", "string"), ("timestamp", "timestamp_ntz"), ("event_type", "string"), ("actor_id", "string"),
    ("actor_name", "string"), ("actor_role", "string"), ("file_id", "string"), ("filename", "string"),
    ("file_size", "bigint"), ("original_hash", "string"), ("sanitized_hash", "string"),
    ("transfer_request_id", "string"), ("transfer_reason", "string"), ("approver_id", "string"),
    ("rejection_reason", "string"), ("success", "boolean"), ("error_message", "string"),
    ("processing_time_ms", "bigint"), ("ip_address", "string"), ("user_agent", "string"),
    ("transfer_id", "string"), ("applicant_id", "string"), ("policy_applied", "string"),
    ("sanitize_status", "string"), ("new_file_name", "string"), ("new_size_bytes", "bigint"),
    ("contains_personal_info", "boolean"), ("custom_fields", "map<string,string>"),
)
SEVERITY = {
    "file_uploaded": 3, "file_sanitized": 3, "file_processed": 3, "transfer_requested": 6,
    "transfer_approved": 3, "transfer_rejected": 6, "transfer_started": 3, "transfer_completed": 3,
    "file_downloaded": 3, "security_violation": 10, "system_error": 7,
}
DEFAULT_SEVERITY = 3
CSV_COLUMNS = ("event_id", "timestamp", "event_type", "actor_id", "actor_name", "file_id", "filename", "original_hash", "status")
# --- end of fixed values ---


def to_audit(df: DataFrame, mapping: dict[str, Column], custom: list[str] | None = None) -> DataFrame:
    """Any event table in the fixed 28-column schema.

    ``mapping`` gives the columns that exist; text columns without one are empty, others null.
    ``custom`` names source columns kept as custom fields.
    """
    unknown = set(mapping) - {n for n, _ in AUDIT_COLUMNS}
    if unknown:
        raise ValueError(f"not audit columns: {sorted(unknown)}")
    required_text = {"event_id", "event_type", "actor_id", "actor_name", "actor_role", "file_id", "filename"}
    out = []
    for name, kind in AUDIT_COLUMNS:
        if name == "custom_fields":
            names = custom or []
            value = F.map_from_arrays(
                F.array(*[F.lit(c) for c in names]).cast("array<string>"),
                F.array(*[F.col(c).cast("string") for c in names]).cast("array<string>"),
            )
        elif name in mapping:
            value = mapping[name].cast(kind)
            if name in required_text:
                value = F.coalesce(value, F.lit(""))
        else:
            value = F.lit("") if name in required_text else F.lit(None).cast(kind)
        out.append(value.alias(name))
    return df.select(*out)


def audit_severity(event_type: Column) -> Column:
    pairs = [x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), event_type), F.lit(DEFAULT_SEVERITY)).cast("bigint")


def audit_query(
    df: DataFrame,
    event_type: str | None = None,
    actor_id: str | None = None,
    file_id: str | None = None,
    start: str | None = None,
    end: str | None = None,
    ts: str = "ts",
    date_column: str | None = None,
) -> DataFrame:
    """Filter by type, actor, file and an inclusive time range. A row without a readable time passes.

    ``date_column`` names the day partition of a written log; the range then also prunes folders.
    """
    for name, value in (("event_type", event_type), ("actor_id", actor_id), ("file_id", file_id)):
        if value is not None:
            df = df.where(F.col(name) == value)
    kind = dict(df.dtypes)[ts]
    when = F.try_to_timestamp(F.col(ts)).cast("timestamp_ntz") if kind == "string" else F.col(ts)
    for bound, low in ((start, True), (end, False)):
        if bound is None:
            continue
        limit = F.lit(bound).cast("timestamp_ntz")
        inside = when >= limit if low else when <= limit
        df = df.where(when.isNull() | inside if kind == "string" else inside | F.col(ts).isNull())
        if date_column:
            day = F.lit(bound[:10]).cast("date")
            df = df.where(F.col(date_column) >= day if low else F.col(date_column) <= day)
    return df


def audit_page(df: DataFrame, page: int, per: int, order: list[Column] | None = None) -> DataFrame:
    """Page ``page`` (from 0) in the total order (ts, event_id); past the end is empty."""
    return df.orderBy(*(order or [F.col("ts"), F.col("event_id")])).offset(page * per).limit(per)


def audit_stats(df: DataFrame, today: str, ts: str = "ts") -> DataFrame:
    """The dashboard row: counts of the day, all-time totals and the integer mean processing time."""
    is_today = F.to_date(ts) == F.lit(today).cast("date")
    kind = F.col("event_type")
    n = F.count("processing_time_ms")
    return df.agg(
        F.count_if(is_today).alias("total_events_today"),
        F.count_if(is_today & (kind == "file_uploaded")).alias("uploads_today"),
        F.count_if(is_today & (kind == "transfer_approved")).alias("approvals_today"),
        F.count_if(is_today & (kind == "transfer_rejected")).alias("rejections_today"),
        F.count_if(kind == "transfer_completed").alias("transfers_completed"),
        F.count_if(kind == "security_violation").alias("security_violations_total"),
        F.when(n == 0, F.lit(0).cast("bigint"))
        .otherwise(F.expr("sum(processing_time_ms) div greatest(count(processing_time_ms), 1)"))
        .alias("avg_processing_time_ms"),
    )


def latest_n(df: DataFrame, n: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The newest n events: a top-k, each task keeps n rows."""
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def purge(df: DataFrame, days: int, now: str, ts: str = "ts") -> DataFrame:
    """The events still within retention."""
    return df.where(F.col(ts) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days"))


def purge_by_preset(df: DataFrame, presets: DataFrame, preset: str, now: str, ts: str = "ts") -> DataFrame:
    """Retention with the days of each row's preset (``name``, ``audit_retention_days``)."""
    keep = presets.select(F.col("name").alias(preset), F.col("audit_retention_days").cast("int").alias("__days"))
    cutoff = F.date_sub(F.lit(now).cast("date"), F.col("__days"))
    return df.join(keep, preset).where(F.to_date(ts) >= cutoff).drop("__days")


def check_range(params: DataFrame, start: str = "from_ts", end: str = "to_ts") -> DataFrame:
    """Flag rows whose range is unreadable or starts after it ends; open ends are fine."""
    a, b = F.try_to_timestamp(F.col(start)), F.try_to_timestamp(F.col(end))
    bad = (F.col(start).isNotNull() & a.isNull()) | (F.col(end).isNotNull() & b.isNull())
    return params.withColumn(
        "range_error",
        F.when(bad, F.lit("unreadable")).when(a > b, F.lit("start_after_end")).otherwise(F.lit("")),
    )


def rest_audit_query(
    df: DataFrame, user: str | None = None, action: str | None = None, start: str | None = None, end: str | None = None, page: int = 1, per: int = 50
) -> DataFrame:
    """Filtered page (from 1) with has_more.

    One row more than the page is fetched; its presence says there is more.
    """
    rows = audit_query(df, event_type=action, actor_id=user, start=start, end=end)
    got = rows.orderBy("ts", "event_id").offset(max(page - 1, 0) * per).limit(per + 1)
    numbered = got.withColumn("__n", F.row_number().over(Window.orderBy("ts", "event_id")))
    # at most per + 1 rows reach this single-partition window
    flagged = numbered.withColumn("has_more", F.max("__n").over(Window.partitionBy()) > per)
    return flagged.where(F.col("__n") <= per).drop("__n")


def list_files(
    df: DataFrame,
    status: str | None = None,
    mime: str | None = None,
    sort_by: str = "created_at",
    descending: bool = True,
    tie: str = "file_id",
    page: int = 1,
    per: int = 20,
) -> DataFrame:
    """One page of a file list, sorted by a chosen column and then by the tie column."""
    if status is not None:
        df = df.where(F.col("status") == status)
    if mime is not None:
        df = df.where(F.col("mime_type") == mime)
    first = F.desc(sort_by) if descending else F.asc(sort_by)
    return df.orderBy(first, F.asc(tie)).offset(max(page - 1, 0) * per).limit(per)


def event_hash(df: DataFrame, columns: list[str] | None = None, out: str = "event_hash") -> DataFrame:
    """SHA-256 of each event's JSON."""
    return df.withColumn(out, F.sha2(F.to_json(F.struct(*(columns or df.columns))), 256))


def audit_hash(
    df: DataFrame, columns: list[str] | None = None, ts: str = "ts", order: list[str] | None = None, bucket_seconds: int = 60
) -> DataFrame:
    """Event hash plus a tamper-evident link per event.

    ``link_hash`` covers the event hash and the hash of the event before it on the same day, so
    dropping, changing or moving an event breaks its own or the next link. Unlike a running chain
    each link needs only its neighbour, which makes it computable in parallel.
    """
    keys = order or [ts, "event_id"]
    hashed = event_hash(df, columns).withColumn("event_date", F.to_date(ts))
    linked = with_previous(hashed, ["event_date"], keys, {"previous_hash": "event_hash"}, time_bucket(F.col(ts), bucket_seconds))
    return linked.withColumn(
        "link_hash", F.sha2(F.concat_ws(":", F.coalesce("previous_hash", F.lit("")), "event_hash"), 256)
    )


def day_digest(hashed: DataFrame) -> DataFrame:
    """One digest per day over its links, independent of row order: a sum of 64-bit hashes and a count."""
    return hashed.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum(F.xxhash64("link_hash").cast("decimal(38,0)")).cast("string").alias("digest"),
    )


def day_roots(hashed: DataFrame, digits: int = 5, col: str = "link_hash") -> DataFrame:
    """One row per day: events and the root of a hash tree over its links, whatever their order.

    Leaves hold the links that begin with the same ``digits`` hex digits, sorted, each different one with its number; a node is the SHA-256 of the up to
    sixteen hashes under it. Every change of a link changes the root, and no task holds more than a leaf; choose
    ``digits`` so that 16^digits leaves split a day finely enough.
    """
    once = hashed.groupBy("event_date", F.col(col).alias("__h")).agg(F.count(F.lit(1)).alias("__n"))
    item = F.concat_ws("*", "__h", F.col("__n").cast("string"))
    level = once.groupBy("event_date", F.substring("__h", 1, digits).alias("__p")).agg(
        F.sum("__n").alias("events"), F.sha2(F.array_join(F.array_sort(F.collect_list(item)), ","), 256).alias("__h")
    )
    for d in range(digits - 1, -1, -1):
        under = F.array_sort(F.collect_list(F.struct("__p", "__h")))
        joint = F.sha2(F.array_join(F.transform(under, lambda x: x["__h"]), ","), 256)
        level = level.groupBy("event_date", F.substring("__p", 1, d).alias("__up")).agg(F.sum("events").alias("events"), joint.alias("__h")).withColumnRenamed("__up", "__p")
    return level.select("event_date", "events", F.col("__h").alias("root"))


def custom_fields(df: DataFrame, col: str = "custom_fields") -> DataFrame:
    """Events and distinct values per custom field."""
    pairs = df.select(F.explode(col).alias("field", "value")).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("field").agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("distinct_values"))


def metric_counters(df: DataFrame, name: str, labels: list[str]) -> DataFrame:
    """A labelled counter as rows (metric, labels, value)."""
    label = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in labels])
    return df.groupBy(label.alias("labels")).agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "labels", "value")


def duration_summary(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Count, sum, truncated mean and maximum of a duration in ms."""
    ms = F.col(col).cast("bigint")
    return df.where(ms.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(ms).alias("sum_ms"),
        F.floor(F.sum(ms) / F.count(F.lit(1))).cast("bigint").alias("mean_ms"),
        F.max(ms).alias("max_ms"),
    )


def duration_median(df: DataFrame, by: list[str], col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(*by).agg(F.percentile_approx(col, 0.5).alias("p50_ms"))


def top_actors(df: DataFrame, k: int, actor: str = "actor_id") -> DataFrame:
    """The k busiest actors with rank; the count is partial, the ranking a top-k."""
    top = df.groupBy(actor).agg(F.count(F.lit(1)).alias("events")).orderBy(F.desc("events"), F.asc(actor)).limit(k)
    # at most k rows reach this single-partition window
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("events"), F.asc(actor))).cast("bigint"))


def sessions(df: DataFrame, key: str, order: list[str], ts: str, gap_seconds: int, bucket_seconds: int = 3600) -> DataFrame:
    """Sessions per key: a new one starts after a silence of at least ``gap_seconds``."""
    bucket = time_bucket(F.col(ts), bucket_seconds)
    prev = with_previous(df, [key], order, {"__prev_ts": ts}, bucket)
    silent = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("__prev_ts").cast("timestamp"))
    fresh = F.when(F.col("__prev_ts").isNull() | (silent >= gap_seconds * 1_000_000), F.lit(1)).otherwise(F.lit(0))
    numbered = with_running_sum(prev.withColumn("__new", fresh), [key], order, F.col("__new"), "session_no", bucket)
    return numbered.groupBy(key, "session_no").agg(
        F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count(F.lit(1)).alias("events")
    )


# ---- export lines ----
def audit_status() -> Column:
    return F.when(F.col("success"), F.lit("OK")).otherwise(F.coalesce("error_message", F.lit("ERROR")))


def audit_csv(df: DataFrame) -> DataFrame:
    """The nine export columns; write with ``write.csv``, which quotes."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in CSV_COLUMNS[:-1]]
    return df.select(*cols, audit_status().alias("status"))


def audit_jsonl(df: DataFrame, out: str = "line") -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias(out))


def cef_escape(value: Column) -> Column:
    for raw, safe in (("\\", "\\\\"), ("=", "\\="), (",", "\\,"), ("\n", "\\n")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


def _cef_header(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def audit_cef(df: DataFrame, vendor: str, product: str, version: str, out: str = "line") -> DataFrame:
    """One CEF line per event. Parts that are missing or empty are left out."""
    have = set(df.columns)

    def text(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    kind = F.col("event_type")
    msg = F.when(F.col("success"), F.concat_ws(" ", kind, F.coalesce(text("actor_name"), F.lit("")), F.coalesce(text("filename"), F.lit("")))).otherwise(
        F.concat(kind, F.lit(" FAILED: "), F.coalesce(text("error_message"), F.lit("unknown error")))
    )
    parts = [
        ("src", text("ip_address")),
        ("suser", F.nullif(text("actor_id"), F.lit(""))),
        ("act", kind),
        ("filePath", F.nullif(text("filename"), F.lit(""))),
        ("origHash", text("original_hash")),
        ("newHash", text("sanitized_hash")),
        ("msg", msg),
        ("transferId", text("transfer_id")),
        ("policyApplied", text("policy_applied")),
        ("sanitizeStatus", text("sanitize_status")),
    ]
    # concat is null when its value is; concat_ws skips nulls
    extension = F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), cef_escape(v)) for k, v in parts])
    head = [F.lit("CEF:0"), *[_cef_header(F.lit(x)) for x in (vendor, product, version)], _cef_header(kind), _cef_header(msg)]
    line = F.concat_ws("|", *head, audit_severity(kind).cast("string"), extension)
    return df.select(*[c for c in ("event_id",) if c in have], line.alias(out))


_PLACEHOLDER = re.compile(r"\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}")


def audit_template(df: DataFrame, template: str, out: str = "line") -> DataFrame:
    """Fill ``{{ column }}`` places of a template; null renders as nothing.

    A template that names a missing column or has an unclosed place falls back to JSON lines, so no
    event is lost.
    """
    names = _PLACEHOLDER.findall(template)
    rest = _PLACEHOLDER.sub("", template)
    id_cols = [c for c in ("event_id",) if c in df.columns]
    if any(n not in df.columns for n in names) or "{{" in rest or "}}" in rest:
        return df.select(*id_cols, F.to_json(F.struct("*")).alias(out))
    pieces, at = [], 0
    for m in _PLACEHOLDER.finditer(template):
        pieces += [F.lit(template[at : m.start()]), F.coalesce(F.col(m.group(1)).cast("string"), F.lit(""))]
        at = m.end()
    return df.select(*id_cols, F.concat(*pieces, F.lit(template[at:])).alias(out))


def custom_fields_from_json(col: Column) -> Column:
    """A flat JSON object as a string map."""
    return F.from_json(col, "map<string,string>")

