"""Stream forms, run over the supplied tables as file streams until nothing is left to read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.operators import integrity as I
from tidewall.operators import policy as A
from tidewall.plans.catalog import query
from tidewall.plans.catalog.pii import ACTION_SQL, JP, REDACT_SQL
from tidewall.plans.catalog.sources import scratch
from tidewall.plans.views import load
from tidewall.session import STATE_PROVIDER
from tidewall.sources.tables import table_path
from tidewall.streaming import stateful as SF
from tidewall.streaming import streams as S

def source(spark: SparkSession, d: str, table: str) -> DataFrame:
    """A table as a file stream."""
    schema = load(spark, d, table).schema
    path = table_path(d, table)
    return spark.readStream.schema(schema).parquet(path[:-1] + "[" + path[-1] + "]")


def run(spark: SparkSession, stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream to its end into a folder and read that."""
    base = scratch(spark, label)
    S.to_folder(stream, f"{base}/out", f"{base}/checkpoint", mode).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def with_state_store(spark: SparkSession) -> None:
    """Keyed state machines need the RocksDB store; a session that names another keeps it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, STATE_PROVIDER)


def events(spark, d):
    return S.as_event_time(source(spark, d, "events"), "ts")


@query("S11_watch_dir", "select event_type, cast(count(*) as bigint) as n, cast(sum(user_id) as bigint) as users from events group by 1")
def _(spark, d):
    base = scratch(spark, "watch")
    load(spark, d, "events").select("event_id", "user_id", "event_type").repartition(4).write.parquet(f"{base}/in")
    seen = S.watch_dir(spark, f"{base}/in", "event_id bigint, user_id bigint, event_type string", files_per_batch=2)
    return run(spark, seen, "watched").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))


@query(
    "X1_stream_pii",
    f"""select r.doc_id, md5(r.redacted_text) as redacted_md5, a.doc_action from ({REDACT_SQL}) r join ({ACTION_SQL}) a on a.doc_id = r.doc_id""",
)
def _(spark, d):
    out = run(spark, S.stream_pii(source(spark, d, "documents"), "doc_id", "text", JP), "pii")
    return out.select("doc_id", F.md5("redacted_text").alias("redacted_md5"), "doc_action")


@query("X2_counters_batch", "select time_bucket(interval '1 hour', ts) as window_start, event_type, cast(count(*) as bigint) as events from v_audit group by 1, 2")
def _(spark, d):
    a = S.as_event_time(load(spark, d, "v_audit"), "ts")
    return S.stream_counters(a, "ts", ["event_type"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# a stream sends a window when the watermark, an hour behind the last row, has passed its end
CLOSED = "<= (select max(ts) from events) - interval 1 hour"


@query(
    "X2_stream_counters",
    f"""select date_trunc('hour', ts) as window_start, event_type, cast(count(*) as bigint) as events from events group by 1, 2
        having date_trunc('hour', ts) + interval 1 hour {CLOSED}""",
)
def _(spark, d):
    out = run(spark, S.stream_counters(events(spark, d), "ts", ["event_type"]), "counters")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "X3_stream_rate",
    f"""with s as (select user_id, date_trunc('hour', ts) - to_hours(cast(i as int)) as window_start from events, unnest(range(0, 6)) as u(i))
        select window_start, user_id, cast(count(*) as bigint) as requests from s where window_start + interval 6 hours {CLOSED} group by 1, 2""",
)
def _(spark, d):
    out = run(spark, S.stream_rate(events(spark, d), "ts", "user_id", "6 hours", "1 hour"), "rate")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "X3_stream_limiter",
    """with recursive e as (select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) as n from events),
       w as (select user_id, cast(0 as bigint) as n, cast(null as bigint) as event_id, []::timestamp[] as seen, false as allowed, cast(0 as bigint) as remaining from (select distinct user_id from e) x
         union all
         select e.user_id, e.n, e.event_id, case when len(k.live) < 3 then list_append(k.live, e.ts) else k.live end, len(k.live) < 3, cast(greatest(2 - len(k.live), 0) as bigint)
         from w join e on e.user_id = w.user_id and e.n = w.n + 1, lateral (select list_filter(w.seen, lambda s: s > e.ts - interval 12 hours) as live) k)
       select event_id as request_id, user_id as client, allowed, remaining from w where n > 0""",
)
def _(spark, d):
    with_state_store(spark)
    return run(spark, SF.stream_limiter(events(spark, d), "user_id", "ts", "event_id", 3, 12 * 3600), "limiter")


@query("X4_stream_approvals")
def _(spark, d):
    with_state_store(spark)
    log = events(spark, d).select(
        F.expr("user_id * 100 + day(ts)").alias("request_id"),
        "ts",
        F.expr("case event_type when 'signup' then 'approved' when 'view' then 'transferring' when 'click' then 'rejected' when 'purchase' then 'completed' else 'failed' end").alias("status"),
    )
    return run(spark, SF.stream_approvals(log, "request_id", "ts", "status", expiry_seconds=6 * 3600), "approvals")


@query("X5_stream_assemble", "select doc_id as file_id, 'complete' as outcome, md5(text) as file_md5 from documents")
def _(spark, d):
    with_state_store(spark)
    docs = load(spark, d, "documents").select("doc_id", "text")
    parts = I.chunk(docs, "doc_id", "text", 512).join(
        docs.select("doc_id", F.greatest(F.ceil(F.length("text") / 512), F.lit(1)).cast("bigint").alias("expected_count")), "doc_id"
    )
    base = scratch(spark, "chunks")
    parts.withColumn("ts", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(chunk_index as int))")).repartition(6).write.parquet(f"{base}/in")
    schema = "doc_id bigint, chunk_index bigint, data string, chunk_size bigint, chunk_md5 string, expected_count bigint, ts timestamp"
    arriving = S.watch_dir(spark, f"{base}/in", schema, files_per_batch=3)
    out = run(spark, SF.stream_assemble(arriving, "doc_id", "ts", idle_seconds=10**7), "assembled")
    return out.select("file_id", "outcome", "file_md5")


@query("X6_stream_dedupe", "select distinct user_id, event_type from events")
def _(spark, d):
    out = run(spark, S.stream_dedupe(events(spark, d).select("event_id", "user_id", "event_type", "ts"), "ts", ["user_id", "event_type"], "60 days"), "dedupe")
    return out.select("user_id", "event_type")


@query("X7_sessions_batch", """
with p as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as pv from events),
n as (select *, sum(case when pv is null or ts - pv >= interval 4 hours then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as s from p)
select user_id, min(ts) as session_start, max(ts) + interval 4 hours as session_end, cast(count(*) as bigint) as events from n group by user_id, s""")
def _(spark, d):
    e = S.as_event_time(load(spark, d, "events"), "ts")
    out = S.stream_sessions(e, "ts", "user_id", "4 hours")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("X7_stream_sessions", f"""
with p as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as pv from events),
n as (select *, sum(case when pv is null or ts - pv >= interval 4 hours then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as s from p)
select user_id, min(ts) as session_start, max(ts) + interval 4 hours as session_end, cast(count(*) as bigint) as events from n group by user_id, s
having max(ts) + interval 4 hours {CLOSED}""")
def _(spark, d):
    out = run(spark, S.stream_sessions(events(spark, d), "ts", "user_id", "4 hours"), "sessions")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


RULE_FILE = {
    "rules": [
        {"id": "deny-secret", "effect": "deny", "priority": 5, "conditions": [{"attr": "data_classification", "op": "eq", "value": "secret"}, {"attr": "role", "op": "neq", "value": "admin"}]},
        {"id": "permit-lan", "effect": "permit", "priority": 9, "conditions": [{"attr": "ip_address", "op": "cidr", "value": "10.0.0.0/8"}]},
    ]
}
DECIDE_SQL = """select request_id, case when data_classification = 'secret' and role <> 'admin' then 'deny' when starts_with(ip_address, '10.') then 'permit' else 'deny' end as effect from v_access_request"""


def rule_file(spark) -> str:
    path = scratch(spark, "policy") + "/rules"
    spark.createDataFrame([(json.dumps(RULE_FILE),)], "value string").coalesce(1).write.text(path)
    return path


@query("A21_reloading_rules", DECIDE_SQL)
def _(spark, d):
    rules = S.ReloadingRules(spark, rule_file(spark))
    return A.abac_decide(load(spark, d, "v_access_request"), rules.refresh()).select("request_id", "effect")


@query("X8_stream_decide", DECIDE_SQL)
def _(spark, d):
    base = scratch(spark, "requests")
    load(spark, d, "v_access_request").repartition(4).write.parquet(f"{base}/in")
    schema = load(spark, d, "v_access_request").schema
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    S.stream_decide(arriving, rule_file(spark), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("request_id", "effect")


@query(
    "X9_stream_decision_files",
    "select cast(s_suppkey as string) as decided_file_id, case when s_suppkey % 2 = 0 then 'approved' else 'rejected' end as target_state from supplier where s_suppkey % 5 <> 0",
)
def _(spark, d):
    base = scratch(spark, "decisions")
    # Spark names its files itself, so the decision is the folder that holds a file
    names = load(spark, d, "supplier").selectExpr(
        "concat(s_suppkey, case when s_suppkey % 5 = 0 then '.note' when s_suppkey % 2 = 0 then '.approved' else '.rejected' end) as decision", "'x' as value"
    )
    # every task makes and commits the files of its decisions; the driver moves none
    names.repartition(spark.sparkContext.defaultParallelism * 4, "decision").write.partitionBy("decision").option(
        "mapreduce.fileoutputcommitter.algorithm.version", "2"
    ).text(f"{base}/in")
    out = run(spark, S.stream_decision_files(spark, f"{base}/in", name_in_path=r"decision=([^/]+)/[^/]+$"), "decided")
    return out.select("decided_file_id", "target_state")


@query("X10_restart", "select event_type, cast(count(*) as bigint) as n from events group by 1")
def _(spark, d):
    base = scratch(spark, "restart")
    e = load(spark, d, "events").select("event_id", "event_type")
    schema = "event_id bigint, event_type string"
    for part in (0, 1):
        e.where(f"event_id % 2 = {part}").write.mode("append").parquet(f"{base}/in")
        S.to_folder(S.watch_dir(spark, f"{base}/in", schema), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))

