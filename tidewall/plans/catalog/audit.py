"""Audit analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewall.operators import audit as U
from tidewall.operators import files as T
from tidewall.plans.catalog import query
from tidewall.plans.catalog.sources import full_audit
from tidewall.plans.views import load

TODAY = "2024-01-15"
SEV = "case event_type when 'transfer_requested' then 6 when 'system_error' then 7 else 3 end"


def audit(spark, d):
    return load(spark, d, "v_audit")


@query(
    "U1_to_audit",
    """select cast(event_id as string) as event_id, event_type, actor_id, upper(actor_id) as actor_name, '' as actor_role, concat(file_id, ',a=b.txt') as filename,
         success, error_message, processing_time_ms, cast(null as bigint) as file_size, props as custom_props from v_audit""",
)
def _(spark, d):
    return full_audit(spark, d).select(
        "event_id", "event_type", "actor_id", "actor_name", "actor_role", "filename", "success", "error_message", "processing_time_ms", "file_size",
        F.element_at("custom_fields", "props").alias("custom_props"),
    )


@query(
    "U2_audit_query",
    "select event_id, ts, actor_id from v_audit where event_type = 'file_uploaded' and ts >= timestamp '2024-01-10 06:00:00' and ts <= timestamp '2024-01-12 18:30:00'",
)
def _(spark, d):
    return U.audit_query(audit(spark, d), "file_uploaded", start="2024-01-10 06:00:00", end="2024-01-12 18:30:00").select("event_id", "ts", "actor_id")


@query(
    "U2_audit_query_text_time",
    "select event_id from v_audit where actor_id = 'user-7' and (event_id % 3 = 0 or ts >= timestamp '2024-01-20 00:00:00')",
)
def _(spark, d):
    texts = audit(spark, d).withColumn("ts", F.expr("case when event_id % 3 = 0 then 'not a time' else cast(ts as string) end"))
    return U.audit_query(texts, actor_id="user-7", start="2024-01-20 00:00:00").select("event_id")


@query("U3_audit_page", "select event_id, ts, event_type from v_audit order by ts, event_id limit 40 offset 120")
def _(spark, d):
    return U.audit_page(audit(spark, d).select("event_id", "ts", "event_type"), 3, 40)


@query(
    "U4_audit_stats",
    f"""select cast(count(*) filter (where strftime(ts, '%Y-%m-%d') = '{TODAY}') as bigint) as total_events_today,
          cast(count(*) filter (where strftime(ts, '%Y-%m-%d') = '{TODAY}' and event_type = 'file_uploaded') as bigint) as uploads_today,
          cast(count(*) filter (where strftime(ts, '%Y-%m-%d') = '{TODAY}' and event_type = 'transfer_approved') as bigint) as approvals_today,
          cast(count(*) filter (where strftime(ts, '%Y-%m-%d') = '{TODAY}' and event_type = 'transfer_rejected') as bigint) as rejections_today,
          cast(count(*) filter (where event_type = 'transfer_completed') as bigint) as transfers_completed,
          cast(count(*) filter (where event_type = 'security_violation') as bigint) as security_violations_total,
          cast(sum(processing_time_ms) // count(processing_time_ms) as bigint) as avg_processing_time_ms from v_audit""",
)
def _(spark, d):
    return U.audit_stats(audit(spark, d), TODAY)


@query("U5_audit_severity", f"select event_type, cast({SEV} as bigint) as severity, cast(count(*) as bigint) as events from v_audit group by 1, 2")
def _(spark, d):
    return audit(spark, d).select("event_type", U.audit_severity(F.col("event_type")).alias("severity")).groupBy("event_type", "severity").agg(
        F.count(F.lit(1)).alias("events")
    )


@query("U6_latest_n", "select event_id, ts from v_audit order by ts desc, event_id desc limit 500")
def _(spark, d):
    return U.latest_n(audit(spark, d).select("event_id", "ts"), 500)


@query("U7_purge", "select event_id from v_audit where ts >= timestamp '2024-02-01 00:00:00' - interval 14 days")
def _(spark, d):
    return U.purge(audit(spark, d), 14, "2024-02-01 00:00:00").select("event_id")


@query(
    "U7_purge_by_preset",
    """with a as (select event_id, ts, case event_id % 3 when 0 then 'sler_general' when 1 then 'nist_zta' else 'fss_kr' end as preset from v_audit),
       p as (select * from (values ('sler_general', 365), ('nist_zta', 2555), ('fss_kr', 3650)) as v(name, days))
       select event_id, preset from a join p on p.name = a.preset where cast(ts as date) >= date '2031-01-10' - p.days""",
)
def _(spark, d):
    a = audit(spark, d).withColumn("preset", F.expr("case event_id % 3 when 0 then 'sler_general' when 1 then 'nist_zta' else 'fss_kr' end"))
    return U.purge_by_preset(a, T.presets_frame(spark), "preset", "2031-01-10").select("event_id", "preset")


@query(
    "U8_check_range",
    """with p as (select event_id, case when event_id % 5 = 0 then null when event_id % 5 = 1 then 'soon' else cast(ts as string) end as f,
            cast(ts + interval 1 hour * (event_id % 3 - 1) as string) as t, ts, ts + interval 1 hour * (event_id % 3 - 1) as e from events)
       select event_id, case when event_id % 5 = 1 then 'unreadable' when event_id % 5 <> 0 and ts > e then 'start_after_end' else '' end as range_error from p""",
)
def _(spark, d):
    p = load(spark, d, "events").selectExpr(
        "event_id",
        "case when event_id % 5 = 0 then null when event_id % 5 = 1 then 'soon' else cast(ts as string) end as from_ts",
        "cast(ts + make_dt_interval(0, cast(event_id % 3 - 1 as int)) as string) as to_ts",
    )
    return U.check_range(p).select("event_id", "range_error")


@query(
    "U9_rest_audit_query",
    """with f as (select event_id, ts from v_audit where actor_id = 'user-12' and event_type = 'file_downloaded')
       select event_id, ts, (select count(*) from f) > 20 as has_more from f order by ts, event_id limit 10 offset 10""",
)
def _(spark, d):
    return U.rest_audit_query(audit(spark, d), user="user-12", action="file_downloaded", page=2, per=10).select("event_id", "ts", "has_more")


MIME = "case part_mod % 3 when 0 then 'application/pdf' when 1 then 'text/plain' else 'image/png' end"


@query(
    "U10_list_files",
    f"select file_id, filename, file_size from v_file where status = 'ready' and {MIME} = 'application/pdf' order by file_size desc, file_id limit 30 offset 60",
)
def _(spark, d):
    f = load(spark, d, "v_file").withColumn("mime_type", F.expr(MIME))
    return U.list_files(f, "ready", "application/pdf", "file_size", True, page=3, per=30).select("file_id", "filename", "file_size")


@query(
    "U11_event_hash",
    """with h as (select event_id, ts, sha256(concat('{"event_id":', event_id, ',"event_type":"', event_type, '","actor_id":"', actor_id, '"}')) as event_hash from v_audit),
       p as (select *, lag(event_hash) over (partition by cast(ts as date) order by ts, event_id) as prev from h)
       select event_id, event_hash, sha256(concat(coalesce(prev, ''), ':', event_hash)) as link_hash from p""",
)
def _(spark, d):
    return U.audit_hash(audit(spark, d), ["event_id", "event_type", "actor_id"]).select("event_id", "event_hash", "link_hash")


@query("U11_day_digest")
def _(spark, d):
    return U.day_digest(U.audit_hash(audit(spark, d)))


@query(
    "U11_day_roots",
    """with h as (select event_id, ts, sha256(concat('{"event_id":', event_id, ',"event_type":"', event_type, '","actor_id":"', actor_id, '"}')) as event_hash from v_audit),
       p as (select *, lag(event_hash) over (partition by cast(ts as date) order by ts, event_id) as prev from h),
       k as (select cast(ts as date) as event_date, sha256(concat(coalesce(prev, ''), ':', event_hash)) as link from p),
       o as (select event_date, link, count(*) as n from k group by 1, 2),
       l2 as (select event_date, link[1:2] as p, sum(n) as n, sha256(string_agg(concat(link, '*', n), ',' order by link)) as h from o group by 1, 2),
       l1 as (select event_date, p[1:1] as p, sum(n) as n, sha256(string_agg(h, ',' order by p)) as h from l2 group by 1, p[1:1])
       select event_date, cast(sum(n) as bigint) as events, sha256(string_agg(h, ',' order by p)) as root from l1 group by 1""",
)
def _(spark, d):
    return U.day_roots(U.audit_hash(audit(spark, d), ["event_id", "event_type", "actor_id"]), 2)


@query(
    "U12_custom_fields",
    """with p as (select unnest(['k', 'type']) as field, unnest([json_extract_string(props, '$.k'), event_type]) as v from events)
       select field, cast(count(*) as bigint) as events, cast(count(distinct v) as bigint) as distinct_values from p group by 1""",
)
def _(spark, d):
    e = load(spark, d, "events").select(
        F.map_concat(U.custom_fields_from_json(F.col("props")), F.create_map(F.lit("type"), F.col("event_type"))).alias("custom_fields")
    )
    return U.custom_fields(e)


@query(
    "U13_metric_counters",
    """select 'events_total' as metric, concat('event_type=', event_type, ',success=', case when success then 'true' else 'false' end) as labels, cast(count(*) as bigint) as value from v_audit group by 2""",
)
def _(spark, d):
    return U.metric_counters(audit(spark, d), "events_total", ["event_type", "success"])


@query(
    "U14_duration_summary",
    """select event_type, cast(count(processing_time_ms) as bigint) as n, cast(sum(processing_time_ms) as bigint) as sum_ms,
         cast(sum(processing_time_ms) // count(processing_time_ms) as bigint) as mean_ms, max(processing_time_ms) as max_ms from v_audit group by 1""",
)
def _(spark, d):
    return U.duration_summary(audit(spark, d), ["event_type"], "processing_time_ms")


@query("U14_duration_median", "select event_type, quantile_disc(processing_time_ms, 0.5) as p50_ms from v_audit where processing_time_ms is not null group by 1")
def _(spark, d):
    return U.duration_median(audit(spark, d), ["event_type"], "processing_time_ms")


@query(
    "U15_top_actors",
    """with c as (select actor_id, cast(count(*) as bigint) as events from v_audit group by 1)
       select actor_id, events, cast(row_number() over (order by events desc, actor_id) as bigint) as rank from c order by events desc, actor_id limit 15""",
)
def _(spark, d):
    return U.top_actors(audit(spark, d), 15)


@query(
    "U15_sessions",
    """with p as (select actor_id, ts, event_id, lag(ts) over (partition by actor_id order by ts, event_id) as pv from v_audit),
       n as (select *, sum(case when pv is null or ts - pv >= interval 6 hours then 1 else 0 end) over (partition by actor_id order by ts, event_id) as s from p)
       select actor_id, min(ts) as session_start, max(ts) as session_end, cast(count(*) as bigint) as events from n group by actor_id, s""",
)
def _(spark, d):
    return U.sessions(audit(spark, d), "actor_id", ["ts", "event_id"], "ts", 6 * 3600).drop("session_no")
