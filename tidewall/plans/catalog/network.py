"""Routes, breakers, limits, health, devices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewall.operators import network as N
from tidewall.plans.catalog import query
from tidewall.plans.views import load

HOPS = 4
ORDER = ["ts", "event_id"]

WALK = f"""
g as (select distinct from_node, to_node from v_edge),
walk as (
  select node_id as source, node_id as node, [node_id] as hops, 0 as depth from v_node
  union all
  select w.source, g.to_node, list_append(w.hops, g.to_node), w.depth + 1 from walk w join g on g.from_node = w.node
  where w.depth < {HOPS} and not list_contains(w.hops, g.to_node)),
best as (select source, node as target, arg_min(hops, struct_pack(d := depth, h := hops)) as hops, min(depth) as depth from walk group by 1, 2),
asked as (select * from v_route),
answer as (select a.source, a.target, case when a.target not in (select node_id from v_node) or a.source not in (select node_id from v_node) then 'unknown_node' when b.hops is null then 'no_path' else 'ok' end as status,
   cast(coalesce(b.depth, -1) as bigint) as total_hops, coalesce(b.hops, []) as hops from asked a left join best b on b.source = a.source and b.target = a.target)
"""


def nodes(spark, d):
    return load(spark, d, "v_node")


def edges(spark, d):
    return load(spark, d, "v_edge")


def pairs(spark, d):
    return load(spark, d, "v_route")


@query(
    "N1_validate_topology",
    """with e as (select from_node, to_node + case when from_node % 7 = 0 then 20 else 0 end as to_node from v_edge),
       n as (select node_id from v_node union all select node_id from v_node where node_id % 6 = 0)
       select 'unknown_target' as violation, from_node, to_node, to_node as node_id from e where to_node not in (select node_id from v_node)
       union all select 'unknown_source', from_node, to_node, from_node from e where from_node not in (select node_id from v_node)
       union all select 'duplicate_node', null, null, node_id from n group by node_id having count(*) > 1""",
)
def _(spark, d):
    e = edges(spark, d).withColumn("to_node", F.expr("to_node + case when from_node % 7 = 0 then 20 else 0 end"))
    n = nodes(spark, d).select("node_id")
    return N.validate_topology(n.unionByName(n.where("node_id % 6 = 0")), e.select("from_node", "to_node"))


@query(
    "N2_shortest_path",
    f"with recursive {WALK} select source, target, status, total_hops, array_to_string(hops, '>') as hops from answer",
)
def _(spark, d):
    p = N.shortest_path(nodes(spark, d), edges(spark, d), pairs(spark, d), HOPS)
    return p.withColumn("hops", N.hops_text(F.col("hops")))


@query(
    "N3_path_flags",
    f"""with recursive {WALK}, l as (select source, target, hops[i] as f, hops[i + 1] as t from answer, unnest(range(1, len(hops))) as u(i)),
        r as (select l.source, l.target, bool_or(e.require_encryption) as enc, bool_or(e.require_approval) as app from l join v_edge e on e.from_node = l.f and e.to_node = l.t group by 1, 2)
        select a.source, a.target, a.total_hops, cast(greatest(a.total_hops, 0) * 10 as bigint) as latency_ms, coalesce(r.enc, false) as requires_encryption, coalesce(r.app, false) as requires_approval
        from answer a left join r on r.source = a.source and r.target = a.target""",
)
def _(spark, d):
    p = N.shortest_path(nodes(spark, d), edges(spark, d), pairs(spark, d), HOPS)
    return N.path_flags(p, edges(spark, d), ["source", "target"])


@query(
    "N4_local_egress",
    f"""with recursive {WALK}, loc as (select a.source, a.target from asked a join g on g.from_node = a.source and g.to_node = a.target where a.source % 2 = 0)
        select a.source, a.target, case when l.source is not null then 'local_egress' else a.status end as via, case when l.source is not null then 1 else a.total_hops end as total_hops,
          case when l.source is not null then concat(a.source, '>', a.target) else array_to_string(a.hops, '>') end as hops
        from answer a left join loc l on l.source = a.source and l.target = a.target""",
)
def _(spark, d):
    own = edges(spark, d).where("from_node % 2 = 0").select(F.col("from_node").alias("node_id"), F.col("to_node").alias("target"))
    return N.egress_first(nodes(spark, d), edges(spark, d), pairs(spark, d), own, HOPS).withColumn("hops", N.hops_text(F.col("hops")))


@query(
    "N5_hub_path",
    f"""with recursive {WALK}, h as (select * from (values (7, 0), (3, 1)) as v(hub, o)),
        x as (select a.source, a.target, h.hub, h.o, list_concat(b1.hops, b2.hops[2:]) as hops, b1.depth + b2.depth as n from asked a, h
          join best b1 on b1.target = h.hub join best b2 on b2.source = h.hub where b1.source = a.source and b2.target = a.target)
        select source, target, cast(arg_min(hub, n * 10 + o) as bigint) as hub, cast(min(n) as bigint) as total_hops, array_to_string(arg_min(hops, n * 10 + o), '>') as hops from x group by 1, 2""",
)
def _(spark, d):
    p = N.hub_path(nodes(spark, d), edges(spark, d), pairs(spark, d), [7, 3], HOPS)
    return p.withColumn("hops", N.hops_text(F.col("hops")))


@query(
    "N6_validate_path",
    """with p as (select c_custkey as path_id, case c_custkey % 5 when 0 then []::bigint[] when 1 then [source, source * 3 + 1] when 2 then [source, source + 5, source + 10]
           when 3 then [1, 4, 13, 15, 21, 14] else [source, source + 6] end as hops from (select c_custkey, cast(c_nationkey as bigint) as source from customer) q),
       l as (select path_id, hops[i] as f, hops[i + 1] as t from p, unnest(range(1, len(hops))) as u(i)),
       b as (select distinct path_id from l where (f, t) not in (select from_node, to_node from v_edge))
       select p.path_id, case when len(hops) = 0 then 'empty' when len(hops) - 1 > 4 then 'too_long' when b.path_id is not null then 'missing_edge' else 'ok' end as verdict from p left join b on b.path_id = p.path_id""",
)
def _(spark, d):
    p = load(spark, d, "customer").selectExpr("c_custkey", "cast(c_nationkey as bigint) as source").selectExpr(
        "c_custkey as path_id",
        """case c_custkey % 5 when 0 then cast(array() as array<bigint>) when 1 then array(source, source * 3 + 1) when 2 then array(source, source + 5, source + 10)
           when 3 then array(1L, 4L, 13L, 15L, 21L, 14L) else array(source, source + 6) end as hops""",
    )
    return N.validate_path(p, edges(spark, d), "path_id", HOPS)


@query(
    "N7_edges_of",
    """with o as (select from_node as node_id, count(*) as a from v_edge where to_node % 4 <> 0 group by 1), i as (select to_node as node_id, count(*) as b from v_edge where to_node % 4 <> 0 group by 1)
       select coalesce(o.node_id, i.node_id) as node_id, cast(coalesce(a, 0) as bigint) as out_edges, cast(coalesce(b, 0) as bigint) as in_edges from o full outer join i on o.node_id = i.node_id""",
)
def _(spark, d):
    return N.edges_of(edges(spark, d).where("to_node % 4 <> 0"))


def reports(spark, d):
    """Reports on nodes: node, time, outcome."""
    return load(spark, d, "events").selectExpr("event_id", "user_id % 25 as node_id", "ts", "event_type <> 'error' and event_type <> 'view' as ok")


@query("N8_healthy_nodes", "select node_id, cast(tier as bigint) as tier from v_node where health <> 'unhealthy' and node_id % 5 <> 2")
def _(spark, d):
    shut = nodes(spark, d).selectExpr("node_id", "case when node_id % 5 = 2 then 'open' else 'closed' end as state")
    return N.healthy_nodes(nodes(spark, d), shut).select("node_id", F.col("tier").cast("bigint").alias("tier"))


@query(
    "N9_circuit_states",
    """with recursive e as (select event_id, user_id % 25 as node_id, ts, event_type not in ('error', 'view') as ok, row_number() over (partition by user_id % 25 order by ts, event_id) as n from events),
       w as (select node_id, cast(0 as bigint) as n, cast(null as bigint) as event_id, 0 as f, 'closed' as m, timestamp '2000-01-01' as since from (select distinct node_id from e) x
         union all
         select e.node_id, e.n, e.event_id, case when e.ok then 0 else w.f + 1 end,
           case when e.ok then case when w.m = 'open' and e.ts - w.since < interval 90 minutes then 'open' else 'closed' end
             when w.m = 'open' then 'open' when w.f + 1 >= 3 then 'open' else 'closed' end,
           case when not e.ok and ((w.m = 'open' and e.ts - w.since >= interval 90 minutes) or (w.m = 'closed' and w.f + 1 >= 3)) then e.ts else w.since end
         from w join e on e.node_id = w.node_id and e.n = w.n + 1)
       select event_id, m as state, cast(f as bigint) as failures from w where n > 0""",
)
def _(spark, d):
    out = N.circuit_states(reports(spark, d), "node_id", ORDER, "ok", "ts", threshold=3, heartbeat_seconds=1800)
    return out.select("event_id", "state", "failures")


@query(
    "N9_circuit_users",
    """with recursive e as (select event_id, user_id as node_id, ts, event_type not in ('error', 'view') as ok, row_number() over (partition by user_id order by ts, event_id) as n from events),
       w as (select node_id, cast(0 as bigint) as n, cast(null as bigint) as event_id, 0 as f, 'closed' as m, timestamp '2000-01-01' as since from (select distinct node_id from e) x
         union all
         select e.node_id, e.n, e.event_id, case when e.ok then 0 else w.f + 1 end,
           case when e.ok then case when w.m = 'open' and e.ts - w.since < interval 90 minutes then 'open' else 'closed' end
             when w.m = 'open' then 'open' when w.f + 1 >= 3 then 'open' else 'closed' end,
           case when not e.ok and ((w.m = 'open' and e.ts - w.since >= interval 90 minutes) or (w.m = 'closed' and w.f + 1 >= 3)) then e.ts else w.since end
         from w join e on e.node_id = w.node_id and e.n = w.n + 1)
       select event_id, m as state, cast(f as bigint) as failures from w where n > 0""",
)
def _(spark, d):
    e = load(spark, d, "events").selectExpr("event_id", "user_id", "ts", "event_type not in ('error', 'view') as ok")
    return N.circuit_states(e, "user_id", ORDER, "ok", "ts", threshold=3, heartbeat_seconds=1800).select("event_id", "state", "failures")


@query(
    "N10_failure_runs",
    """with e as (select event_id, user_id % 25 as node_id, ts, event_type not in ('error', 'view') as ok from events),
       r as (select *, row_number() over (partition by node_id order by ts, event_id) - row_number() over (partition by node_id, ok order by ts, event_id) as g from e)
       select node_id, min(ts) as run_start, max(ts) as run_end, cast(count(*) as bigint) as failures from r where not ok group by node_id, g having count(*) >= 3""",
)
def _(spark, d):
    return N.failure_runs(reports(spark, d), "node_id", ORDER, "ok", "ts", min_length=3)


@query(
    "N11_transfer_result",
    """select session_id, cast(count(*) filter (where ok) as bigint) as chunks_ok, cast(count(*) filter (where not ok) as bigint) as chunks_failed,
         cast((1 + session_id % 3) * 10 as bigint) as latency_ms, bool_and(ok) as success from v_chunk_ack group by session_id""",
)
def _(spark, d):
    ack = load(spark, d, "v_chunk_ack").withColumn("path_hops", 1 + F.col("session_id") % 3)
    return N.transfer_result(ack, ["session_id"], "ok", "path_hops")


@query(
    "N12_rate_limit",
    """with recursive e as (select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) as n from events),
       w as (select user_id, cast(0 as bigint) as n, cast(null as bigint) as event_id, []::timestamp[] as seen, false as allowed from (select distinct user_id from e) x
         union all
         select e.user_id, e.n, e.event_id, case when len(k.live) < 3 then list_append(k.live, e.ts) else k.live end, len(k.live) < 3
         from w join e on e.user_id = w.user_id and e.n = w.n + 1, lateral (select list_filter(w.seen, lambda s: s > e.ts - interval 12 hours) as live) k)
       select event_id, allowed, cast(case when allowed then 3 - len(seen) else 0 end as bigint) as remaining from w where n > 0""",
)
def _(spark, d):
    e = load(spark, d, "events").select("event_id", "user_id", "ts")
    return N.rate_limit(e, "user_id", ORDER, "ts", 3, 12 * 3600).select("event_id", "allowed", "remaining")


@query("N12_limit_zero", "select event_id, false as allowed, cast(0 as bigint) as remaining from events")
def _(spark, d):
    e = load(spark, d, "events").select("event_id", "user_id", "ts")
    return N.rate_limit(e, "user_id", ORDER, "ts", 0, 3600).select("event_id", "allowed", "remaining")


@query(
    "N13_trailing_rate",
    """select event_id, cast(count(*) over (partition by user_id order by ts range between interval '21599.999999 seconds' preceding and current row) as bigint) as requests_in_window from events""",
)
def _(spark, d):
    e = load(spark, d, "events").select("event_id", "user_id", "ts")
    return N.trailing_rate(e, "user_id", "ts", 6 * 3600, "event_id").select("event_id", "requests_in_window")


@query(
    "N14_hourly_limit",
    """with recursive e as (select event_id, user_id, ts, user_id % 3 as lim, row_number() over (partition by user_id order by ts, event_id) as n from events where user_id % 9 <> 0),
       w as (select user_id, cast(0 as bigint) as n, cast(null as bigint) as event_id, []::timestamp[] as seen, false as allowed from (select distinct user_id from e) x
         union all
         select e.user_id, e.n, e.event_id, case when e.lim > 0 and len(k.live) < e.lim then list_append(k.live, e.ts) else k.live end, e.lim = 0 or len(k.live) < e.lim
         from w join e on e.user_id = w.user_id and e.n = w.n + 1, lateral (select list_filter(w.seen, lambda s: s > e.ts - interval 1 hours) as live) k)
       select event_id, allowed from w where n > 0 union all select event_id, false from events where user_id % 9 = 0""",
)
def _(spark, d):
    e = load(spark, d, "events").select("event_id", "user_id", "ts")
    acc = e.select("user_id").distinct().where("user_id % 9 <> 0").withColumn("hourly_limit", F.col("user_id") % 3)
    return N.hourly_limit(e, acc, "user_id", ORDER, "ts").select("event_id", "allowed")


STATUS = "case event_id % 50 when 0 then 'unhealthy' when 1 then 'degraded' when 2 then 'unknown' else 'healthy' end"


@query(
    "N15_overall_health",
    f"""with c as (select user_id, strftime(ts, '%Y-%m-%d') as day, {STATUS} as status from events)
        select user_id, day, case when bool_or(status = 'unhealthy') then 'unhealthy' when bool_or(status in ('degraded', 'unknown')) then 'degraded' else 'healthy' end as overall from c group by 1, 2""",
)
def _(spark, d):
    c = load(spark, d, "events").selectExpr("user_id", "cast(to_date(ts) as string) as day", f"{STATUS} as status")
    return N.overall_health(c, ["user_id", "day"])


@query(
    "N16_posture_score",
    """with p as (select *, not (patch_compliant and critical_patches_missing = 0) as bad, critical_patches_missing > 0 as crit from v_posture),
       s as (select device_id, 100 - case when os_supported then 0 else 30 end - case when antivirus_enabled then 0 else 25 end - case when crit then 20 when bad then 10 else 0 end - case when edr_present then 0 else 5 end as score,
           concat_ws(',', case when not os_supported then 'os_version' end, case when not antivirus_enabled then 'antivirus' end, case when crit then 'patch_compliance' end) as failed_critical from p)
       select device_id, cast(greatest(0, score) as bigint) as score, failed_critical, case when failed_critical <> '' then 'block' when score < 90 then 'warn' else 'allow' end as action, failed_critical = '' as allowed from s""",
)
def _(spark, d):
    out = N.posture_score(load(spark, d, "v_posture"), min_score=90, failure_action="warn")
    return out.select("device_id", "score", "failed_critical", "action", "allowed")


@query(
    "N17_fingerprint_similarity",
    """with s as (select c_custkey, 0.4 * cast(c_custkey % 3 <> 0 as int) + case when c_custkey % 4 = 0 then 0 else 0.3 * cast(c_custkey % 5 <> 0 as int) end + 0.3 * cast(c_custkey % 7 <> 0 as int) as m,
         case when c_custkey % 4 = 0 then 0.7 else 1.0 end as t from customer)
       select c_custkey, round(cast(m / t as double), 9) as similarity, round(cast(m / t as double), 9) >= 0.7 as same_device from s""",
)
def _(spark, d):
    c = load(spark, d, "customer")
    a = c.selectExpr("c_custkey", "md5(c_name) as user_agent", "case when c_custkey % 4 = 0 then null else md5(c_mktsegment) end as canvas_hash", "'1920x1080' as screen")
    b = c.selectExpr(
        "c_custkey", "case when c_custkey % 3 = 0 then 'other' else md5(c_name) end as user_agent",
        "case when c_custkey % 5 = 0 then 'other' else md5(c_mktsegment) end as canvas_hash", "case when c_custkey % 7 = 0 then '800x600' else '1920x1080' end as screen",
    )
    return N.fingerprint_similarity(a, b, "c_custkey").withColumn("similarity", F.round("similarity", 9))
