"""Approval and file lifecycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewall.operators import lifecycle as L
from tidewall.plans.catalog import query
from tidewall.plans.views import load

ORDER = ["ts", "event_id"]
NOW = "1997-01-01 00:00:00"
LEGAL = "('pending_approval>approved', 'pending_approval>rejected', 'pending_approval>expired', 'approved>transferring', 'transferring>completed', 'transferring>failed')"


def log(spark, d):
    return load(spark, d, "v_transfer_event")


@query(
    "L1_valid_transitions",
    f"""with p as (select event_id, request_id, status, coalesce(lag(status) over (partition by request_id order by ts, event_id), 'pending_approval') as from_status from v_transfer_event)
        select event_id, request_id, from_status, status, concat(from_status, '>', status) in {LEGAL} as is_legal from p""",
)
def _(spark, d):
    return L.valid_transitions(log(spark, d), "request_id", ORDER, "status", "ts").select(
        "event_id", "request_id", "from_status", "status", "is_legal"
    )


def many_requests(spark, d):
    """Short logs that get somewhere: one request per user and day."""
    return log(spark, d).withColumn("request_id", F.expr("request_id * 100 + day(ts)"))


@query(
    "L2_replay_state",
    """with recursive e as (select event_id, user_id * 100 + day(ts) as request_id, row_number() over (partition by user_id * 100 + day(ts) order by ts, event_id) as n,
           case event_type when 'signup' then 'approved' when 'view' then 'transferring' when 'click' then 'rejected' when 'purchase' then 'completed' else 'failed' end as status from events),
       w as (select request_id, cast(0 as bigint) as n, cast(null as bigint) as event_id, '' as status, '' as state_before, 'pending_approval' as state_after, false as accepted from (select distinct request_id from e) x
         union all
         select w.request_id, e.n, e.event_id, e.status, w.state_after, case when concat(w.state_after, '>', e.status) in LEGALSET then e.status else w.state_after end,
           concat(w.state_after, '>', e.status) in LEGALSET
         from w join e on e.request_id = w.request_id and e.n = w.n + 1)
       select event_id, request_id, status, state_before, state_after, accepted from w where n > 0""".replace("LEGALSET", LEGAL),
)
def _(spark, d):
    out = L.replay_state(many_requests(spark, d), "request_id", ORDER, "status")
    return out.select("event_id", "request_id", "status", "state_before", "state_after", "accepted")


@query(
    "L2_final_states",
    """with recursive e as (select user_id * 100 + day(ts) as request_id, row_number() over (partition by user_id * 100 + day(ts) order by ts, event_id) as n,
           case event_type when 'signup' then 'approved' when 'view' then 'transferring' when 'click' then 'rejected' when 'purchase' then 'completed' else 'failed' end as status from events),
       w as (select request_id, cast(0 as bigint) as n, 'pending_approval' as s, cast(0 as bigint) as refused from (select distinct request_id from e) x
         union all
         select w.request_id, e.n, case when concat(w.s, '>', e.status) in LEGALSET then e.status else w.s end,
           w.refused + case when concat(w.s, '>', e.status) in LEGALSET then 0 else 1 end
         from w join e on e.request_id = w.request_id and e.n = w.n + 1)
       select request_id, arg_max(s, n) as state, max(refused) as refused from w group by 1""".replace("LEGALSET", LEGAL),
)
def _(spark, d):
    out = L.replay_state(many_requests(spark, d), "request_id", ORDER, "status")
    return L.final_states(out, "request_id", ORDER)


@query(
    "L3_terminal_active",
    "select event_id, status, status in ('completed', 'rejected', 'failed', 'expired') as terminal, status in ('pending_approval', 'approved', 'transferring') as active from v_transfer_event",
)
def _(spark, d):
    s = F.col("status")
    return log(spark, d).select("event_id", "status", L.is_terminal(s).alias("terminal"), L.is_active(s).alias("active"))


@query(
    "L4_expire_pending",
    f"select request_id, case when status = 'pending_approval' and expires_at < timestamp '{NOW}' then 'expired' else status end as status from v_transfer",
)
def _(spark, d):
    return L.expire_pending(load(spark, d, "v_transfer"), F.lit(NOW).cast("timestamp_ntz")).select("request_id", "status")


@query("L5_pending_for", "select request_id, applicant_id from v_transfer where status = 'pending_approval' and approver_id = 'approver-3'")
def _(spark, d):
    return L.pending_for(load(spark, d, "v_transfer"), "approver-3").select("request_id", "applicant_id")


@query(
    "L6_list_transfers",
    """select request_id, created_at, (select cast(count(*) as bigint) from v_transfer where status = 'completed') as total_count
       from v_transfer where status = 'completed' order by created_at desc, request_id limit 25 offset 50""",
)
def _(spark, d):
    t = load(spark, d, "v_transfer").select("request_id", "created_at", "status")
    return L.list_transfers(t, [F.desc("created_at"), F.asc("request_id")], "completed", page=3, per=25).drop("status")


FILE_LEGAL = "(f = 'pending_approval' and t in ('approved', 'rejected')) or (f = 'approved' and t = 'transferring') or (f = 'transferring' and t = 'ready') or (f = 'ready' and t = 'downloaded') or (t = 'failed' and f <> 'failed')"
FILE_STEP = """case event_id % 6 when 0 then 'pending_approval' when 1 then 'approved' when 2 then 'transferring' when 3 then 'ready' when 4 then 'rejected' else 'failed' end as f,
  case user_id % 5 when 0 then 'approved' when 1 then 'transferring' when 2 then 'ready' when 3 then 'downloaded' else 'failed' end as t"""


@query("L7_legal_file_moves", f"with q as (select event_id, {FILE_STEP} from events) select event_id, f, t from q where {FILE_LEGAL}")
def _(spark, d):
    return L.legal_file_moves(load(spark, d, "events").selectExpr("event_id", FILE_STEP.split(",\n")[0], FILE_STEP.split(",\n")[1]), "f", "t")


@query(
    "L8_apply_callbacks",
    """with e as (select event_id, user_id as file_no, case event_type when 'error' then 'Rejected' when 'view' then 'Approved' else 'Done' end as payload_status from events),
       s as (select c_custkey as file_no, case c_custkey % 3 when 0 then 'pending_approval' when 1 then 'approved' else 'ready' end as state from customer where c_custkey % 5 <> 0),
       j as (select e.*, s.state, case payload_status when 'Approved' then 'approved' when 'Rejected' then 'rejected' end as target from e left join s on s.file_no = e.file_no)
       select event_id, case when target is null then 'bad_status' when state is null then 'unknown_file' when state = target then 'unchanged'
         when state = 'pending_approval' then 'applied' else 'illegal' end as outcome from j""",
)
def _(spark, d):
    e = load(spark, d, "events").selectExpr(
        "event_id", "user_id as file_no", "case event_type when 'error' then 'Rejected' when 'view' then 'Approved' else 'Done' end as payload_status"
    )
    s = load(spark, d, "customer").where("c_custkey % 5 <> 0").selectExpr(
        "c_custkey as file_no", "case c_custkey % 3 when 0 then 'pending_approval' when 1 then 'approved' else 'ready' end as state"
    )
    return L.apply_callbacks(e, s, "file_no").select("event_id", "outcome")


NAMES = "concat(case event_id % 4 when 0 then 'ok_' when 1 then 'no_' when 2 then 'ok_' else '' end, case when event_id % 9 = 0 then '' else cast(event_id as string) end, case event_id % 4 when 0 then '.done' when 2 then '.txt' else '.done' end)"


@query(
    "L9_classify_filename",
    f"""with n as (select event_id, {NAMES} as name from events)
        select event_id, name, case when regexp_matches(name, '^(ok|no)_.+\\.done$') then regexp_extract(name, '^(ok|no)_(.+)\\.done$', 2) end as decided_file_id,
          case when regexp_matches(name, '^ok_.+\\.done$') then 'approved' when regexp_matches(name, '^no_.+\\.done$') then 'rejected' end as target_state from n""",
)
def _(spark, d):
    return L.classify_filename(load(spark, d, "events").selectExpr("event_id", f"{NAMES} as name"), "name", "ok_{file_id}.done", "no_{file_id}.done")


MOVES = [("new", "view", "open"), ("new", "click", "queued"), ("open", "click", "edited"), ("open", "click", "never"), ("edited", "purchase", "sold"), ("open", "error", "broken")]


@query(
    "L10_resolve_trigger",
    """with e as (select event_id, event_type, case user_id % 3 when 0 then 'new' when 1 then 'open' else 'edited' end as state from events)
       select event_id, state, event_type, case concat(state, '/', event_type) when 'new/view' then 'open' when 'new/click' then 'queued' when 'open/click' then 'edited'
         when 'edited/purchase' then 'sold' when 'open/error' then 'broken' end as to_state from e""",
)
def _(spark, d):
    e = load(spark, d, "events").selectExpr("event_id", "event_type", "case user_id % 3 when 0 then 'new' when 1 then 'open' else 'edited' end as state")
    return L.resolve_trigger(e, MOVES, "state", "event_type")


@query(
    "L11_select_approvers",
    """with r as (select c_custkey as request_id, c_custkey % 4 as template_id, concat('dept-', cast(c_nationkey as string)) as department from customer),
       m as (select s_suppkey as uid, case s_suppkey % 3 when 0 then 'Admin' when 1 then 'Auditor' else 'Clerk' end as role from supplier),
       f as (select r.request_id, concat('user-', cast(m.uid as string)) as approver_id from r join m on m.role in ('Admin') where r.template_id = 0
         union all select r.request_id, concat('head-', cast(n_nationkey as string)) from r join nation on concat('dept-', cast(n_nationkey as string)) = r.department where r.template_id = 1 and n_nationkey % 2 = 0
         union all select r.request_id, 'boss' from r where r.template_id = 2 union all select r.request_id, 'deputy' from r where r.template_id = 2)
       select request_id, approver_id, cast(null as string) as error from f
       union all select request_id, null, 'no_approvers' from r where request_id not in (select request_id from f)""",
)
def _(spark, d):
    r = load(spark, d, "customer").selectExpr("c_custkey as request_id", "c_custkey % 4 as template_id", "concat('dept-', cast(c_nationkey as string)) as department")
    t = spark.createDataFrame(
        [(0, "role", ["ADMIN"], None), (1, "department_head", None, None), (2, "custom", None, ["boss", "deputy"]), (3, "role", ["nobody"], None)],
        "template_id bigint, pool string, roles array<string>, user_ids array<string>",
    )
    m = load(spark, d, "supplier").selectExpr("case s_suppkey % 3 when 0 then 'Admin' when 1 then 'Auditor' else 'Clerk' end as role", "concat('user-', cast(s_suppkey as string)) as user_id")
    h = load(spark, d, "nation").selectExpr("concat('dept-', cast(n_nationkey as string)) as department", "case when n_nationkey % 2 = 0 then concat('head-', cast(n_nationkey as string)) else '' end as head_id")
    return L.select_approvers(r, t, m, h)


@query(
    "L12_tally_votes",
    """with f as (select request_id, approver_id, arg_min(approved, struct_pack(a := voted_at, b := event_id)) as approved, min(struct_pack(a := voted_at, b := event_id)) as k from v_vote group by 1, 2),
       r as (select *, 1 + request_id % 4 as need, row_number() over (partition by request_id order by k) as seq,
               sum(case when approved then 1 else 0 end) over (partition by request_id order by k) as yes,
               sum(case when approved then 0 else 1 end) over (partition by request_id order by k) as no from f),
       c as (select *, yes >= need or no > 0 as closing from r),
       z as (select request_id, min(seq) filter (where closing) as close_seq from c group by 1)
       select c.request_id, coalesce(max(case when c.seq = z.close_seq then case when c.no > 0 then 'rejected' else 'approved' end end), 'pending') as status,
         cast(count(*) filter (where c.approved) as bigint) as approvals, cast(count(*) as bigint) as counted_votes, max(case when c.seq = z.close_seq then c.k.a end) as closed_at
       from c join z on z.request_id = c.request_id where z.close_seq is null or c.seq <= z.close_seq group by 1""",
)
def _(spark, d):
    votes = load(spark, d, "v_vote")
    asked = votes.select("request_id").distinct().withColumn("required_approvers", F.col("request_id") % 4 + 1)
    return L.tally_votes(votes, asked)


@query(
    "L13_timeout_requests",
    f"""select request_id, case when status = 'pending_approval' and expires_at < timestamp '{NOW}' then case when applicant_id % 2 = 0 then 'escalated' else 'timed_out' end else status end as status from v_transfer""",
)
def _(spark, d):
    t = load(spark, d, "v_transfer").withColumn("escalate", F.col("applicant_id") % 2 == 0)
    return L.timeout_requests(t, F.lit(NOW).cast("timestamp_ntz")).select("request_id", "status")


@query(
    "L14_pending_by_approver",
    """with x as (select distinct request_id, a from (select request_id, unnest([approver_id, concat('approver-', cast(request_id % 5 as string)), 'deputy']) as a from v_transfer where status = 'pending_approval') y)
       select a as approver_id, cast(count(*) as bigint) as pending_requests from x group by 1""",
)
def _(spark, d):
    t = load(spark, d, "v_transfer").withColumn(
        "approvers", F.array("approver_id", F.expr("concat('approver-', cast(request_id % 5 as string))"), F.lit("deputy"))
    )
    return L.pending_by_approver(t)


@query(
    "L15_lifecycle_metrics",
    """with n as (select status, ts, lead(ts) over (partition by request_id order by ts, event_id) as nx from v_transfer_event),
       s as (select status, cast(epoch(date_trunc('second', nx)) - epoch(date_trunc('second', ts)) as bigint) as sec from n)
       select status, cast(count(*) as bigint) as entered, cast(count(sec) as bigint) as left_count, cast(sum(sec) as bigint) as total_seconds, max(sec) as max_seconds from s group by 1""",
)
def _(spark, d):
    return L.lifecycle_metrics(log(spark, d), "request_id", ORDER, "status", "ts")


@query("L15_approvals_per_day", "select strftime(ts, '%Y-%m-%d') as day, cast(count(*) as bigint) as approvals from v_transfer_event where status = 'approved' group by 1")
def _(spark, d):
    return L.approvals_per_day(log(spark, d), "status", "ts").withColumn("day", F.col("day").cast("string"))


@query(
    "L15_median_time_in_state",
    """with n as (select status, ts, lead(ts) over (partition by request_id order by ts, event_id) as nx from v_transfer_event),
       s as (select status, cast(epoch(date_trunc('second', nx)) - epoch(date_trunc('second', ts)) as bigint) as sec from n)
       select status, quantile_disc(sec, 0.5) as median_seconds from s where sec is not null group by 1""",
)
def _(spark, d):
    return L.median_time_in_state(log(spark, d), "request_id", ORDER, "status", "ts")
