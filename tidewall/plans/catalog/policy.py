"""Access decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewall.functions.net import ip_to_long
from tidewall.operators import policy as A
from tidewall.plans.catalog import query
from tidewall.plans.views import load

C, R = A.Condition, A.PolicyRule
RULES = [
    R("permit-staff-lan", "permit", (C("role", "in", ("staff", "manager", "security_officer")), C("ip_address", "cidr", "10.0.0.0/8")), 50,
      obligation=A.Obligation("log")),
    R("permit-admin", "permit", (C("role", "eq", "admin"),), 90, obligation=A.Obligation("notify", 1, ("soc@corp.example", "dpo@corp.example"))),
    R("deny-secret-guest", "deny", (C("data_classification", "eq", "secret"), C("role", "eq", "guest")), 10),
    R("deny-big", "deny", (C("file_size_bytes", "gt", 95000),), 70),
    R("permit-mfa-hours", "permit", (C("mfa_verified", "eq", True), C("ts", "time_window", ((9, 0), (17, 30))), C("ts", "day_mask", A.day_mask(range(1, 6)))), 50),
    R("deny-odd-net", "deny", (C("ip_address", "regex", r"^203\.0\.1[0-9]\."), C("department", "neq", "it")), 60),
    R("off", "deny", (), 99, enabled=False),
    R("permit-hr-small", "permit", (C("department", "eq", "hr"), C("file_size_bytes", "lt", 2000)), 40, obligation=A.Obligation("approve", 2, ("hr-head@corp.example",))),
]
ORDERED = ["permit-admin", "deny-big", "deny-odd-net", "permit-staff-lan", "permit-mfa-hours", "permit-hr-small", "deny-secret-guest"]
TESTS = {
    "permit-admin": "role = 'admin'",
    "deny-big": "file_size_bytes > 95000",
    "deny-odd-net": "ip_address similar to '203\\.0\\.1[0-9]\\..*' and department <> 'it'",
    "permit-staff-lan": "role in ('staff', 'manager', 'security_officer') and starts_with(ip_address, '10.')",
    "permit-mfa-hours": "mfa_verified and hour(ts) * 60 + minute(ts) >= 540 and hour(ts) * 60 + minute(ts) < 1050 and isodow(ts) <= 5",
    "permit-hr-small": "department = 'hr' and file_size_bytes < 2000",
    "deny-secret-guest": "data_classification = 'secret' and role = 'guest'",
}
PRIORITY = {r.id: r.priority for r in RULES}
HITS = " union all ".join(
    f"select request_id, {i + 1} as pos, '{n}' as rule_id, '{'deny' if n.startswith('deny') else 'permit'}' as effect, {PRIORITY[n]} as priority from v_access_request where {TESTS[n]}"
    for i, n in enumerate(ORDERED)
)
DECIDED = f"""
hits as ({HITS}),
b as (select request_id, min(pos) filter (where effect = 'deny') as dpos, arg_min(rule_id, pos) filter (where effect = 'deny') as did,
        arg_min(rule_id, pos) filter (where effect = 'permit') as pid from hits group by 1),
decided as (select r.*, case when b.did is not null then 'deny' when b.pid is not null then 'permit' else 'deny' end as effect,
    coalesce(b.did, b.pid) as matched_rule_id,
    case when b.did is null then case b.pid when 'permit-admin' then 'notify' when 'permit-staff-lan' then 'log' when 'permit-hr-small' then 'approve' end end as obligation,
    cast(coalesce(b.dpos, 7) as bigint) as evaluated_rules
  from v_access_request r left join b on b.request_id = r.request_id)
"""
OUT = ["request_id", "effect", "matched_rule_id", "obligation", "evaluated_rules"]


def requests(spark, d):
    return load(spark, d, "v_access_request")


def maybe(spark, d):
    """Requests with missing attributes."""
    return requests(spark, d).withColumn("role", F.expr("case when request_id % 11 = 0 then null else role end"))


MAYBE = "(select * replace (case when request_id % 11 = 0 then null else role end as role) from v_access_request) q"


@query("A1_cond_eq_neq", f"select request_id, coalesce(role = 'staff', false) as is_staff, coalesce(role <> 'staff', false) as not_staff from {MAYBE}")
def _(spark, d):
    r = F.col("role")
    return maybe(spark, d).select("request_id", A.cond_eq(r, "staff").alias("is_staff"), A.cond_neq(r, "staff").alias("not_staff"))


@query("A2_cond_in_not_in", f"select request_id, coalesce(role in ('staff', 'guest'), false) as listed, coalesce(role not in ('staff', 'guest'), false) as unlisted from {MAYBE}")
def _(spark, d):
    r = F.col("role")
    return maybe(spark, d).select("request_id", A.cond_in(r, ["staff", "guest"]).alias("listed"), A.cond_not_in(r, ["staff", "guest"]).alias("unlisted"))


@query("A3_cond_gt_lt", "select request_id, file_size_bytes > 50000.5 as big, file_size_bytes < 1000 as small from v_access_request")
def _(spark, d):
    s = F.col("file_size_bytes")
    return requests(spark, d).select("request_id", A.cond_gt(s, 50000.5).alias("big"), A.cond_lt(s, 1000).alias("small"))


@query("A4_cond_regex", f"select request_id, coalesce(regexp_matches(role, '^s.*(f|r)$'), false) as fits, false as broken from {MAYBE}")
def _(spark, d):
    r = F.col("role")
    return maybe(spark, d).select("request_id", A.cond_regex(r, "^s.*(f|r)$").alias("fits"), A.cond_regex(r, "(").alias("broken"))


OCTETS = "list_transform(string_split(ip_address, '.'), lambda x: cast(x as bigint))"


@query(
    "A5_cond_cidr",
    f"""with n as (select request_id, (({OCTETS})[1] * 16777216 + ({OCTETS})[2] * 65536 + ({OCTETS})[3] * 256 + ({OCTETS})[4]) as n from v_access_request)
        select request_id, n as ip_number, n >= 2886729728 and n <= 2887778303 as private_b, n // 65536 = 49320 as class_b, n // 64 = 3405774858 as tiny from n""",
)
def _(spark, d):
    ip = F.col("ip_address")
    return requests(spark, d).select(
        "request_id", ip_to_long(ip).alias("ip_number"), A.cond_cidr(ip, "172.16.0.0/12").alias("private_b"),
        A.cond_cidr(ip, "192.168.0.0/16").alias("class_b"), (F.floor(ip_to_long(ip) / 64) == 3405774858).alias("tiny"),
    )


@query(
    "A6_time_and_day",
    """select request_id, strftime(ts, '%H:%M') >= '08:15' and strftime(ts, '%H:%M') < '12:45' as morning, dayname(ts) in ('Saturday', 'Sunday') as weekend from v_access_request""",
)
def _(spark, d):
    ts = F.col("ts")
    return requests(spark, d).select(
        "request_id", A.in_time_window(ts, (8, 15), (12, 45)).alias("morning"), A.in_day_mask(ts, A.day_mask([6, 7])).alias("weekend")
    )


@query("A7_match_rules", f"select request_id, cast(pos as bigint) as rule_pos, rule_id, effect, cast(priority as bigint) as priority from ({HITS}) h")
def _(spark, d):
    return A.match_rules(requests(spark, d), "request_id", RULES)


@query("A8_abac_decide", f"with {DECIDED} select {', '.join(OUT)} from decided")
def _(spark, d):
    return A.abac_decide(requests(spark, d), RULES).select(*OUT)


CLEAR = "case role when 'admin' then 5 when 'security_officer' then 4 when 'manager' then 3 when 'staff' then 2 else 1 end"


@query("A9_resolve_subject", f"select request_id, cast({CLEAR} as bigint) as clearance_level, concat(department, '/', role) as group_name from v_access_request")
def _(spark, d):
    out = A.resolve_subject(requests(spark, d))
    return out.select("request_id", "clearance_level", F.get("group_membership", F.lit(0)).alias("group_name"))


@query(
    "A10_resolve_resource",
    "select request_id, data_classification, case when request_id % 2 = 0 then 'pdf' else 'docx' end as file_type, file_size_bytes, department as destination_zone, contains_pii from v_access_request",
)
def _(spark, d):
    src = requests(spark, d).withColumn("ext", F.expr("case when request_id % 2 = 0 then 'pdf' else 'docx' end"))
    return A.resolve_resource(src, "data_classification", "ext", "file_size_bytes", "department", "contains_pii").select(
        "request_id", "data_classification", "file_type", "file_size_bytes", "destination_zone", "contains_pii"
    )


@query(
    "A11_resolve_environment",
    """select request_id, strftime(ts, '%H:%M') as time_of_day, cast(isodow(ts) as bigint) as day_of_week, isodow(ts) <= 5 as business_day,
         case when regexp_matches(ip_address, '^(10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)') then 'corporate-lan' else 'unknown' end as source_network from v_access_request""",
)
def _(spark, d):
    return A.resolve_environment(requests(spark, d)).select("request_id", "time_of_day", "day_of_week", "business_day", "source_network")


@query(
    "A12_merge_attrs",
    "select request_id, concat('department=', department, ',role=', data_classification, ',user=', cast(user_id as string)) as attrs from v_access_request",
)
def _(spark, d):
    first = F.create_map(F.lit("role"), F.col("role"), F.lit("department"), F.col("department"))
    second = F.create_map(F.lit("role"), F.col("data_classification"), F.lit("user"), F.col("user_id").cast("string"))
    merged = F.array_sort(F.map_entries(A.merge_attrs(first, second)))
    return requests(spark, d).select(
        "request_id", F.array_join(F.transform(merged, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("attrs")
    )


EDITED = A.policy_enable(A.policy_remove(A.policy_add(RULES, R("deny-big", "deny", (C("file_size_bytes", "gt", 10**9),), 70)), "permit-admin"), "permit-hr-small", False)


@query(
    "A13_edited_rules",
    f"""with hits as (select * from ({HITS}) h where rule_id not in ('permit-admin', 'permit-hr-small', 'deny-big')),
        b as (select request_id, bool_or(effect = 'deny') as denied, bool_or(effect = 'permit') as permitted from hits group by 1)
        select r.request_id, case when b.denied then 'deny' when b.permitted then 'permit' else 'deny' end as effect from v_access_request r left join b on b.request_id = r.request_id""",
)
def _(spark, d):
    return A.abac_decide(requests(spark, d), EDITED).select("request_id", "effect")


@query(
    "A14_obligations",
    f"""with {DECIDED}, n as (select * from (values ('permit-staff-lan', 'log', 0, null), ('permit-admin', 'notify', 1, 'soc@corp.example'), ('permit-admin', 'notify', 1, 'dpo@corp.example'),
          ('permit-hr-small', 'approve', 2, 'hr-head@corp.example')) as v(rid, kind, approvers, notify))
        select d.request_id, d.matched_rule_id, n.kind, cast(n.approvers as bigint) as approvers, n.notify from decided d join n on n.rid = d.matched_rule_id where d.effect = 'permit'""",
)
def _(spark, d):
    return A.obligations(A.abac_decide(requests(spark, d), RULES), "request_id", RULES)


@query("A15_decide_distinct", f"with {DECIDED} select {', '.join(OUT)} from decided")
def _(spark, d):
    attrs = ["role", "ip_address", "data_classification", "file_size_bytes", "mfa_verified", "ts", "department"]
    return A.decide_distinct(requests(spark, d), attrs, RULES).select(*OUT)


@query(
    "A16_decision_audit",
    f"""with {DECIDED} select request_id as event_id, ts, case effect when 'deny' then 'security_violation' else 'transfer_requested' end as event_type,
          concat('user-', cast(user_id as string)) as actor_id, effect = 'permit' as success,
          case effect when 'deny' then concat('denied by ', coalesce(matched_rule_id, 'default')) end as error_message from decided""",
)
def _(spark, d):
    return A.decision_audit(A.abac_decide(requests(spark, d), RULES), "request_id", "user_id", "ts")


@query(
    "A17_policy_report",
    f"""with {DECIDED} select matched_rule_id, effect, role, cast(count(*) as bigint) as requests,
          cast(grouping(matched_rule_id) * 4 + grouping(effect) * 2 + grouping(role) as bigint) as grouping_id
        from decided group by grouping sets ((matched_rule_id), (effect, role), ())""",
)
def _(spark, d):
    return A.policy_report(A.abac_decide(requests(spark, d), RULES))


@query(
    "A18_role_permissions",
    """with q as (select request_id, case when role = 'admin' then 'admin' when role in ('manager', 'security_officer') then 'approver' else 'staff' end as grade,
           case request_id % 4 when 0 then 'file_upload' when 1 then 'transfer_approve' when 2 then 'audit_export' else 'audit_view' end as action from v_access_request)
       select request_id, grade, action from q where grade = 'admin' or action = 'file_upload' or (grade = 'approver' and action in ('transfer_approve', 'audit_view'))""",
)
def _(spark, d):
    q = requests(spark, d).selectExpr(
        "request_id",
        "case when role = 'admin' then 'admin' when role in ('manager', 'security_officer') then 'approver' else 'staff' end as grade",
        "case request_id % 4 when 0 then 'file_upload' when 1 then 'transfer_approve' when 2 then 'audit_export' else 'audit_view' end as action",
    )
    return A.can(q, "grade", "action")


@query(
    "A19_ip_allowlist",
    """select request_id from v_access_request
       where user_id % 3 = 0 or (user_id % 3 = 1 and (starts_with(ip_address, '10.0.') or starts_with(ip_address, '203.0.')))
          or (user_id % 3 = 2 and starts_with(ip_address, concat('192.168.', cast(user_id % 256 as string), '.')))""",
)
def _(spark, d):
    q = requests(spark, d)
    lists = q.select("user_id").distinct().where("user_id % 3 > 0").selectExpr(
        "user_id",
        "explode(case when user_id % 3 = 1 then array('10.0.0.0/16', '203.0.0.0/16') else array(concat('192.168.', cast(user_id % 256 as string), '.0/24')) end) as cidr",
    )
    return A.ip_allowlist(q, lists, "user_id", "ip_address").select("request_id")


@query(
    "A20_account_requirements",
    """select l_orderkey, l_linenumber, case when s_suppkey % 4 = 0 then 'none' else 'convert_to_flat' end as forced_policy,
         case when s_suppkey % 4 = 0 then false else s_acctbal > 5000 end as dual_approval,
         cast(case when s_suppkey % 4 = 0 then 1000000 else s_suppkey * 1000 end as bigint) as max_file_size
       from lineitem join supplier on s_suppkey = l_suppkey""",
)
def _(spark, d):
    acc = load(spark, d, "supplier").where("s_suppkey % 4 <> 0").selectExpr(
        "s_suppkey as l_suppkey", "'convert_to_flat' as forced_policy", "s_acctbal > 5000 as dual_approval", "s_suppkey * 1000 as max_file_size"
    )
    return A.account_requirements(load(spark, d, "lineitem"), acc, "l_suppkey", 1000000).select(
        "l_orderkey", "l_linenumber", "forced_policy", "dual_approval", "max_file_size"
    )
