"""Attribute-based access decisions over batches of requests.

Rules are compiled to one boolean column each, so a decision is a projection: no join, no shuffle,
whatever the number of requests.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.functions.net import cidr_high, cidr_low, in_cidr, ip_to_long, network_class
from tidewall.functions.patterns import EMPTY_MATCH, regex_error
from tidewall.functions.rows import inline_rows
from tidewall.rules.pii import pattern_error


# ---- conditions: a missing attribute makes any condition false ----
def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def cond_eq(attr: Column, value) -> Column:
    return _known(attr == F.lit(value))


def cond_neq(attr: Column, value) -> Column:
    return _known(attr != F.lit(value))


def cond_in(attr: Column, values) -> Column:
    return _known(attr.isin(list(values))) if values else F.lit(False)


def cond_not_in(attr: Column, values) -> Column:
    return _known(~attr.isin(list(values))) if values else attr.isNotNull()


def cond_gt(attr: Column, value) -> Column:
    return _known(attr.cast("double") > F.lit(float(value)))


def cond_lt(attr: Column, value) -> Column:
    return _known(attr.cast("double") < F.lit(float(value)))


def cond_regex(attr: Column, pattern: str) -> Column:
    """An unusable pattern is false; it is checked here, by the engine that runs it, because it would fail the whole job."""
    if regex_error(pattern) not in (None, EMPTY_MATCH):
        return F.lit(False)
    return _known(attr.cast("string").rlike(pattern))


def cond_cidr(attr: Column, cidr: str) -> Column:
    return in_cidr(attr, cidr)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def in_time_window(ts: Column, start: tuple[int, int], end: tuple[int, int]) -> Column:
    """Half-open window of the day."""
    m = minute_of_day(ts)
    return _known((m >= start[0] * 60 + start[1]) & (m < end[0] * 60 + end[1]))


def day_mask(days) -> int:
    """Bit 0 is Monday."""
    return reduce(lambda a, d: a | (1 << (d - 1)), days, 0)


def in_day_mask(ts: Column, mask: int) -> Column:
    return _known(F.getbit(F.lit(mask), F.weekday(ts)) == 1)


@dataclass(frozen=True)
class Condition:
    """One test. ``op`` is eq, neq, in, not_in, gt, lt, regex, cidr, time_window or day_mask."""

    attr: str
    op: str
    value: object

    def column(self) -> Column:
        a = F.col(self.attr)
        if self.op == "time_window":
            return in_time_window(a, *self.value)
        return _OPS[self.op](a, self.value)


_OPS = {
    "eq": cond_eq,
    "neq": cond_neq,
    "in": cond_in,
    "not_in": cond_not_in,
    "gt": cond_gt,
    "lt": cond_lt,
    "regex": cond_regex,
    "cidr": cond_cidr,
    "day_mask": in_day_mask,
}


@dataclass(frozen=True)
class Obligation:
    kind: str
    approvers: int = 0
    notify: tuple[str, ...] = ()


@dataclass(frozen=True)
class PolicyRule:
    id: str
    effect: str
    conditions: tuple[Condition, ...] = ()
    priority: int = 0
    enabled: bool = True
    obligation: Obligation | None = field(default=None)

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [c.column() for c in self.conditions], F.lit(True))


def ordered_rules(rules: list[PolicyRule]) -> list[PolicyRule]:
    """Enabled rules, highest priority first, given order on ties."""
    return sorted((r for r in rules if r.enabled), key=lambda r: -r.priority)


def match_rules(requests: DataFrame, key: str, rules: list[PolicyRule]) -> DataFrame:
    """One row per request and matching rule."""
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    r.column(),
                    F.struct(
                        F.lit(i + 1).cast("bigint").alias("rule_pos"),
                        F.lit(r.id).alias("rule_id"),
                        F.lit(r.effect).alias("effect"),
                        F.lit(r.priority).cast("bigint").alias("priority"),
                    ),
                )
                for i, r in enumerate(ordered_rules(rules))
            ]
        )
    )
    return inline_rows(requests, [key], found, "rule_id")


def abac_decide(requests: DataFrame, rules: list[PolicyRule], default: str = "deny") -> DataFrame:
    """Add effect, matched_rule_id, obligation and evaluated_rules.

    A matching deny of any priority overrides every permit; without a deny the first matching permit
    decides; without either the default does. ``evaluated_rules`` is the position of the deciding
    deny, or the number of enabled rules.
    """
    ranked = ordered_rules(rules)
    flags = {f"__rule{i}": r.column() for i, r in enumerate(ranked)}
    staged = requests.withColumns(flags) if flags else requests

    def first(effect: str, value) -> Column:
        hits = [(F.col(f"__rule{i}"), value(i, r)) for i, r in enumerate(ranked) if r.effect == effect]
        return F.coalesce(*[F.when(c, v) for c, v in hits]) if hits else F.lit(None)

    deny = first("deny", lambda i, r: F.lit(r.id)).cast("string")
    permit = first("permit", lambda i, r: F.lit(r.id)).cast("string")
    deny_pos = first("deny", lambda i, r: F.lit(i + 1)).cast("bigint")
    duty = first("permit", lambda i, r: F.lit(r.obligation.kind if r.obligation else "none")).cast("string")
    staged = staged.withColumns({"__deny": deny, "__permit": permit, "__deny_pos": deny_pos, "__duty": duty})
    denied, permitted = F.col("__deny").isNotNull(), F.col("__permit").isNotNull()
    return staged.select(
        *requests.columns,
        F.when(denied, F.lit("deny")).when(permitted, F.lit("permit")).otherwise(F.lit(default)).alias("effect"),
        F.coalesce("__deny", "__permit").alias("matched_rule_id"),
        F.when(~denied & permitted & (F.col("__duty") != "none"), F.col("__duty")).alias("obligation"),
        F.coalesce("__deny_pos", F.lit(len(ranked)).cast("bigint")).alias("evaluated_rules"),
    )


def decide_distinct(requests: DataFrame, attrs: list[str], rules: list[PolicyRule], default: str = "deny") -> DataFrame:
    """Decide every attribute combination once and join back, null-safe.

    Worth it only when a rule is costly and combinations repeat a lot: the join back shuffles the
    requests unless Spark can broadcast the combinations.
    """
    combos = requests.select(*attrs).distinct()
    decided = abac_decide(combos, rules, default)
    picks = decided.select(*[F.col(a).alias(f"__{a}") for a in attrs], "effect", "matched_rule_id", "obligation", "evaluated_rules")
    on = reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(f"__{a}")) for a in attrs])
    return requests.join(picks, on, "left").drop(*[f"__{a}" for a in attrs])


# ---- attributes ----
def clearance_level(role: Column) -> Column:
    r = F.lower(role)
    return (
        F.when(r.contains("admin"), F.lit(5))
        .when(r.contains("security"), F.lit(4))
        .when(r.contains("manager") | r.contains("director"), F.lit(3))
        .when(r.contains("operator") | r.contains("staff"), F.lit(2))
        .otherwise(F.lit(1))
        .cast("bigint")
    )


def resolve_subject(df: DataFrame, role: str = "role", department: str = "department") -> DataFrame:
    return df.withColumns(
        {
            "clearance_level": clearance_level(F.col(role)),
            "group_membership": F.array(F.concat_ws("/", department, role)),
        }
    )


def resolve_resource(
    df: DataFrame, classification: str, file_type: str, size: str, zone: str, contains_pii: str
) -> DataFrame:
    return df.withColumns(
        {
            "data_classification": F.col(classification),
            "file_type": F.col(file_type),
            "file_size_bytes": F.col(size).cast("bigint"),
            "destination_zone": F.col(zone),
            "contains_pii": F.col(contains_pii).cast("boolean"),
        }
    )


def resolve_environment(df: DataFrame, ts: str = "ts", ip: str = "ip_address") -> DataFrame:
    """Time of day, ISO weekday, business day and network class, all from the row."""
    day = F.weekday(ts) + 1
    return df.withColumns(
        {
            "time_of_day": F.date_format(ts, "HH:mm"),
            "day_of_week": day.cast("bigint"),
            "business_day": day.between(1, 5),
            "source_network": network_class(F.col(ip)),
        }
    )


def merge_attrs(*maps: Column) -> Column:
    """Union of attribute maps; the later map wins on a shared key."""

    def later(a: Column, b: Column) -> Column:
        kept = F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k))
        return F.map_concat(kept, b)

    return reduce(later, maps)


# ---- rule sets ----
def policy_add(rules: list[PolicyRule], rule: PolicyRule) -> list[PolicyRule]:
    """Add a rule, replacing one of the same id in place."""
    if any(r.id == rule.id for r in rules):
        return [rule if r.id == rule.id else r for r in rules]
    return [*rules, rule]


def policy_remove(rules: list[PolicyRule], rule_id: str) -> list[PolicyRule]:
    return [r for r in rules if r.id != rule_id]


def policy_enable(rules: list[PolicyRule], rule_id: str, enabled: bool) -> list[PolicyRule]:
    return [replace(r, enabled=enabled) if r.id == rule_id else r for r in rules]


def rules_frame(spark: SparkSession, rules: list[PolicyRule]) -> DataFrame:
    return spark.createDataFrame(
        [
            (r.id, r.effect, r.priority, r.enabled, i, [(c.attr, c.op, str(c.value)) for c in r.conditions])
            for i, r in enumerate(rules)
        ],
        "rule_id string, effect string, priority bigint, enabled boolean, ord bigint,"
        " conditions array<struct<attr:string,op:string,value:string>>",
    )


def rule_problems(rules: list[PolicyRule]) -> list[str]:
    """What is wrong with a rule set: unknown effects or operators, bad patterns, repeated ids."""
    out = []
    for r in rules:
        if r.effect not in ("permit", "deny"):
            out.append(f"{r.id}: effect {r.effect}")
        for c in r.conditions:
            if c.op not in _OPS and c.op != "time_window":
                out.append(f"{r.id}: operator {c.op}")
            elif c.op == "regex" and pattern_error(c.value):
                out.append(f"{r.id}: pattern {c.value}")
    ids = [r.id for r in rules]
    return out + [f"{i}: repeated id" for i in sorted({i for i in ids if ids.count(i) > 1})]


# ---- follow-up ----
def obligations(decisions: DataFrame, key: str, rules: list[PolicyRule]) -> DataFrame:
    """One row per permitted request with a duty and per person to notify."""
    table = [
        (r.id, r.obligation.kind, r.obligation.approvers, list(r.obligation.notify) or [None])
        for r in rules
        if r.obligation is not None
    ]
    duties = decisions.sparkSession.createDataFrame(
        table, "matched_rule_id string, kind string, approvers bigint, notify array<string>"
    ).withColumn("notify", F.explode("notify"))
    return decisions.where("effect = 'permit' and obligation is not null").select(key, "matched_rule_id").join(
        F.broadcast(duties), "matched_rule_id"
    )


def decision_audit(decisions: DataFrame, key: str, actor: str, ts: str) -> DataFrame:
    """Decisions as audit events."""
    return decisions.select(
        F.col(key).alias("event_id"),
        F.col(ts).alias("ts"),
        F.when(F.col("effect") == "deny", F.lit("security_violation")).otherwise(F.lit("transfer_requested")).alias("event_type"),
        F.concat(F.lit("user-"), F.col(actor).cast("string")).alias("actor_id"),
        (F.col("effect") == "permit").alias("success"),
        F.when(
            F.col("effect") == "deny",
            F.concat(F.lit("denied by "), F.coalesce("matched_rule_id", F.lit("default"))),
        ).alias("error_message"),
    )


def policy_report(decisions: DataFrame) -> DataFrame:
    """Counts by rule, by effect and role, and overall, in one pass."""
    per = decisions.groupBy("matched_rule_id", "effect", "role").count()
    return decisions.sparkSession.sql(
        """
        select matched_rule_id, effect, role, sum(count) as requests,
               cast(grouping_id(matched_rule_id, effect, role) as bigint) as grouping_id
        from {per}
        group by grouping sets ((matched_rule_id), (effect, role), ())
        """,
        per=per,
    )


# --- fixed values: role permissions ---
ROLE_PERMISSIONS = {
    "staff": ("file_upload", "file_download"),
    "approver": ("file_upload", "file_download", "transfer_approve", "audit_view"),
    "admin": (
        "file_upload", "file_download", "transfer_approve", "user_manage", "policy_manage",
        "audit_view", "audit_export", "system_config", "api_key_manage",
    ),
}
# --- end of fixed values ---


def role_permissions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(r, a) for r, acts in ROLE_PERMISSIONS.items() for a in acts], "role string, action string"
    )


def can(df: DataFrame, role: str, action: str) -> DataFrame:
    """The rows whose role may do the action of the row."""
    grants = F.broadcast(role_permissions(df.sparkSession)).select(
        F.col("role").alias("__role"), F.col("action").alias("__action")
    )
    return df.join(grants, (F.col(role) == F.col("__role")) & (F.col(action) == F.col("__action")), "left_semi")


def ip_allowlist(df: DataFrame, lists: DataFrame, account: str, ip: str) -> DataFrame:
    """The rows whose address lies in their account's CIDR list; no list means every address is fine.

    Semi and anti joins on the account keep each row at most once and never fan out.
    """
    blocks = lists.select(
        F.col(account).alias("__account"), cidr_low(F.col("cidr")).alias("__low"), cidr_high(F.col("cidr")).alias("__high")
    )
    same = F.col(account) == F.col("__account")
    inside = df.join(blocks, same & ip_to_long(F.col(ip)).between(F.col("__low"), F.col("__high")), "left_semi")
    return inside.unionByName(df.join(blocks, same, "left_anti"))


def account_requirements(df: DataFrame, accounts: DataFrame, account: str, default_max_size: int) -> DataFrame:
    """Forced policy, dual approval and size limit of each row's account; defaults when it has none."""
    return df.join(accounts, account, "left").withColumns(
        {
            "forced_policy": F.coalesce("forced_policy", F.lit("none")),
            "dual_approval": F.coalesce("dual_approval", F.lit(False)),
            "max_file_size": F.coalesce("max_file_size", F.lit(default_max_size).cast("bigint")),
        }
    )
