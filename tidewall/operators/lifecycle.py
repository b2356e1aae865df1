"""Approval and file lifecycles: transitions, replay, votes, timeouts, lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewall.functions.ordered import time_bucket, with_next, with_previous, with_running_sum
from tidewall.functions.rows import computed_once

SLICE, PART = 8192, 256  # members that a task pairs with its requests, few enough for a file's dictionary; and those paired at a time, few enough to repeat within a page

# --- fixed values: approval and file states ---
APPROVAL_MOVES = (
    ("pending_approval", "approved"),
    ("pending_approval", "rejected"),
    ("pending_approval", "expired"),
    ("approved", "transferring"),
    ("transferring", "completed"),
    ("transferring", "failed"),
)
APPROVAL_STATES = (
    "pending_approval", "approved", "rejected", "transferring", "completed", "failed", "expired",
)
TERMINAL = ("completed", "rejected", "failed", "expired")
ACTIVE = ("pending_approval", "approved", "transferring")

FILE_STATES = (
    "pending_approval", "approved", "rejected", "transferring", "ready", "downloaded", "failed",
)
FILE_MOVES = (
    ("pending_approval", "approved"),
    ("pending_approval", "rejected"),
    ("approved", "transferring"),
    ("transferring", "ready"),
    ("ready", "downloaded"),
)
FILE_TERMINAL = ("rejected", "downloaded", "failed")
CALLBACK_STATES = {"Approved": "approved", "Rejected": "rejected"}
# --- end of fixed values ---


def file_moves() -> list[tuple[str, str]]:
    """The file moves with the wildcard rows written out: every state but failed may fail."""
    return [*FILE_MOVES, *[(s, "failed") for s in FILE_STATES if s != "failed"]]


def _legal(source: Column, target: Column, moves) -> Column:
    """Membership in a fixed set of moves, as one literal set test per row."""
    return F.coalesce(F.concat_ws(">", source, target).isin([f"{a}>{b}" for a, b in moves]), F.lit(False))


def lifecycle_transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(file_moves(), "from_state string, to_state string")


def legal_file_moves(events: DataFrame, source: str, target: str) -> DataFrame:
    """The rows that state a legal file move."""
    return events.where(_legal(F.col(source), F.col(target), file_moves()))


def valid_transitions(
    events: DataFrame, entity: str, order: list[str], status: str, ts: str, initial: str = "pending_approval", bucket_seconds: int = 3600
) -> DataFrame:
    """Each logged status with the one before it and whether that move is legal."""
    prev = with_previous(events, [entity], order, {"from_status": status}, time_bucket(F.col(ts), bucket_seconds))
    source = F.coalesce("from_status", F.lit(initial))
    return prev.withColumn("from_status", source).withColumn("is_legal", _legal(source, F.col(status), APPROVAL_MOVES))


def longest_path(moves) -> int:
    """Most moves an entity can ever make; the moves must not form a cycle."""
    depth: dict[str, int] = {}

    def walk(state: str, trail: tuple[str, ...]) -> int:
        if state in trail:
            raise ValueError("moves form a cycle")
        if state not in depth:
            depth[state] = max((1 + walk(b, (*trail, state)) for a, b in moves if a == state), default=0)
        return depth[state]

    return max(walk(a, ()) for a, _ in moves)


def accepted_moves(
    events: DataFrame, entity: str, order: list[str], status: str, right_one: Column, initial: str, moves=APPROVAL_MOVES
) -> DataFrame:
    """One row per entity: the events it accepts, as structs (at, to) in the columns move1, move2, ...

    Legal moves have no cycle, so an entity makes three at the most. The first is the earliest event
    legal from the initial state, the next the earliest later one legal from there, and so on: one
    partial minimum per round. No entity's log is ever gathered, however long it is.
    """
    at = F.struct(*[F.col(c).alias(c) for c in order])
    event = F.struct(at.alias("at"), F.col(status).alias("to"))
    out = events.groupBy(entity).agg(
        F.min(F.when(_legal(F.lit(initial), F.col(status), moves) & right_one, event)).alias("move1")
    )
    for n in range(2, longest_path(moves) + 1):
        last = F.col(f"move{n - 1}")
        later = events.join(out.where(last.isNotNull()).select(entity, last.alias("__last")), entity)
        test = (at > F.col("__last.at")) & _legal(F.col("__last.to"), F.col(status), moves) & right_one
        nxt = later.groupBy(entity).agg(F.min(F.when(test, event)).alias(f"move{n}"))
        out = out.join(nxt, entity, "left")
    return out


def replay_state(
    events: DataFrame,
    entity: str,
    order: list[str],
    status: str,
    approver: str | None = None,
    assigned: str | None = None,
    initial: str = "pending_approval",
) -> DataFrame:
    """Replay a state log: illegal moves are refused and leave the state as it is.

    Approving or rejecting also needs the assigned approver when both columns are given. Adds
    state_before, state_after and accepted to every event.
    """
    right_one = F.lit(True)
    if approver and assigned:
        right_one = ~F.col(status).isin("approved", "rejected") | F.coalesce(
            F.col(approver) == F.col(assigned), F.lit(False)
        )
    columns = events.columns
    events = events.withColumn("__entity", F.struct(entity))  # equal structs may hold nulls: a null entity is one of its own
    taken = accepted_moves(events, "__entity", order, status, right_one, initial)
    names = [c for c in taken.columns if c != "__entity"]
    at = F.struct(*[F.col(c).alias(c) for c in order])
    before = after = F.lit(initial)
    for n in names:
        before = F.when(F.coalesce(at > F.col(f"{n}.at"), F.lit(False)), F.col(f"{n}.to")).otherwise(before)
        after = F.when(F.coalesce(at >= F.col(f"{n}.at"), F.lit(False)), F.col(f"{n}.to")).otherwise(after)
    return events.join(taken, "__entity").select(
        *columns, before.alias("state_before"), after.alias("state_after"), (before != after).alias("accepted")
    )


def final_states(replayed: DataFrame, entity: str, order: list[str]) -> DataFrame:
    """Last state and refusal count per entity, from partial aggregates."""
    return replayed.groupBy(entity).agg(
        F.max_by("state_after", F.struct(*order)).alias("state"),
        F.count_if(~F.col("accepted")).alias("refused"),
    )


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def is_active(status: Column) -> Column:
    return status.isin(*ACTIVE)


def expire_pending(df: DataFrame, now: Column, status: str = "status", expires: str = "expires_at") -> DataFrame:
    """Pending requests past their expiry become expired; no expiry never expires."""
    due = F.coalesce((F.col(status) == "pending_approval") & (F.col(expires) < now), F.lit(False))
    return df.withColumn(status, F.when(due, F.lit("expired")).otherwise(F.col(status)))


def pending_for(df: DataFrame, approver: str | None = None) -> DataFrame:
    out = df.where("status = 'pending_approval'")
    return out if approver is None else out.where(F.col("approver_id") == approver)


def list_transfers(
    df: DataFrame, order: list[Column], status: str | None = None, page: int = 1, per: int = 20
) -> DataFrame:
    """One page (pages start at 1) in a total order, with the number of all matching rows.

    The total is one aggregate beside a top-k, so the rows are never ranked in a single window.
    """
    rows = df if status is None else df.where(F.col("status") == status)
    total = rows.agg(F.count(F.lit(1))).scalar()
    return rows.orderBy(*order).offset(max(page - 1, 0) * per).limit(per).withColumn("total_count", total)


def apply_callbacks(events: DataFrame, current: DataFrame, key: str, status: str = "payload_status", state: str = "state") -> DataFrame:
    """Callback outcome per event: applied, already there, illegal move, bad status or unknown file."""
    pairs = [x for k, v in CALLBACK_STATES.items() for x in (F.lit(k), F.lit(v))]
    target = F.element_at(F.create_map(*pairs), F.col(status))
    joined = events.join(current.select(key, F.col(state).alias("from_state")), key, "left").withColumn("to_state", target)
    return joined.withColumn(
        "outcome",
        F.when(F.col("to_state").isNull(), F.lit("bad_status"))
        .when(F.col("from_state").isNull(), F.lit("unknown_file"))
        .when(F.col("from_state") == F.col("to_state"), F.lit("unchanged"))
        .when(_legal(F.col("from_state"), F.col("to_state"), file_moves()), F.lit("applied"))
        .otherwise(F.lit("illegal")),
    )


def id_from_filename(name: Column, pattern: str) -> Column:
    """The {file_id} part of a filename; null when the pattern does not fit or the id is empty."""
    parts = pattern.split("{file_id}")
    if len(parts) != 2:
        return F.lit(None).cast("string")
    prefix, suffix = parts
    n = F.length(name) - len(prefix) - len(suffix)
    fits = F.startswith(name, F.lit(prefix)) & F.endswith(name, F.lit(suffix)) & (n > 0)
    return F.when(fits, F.substring(name, F.lit(len(prefix) + 1), n))


def classify_filename(df: DataFrame, name: str, approved: str = "{file_id}.approved", rejected: str = "{file_id}.rejected") -> DataFrame:
    """File id and target state from a decision file's name; the approval pattern is tried first."""
    yes, no = id_from_filename(F.col(name), approved), id_from_filename(F.col(name), rejected)
    return df.withColumns(
        {
            "decided_file_id": F.coalesce(yes, no),
            "target_state": F.when(yes.isNotNull(), F.lit("approved")).when(no.isNotNull(), F.lit("rejected")),
        }
    )


def resolve_trigger(events: DataFrame, moves: list[tuple[str, str, str]], state: str, trigger: str) -> DataFrame:
    """Target of (state, trigger), first rule wins; null when no rule fits. ``moves``: (from, trigger, to)."""
    first: dict[tuple[str, str], str] = {}
    for source, name, target in moves:
        first.setdefault((source, name), target)
    table = events.sparkSession.createDataFrame(
        [(a, b, c) for (a, b), c in first.items()], "__from string, __trigger string, to_state string"
    )
    on = (F.col(state) == F.col("__from")) & (F.col(trigger) == F.col("__trigger"))
    return events.join(F.broadcast(table), on, "left").drop("__from", "__trigger")


def select_approvers(requests: DataFrame, templates: DataFrame, members: DataFrame, heads: DataFrame) -> DataFrame:
    """One row per request and approver; a request nobody can approve keeps one row with an error.

    ``templates``: template_id, pool (role | department_head | custom), roles, user_ids.
    ``members``: role, user_id. ``heads``: department, head_id. The result has a row for every member of every role asked for by
    a request, so it grows with the product of both; the members of these roles are held by every task. A task pairs neighbouring
    requests with a slice of a role's members, a few members at a time, request by request: in files the same names come again
    in the same order, so a row takes a small part of a byte however many members a role has.
    """
    t = requests.join(templates, "template_id")
    lowered = lambda df: df.where("pool = 'role'").withColumn("__role", F.explode(F.transform("roles", F.lower)))
    of_role, asked = lowered(t), lowered(templates).select("__role").distinct()
    able = members.select(F.lower("role").alias("__role"), "user_id").join(asked, "__role", "left_semi")
    place = F.row_number().over(Window.partitionBy("__role").orderBy("user_id")) - 1
    # a list leaves out nulls, but not structs of a null
    parts = able.withColumn("__part", F.floor(place / PART)).groupBy("__role", "__part").agg(F.collect_list(F.struct("user_id")).alias("__m"))
    parts = parts.select("__role", "__part", F.col("__m.user_id").alias("__users"))
    last = able.groupBy("__role").agg(F.floor((F.count(F.lit(1)) - 1) / PART).alias("__last"))
    # one role may hold most members and requests: requests are dealt out evenly for each slice, not by their role
    spark, of_slice = requests.sparkSession, SLICE // PART
    n = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slices = F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("__last") / of_slice))
    asking = of_role.join(F.broadcast(last), "__role").select("__role", "__last", F.explode(slices).alias("__slice"), "request_id")
    first = F.col("__slice") * of_slice
    dealt = asking.repartitionByRange(n, "__role", "__slice", "request_id").select(
        "__role", F.explode(F.sequence(first, F.least(first + of_slice - 1, F.col("__last")))).alias("__part"), "request_id"
    )
    # Spark drops a sort below a join, but not below a column that it may not move
    dealt = dealt.sortWithinPartitions("__role", "__part", "request_id").withColumn("__part", computed_once(F.col("__part")))
    by_role = dealt.join(F.broadcast(parts), ["__role", "__part"]).select("request_id", F.explode("__users").alias("approver_id"))
    of_head = t.where("pool = 'department_head'")
    heads = heads.where("head_id <> ''")
    by_head = of_head.join(heads, "department").select("request_id", F.col("head_id").alias("approver_id"))
    of_list = t.where("pool = 'custom'")
    by_list = of_list.select("request_id", F.explode("user_ids").alias("approver_id"))
    found = by_role.unionByName(by_head).unionByName(by_list)
    # whether a request has an approver is told without the pairs
    served = [
        of_role.join(able.select("__role").distinct(), "__role", "left_semi"),
        of_head.join(heads, "department", "left_semi"),
        of_list.where(F.size("user_ids") > 0),
    ]
    ids = reduce(DataFrame.unionByName, [x.select("request_id") for x in served])
    missing = requests.join(ids, "request_id", "left_anti").select(
        "request_id", F.lit(None).cast("string").alias("approver_id"), F.lit("no_approvers").alias("error")
    )
    return found.withColumn("error", F.lit(None).cast("string")).unionByName(missing)


def tally_votes(
    votes: DataFrame, requests: DataFrame, required: str = "required_approvers", bucket_seconds: int = 3600
) -> DataFrame:
    """Outcome per request: any counted rejection rejects, enough approvals approve.

    Only an approver's first vote counts, and votes after closing do not. First votes and the first
    rejection are partial aggregates, and the n-th approval comes from a running count over time
    buckets, so a request with very many votes is never sorted in one task.
    """
    first = votes.groupBy("request_id", "approver_id").agg(
        F.min(F.struct("voted_at", "event_id", "approved")).alias("v")
    )
    flat = first.select("request_id", "approver_id", "v.*")
    need = requests.select("request_id", F.col(required).cast("bigint").alias("need"))
    yes = with_running_sum(
        flat.where("approved"), ["request_id"], ["voted_at", "event_id"], F.lit(1).cast("bigint"), "n", time_bucket(F.col("voted_at"), bucket_seconds)
    )
    enough = yes.join(need, "request_id").where("n = need").select(
        "request_id", F.struct("voted_at", "event_id").alias("approved_at")
    )
    refused = flat.where("not approved").groupBy("request_id").agg(
        F.min(F.struct("voted_at", "event_id")).alias("rejected_at")
    )
    closed = need.join(refused, "request_id", "left").join(enough, "request_id", "left")
    closed = closed.withColumn(
        "status",
        F.when(F.col("rejected_at").isNotNull() & (F.col("approved_at").isNull() | (F.col("rejected_at") < F.col("approved_at"))), F.lit("rejected"))
        .when(F.col("approved_at").isNotNull(), F.lit("approved"))
        .otherwise(F.lit("pending")),
    ).withColumn(
        "closed", F.when(F.col("status") == "rejected", F.col("rejected_at")).when(F.col("status") == "approved", F.col("approved_at"))
    )
    counted = flat.join(closed.select("request_id", "closed"), "request_id").where(
        "closed is null or struct(voted_at, event_id) <= closed"
    )
    counts = counted.groupBy("request_id").agg(
        F.count_if("approved").alias("approvals"), F.count(F.lit(1)).alias("counted_votes")
    )
    return closed.join(counts, "request_id", "left").select(
        "request_id",
        "status",
        F.coalesce("approvals", F.lit(0)).alias("approvals"),
        F.coalesce("counted_votes", F.lit(0)).alias("counted_votes"),
        F.col("closed.voted_at").alias("closed_at"),
    )


def timeout_requests(df: DataFrame, now: Column, status: str = "status", deadline: str = "expires_at", escalate: str = "escalate") -> DataFrame:
    """Pending requests past their deadline escalate or time out."""
    due = F.coalesce((F.col(status) == "pending_approval") & (F.col(deadline) < now), F.lit(False))
    return df.withColumn(
        status,
        F.when(due & F.col(escalate), F.lit("escalated")).when(due, F.lit("timed_out")).otherwise(F.col(status)),
    )


def pending_by_approver(df: DataFrame, approvers: str = "approvers") -> DataFrame:
    """Pending requests per approver."""
    return (
        df.where("status = 'pending_approval'")
        .select("request_id", F.explode(F.array_distinct(approvers)).alias("approver_id"))
        .groupBy("approver_id")
        .agg(F.count(F.lit(1)).alias("pending_requests"))
    )


def time_in_state(events: DataFrame, entity: str, order: list[str], status: str, ts: str, bucket_seconds: int = 3600) -> DataFrame:
    """Seconds each logged status lasted; null for the last one."""
    nxt = with_next(events, [entity], order, {"left_at": ts}, time_bucket(F.col(ts), bucket_seconds))
    seconds = F.unix_seconds(F.col("left_at").cast("timestamp")) - F.unix_seconds(F.col(ts).cast("timestamp"))
    return nxt.withColumn("seconds_in_state", seconds)


def lifecycle_metrics(events: DataFrame, entity: str, order: list[str], status: str, ts: str) -> DataFrame:
    """Per status: how often it was left, mean and longest stay."""
    return (
        time_in_state(events, entity, order, status, ts)
        .groupBy(status)
        .agg(
            F.count(F.lit(1)).alias("entered"),
            F.count("seconds_in_state").alias("left_count"),
            F.sum("seconds_in_state").alias("total_seconds"),
            F.max("seconds_in_state").alias("max_seconds"),
        )
    )


def median_time_in_state(events: DataFrame, entity: str, order: list[str], status: str, ts: str) -> DataFrame:
    return (
        time_in_state(events, entity, order, status, ts)
        .where("seconds_in_state is not null")
        .groupBy(status)
        .agg(F.percentile_approx("seconds_in_state", 0.5).alias("median_seconds"))
    )


def approvals_per_day(events: DataFrame, status: str, ts: str) -> DataFrame:
    return (
        events.where(F.col(status) == "approved")
        .groupBy(F.to_date(ts).alias("day"))
        .agg(F.count(F.lit(1)).alias("approvals"))
    )

