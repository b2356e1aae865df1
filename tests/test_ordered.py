"""Hot-key helpers against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewall.functions.ordered import (
    fold_in_order,
    time_bucket,
    trailing_count,
    with_next,
    with_previous,
    with_running_sum,
)
from tidewall.operators import integrity as I
from tidewall.operators import lifecycle as L
from tidewall.operators import network as N

START = dt.datetime(2024, 1, 1)


def events(spark, n=600, keys=4, seed=3, hot=0.5):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = 0 if rnd.random() < hot else rnd.randrange(keys)
        rows.append((i, k, START + dt.timedelta(seconds=rnd.randrange(0, 86400)), rnd.random() < 0.6))
    return rows, spark.createDataFrame(rows, "id int, k int, ts timestamp, ok boolean")


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def test_neighbours_and_running_sum(spark):
    rows, df = events(spark)
    bucket = time_bucket(F.col("ts"), 900)
    prev = {r.id: r.p for r in with_previous(df, ["k"], ["ts", "id"], {"p": "id"}, bucket).collect()}
    nxt = {r.id: r.q for r in with_next(df, ["k"], ["ts", "id"], {"q": "id"}, bucket).collect()}
    run = {r.id: r.s for r in with_running_sum(df, ["k"], ["ts", "id"], F.col("ok").cast("int"), "s", bucket).collect()}
    for rs in by_key(rows).values():
        total = 0
        for i, r in enumerate(rs):
            total += r[3]
            assert prev[r[0]] == (rs[i - 1][0] if i else None)
            assert nxt[r[0]] == (rs[i + 1][0] if i + 1 < len(rs) else None)
            assert run[r[0]] == total


def test_trailing_count(spark):
    rows, df = events(spark)
    got = {r.id: r.n for r in trailing_count(df, ["k"], "ts", 3600, "n", "id").collect()}
    for rs in by_key(rows).values():
        for r in rs:
            assert got[r[0]] == sum(1 for x in rs if r[2] - dt.timedelta(seconds=3600) < x[2] <= r[2])


def limiter(rs, limit, window):
    recent, out = [], {}
    for r in rs:
        recent = [t for t in recent if t > r[2] - dt.timedelta(seconds=window)]
        ok = len(recent) < limit
        if ok:
            recent.append(r[2])
        out[r[0]] = ok
    return out


def test_rate_limit_split_and_whole(spark):
    rows, df = events(spark)
    want = {}
    for rs in by_key(rows).values():
        want |= limiter(rs, 5, 3600)
    fold = N.limit_fold("lim", 3600, "ts")
    with_limit = df.withColumn("lim", F.lit(5))
    for hot_rows in (10**6, 50):
        out = fold_in_order(with_limit, ["k"], ["ts", "id"], time_bucket(F.col("ts"), 7200), fold, "allowed boolean, remaining bigint, reset_at_us bigint", hot_rows=hot_rows)
        assert {r.id: r.allowed for r in out.collect()} == want


def breaker(rs, threshold, cooldown):
    f, mode, since, out = 0, "closed", None, {}
    for r in rs:
        if mode == "open" and r[2] - since >= dt.timedelta(seconds=cooldown):
            mode = "half_open"
        if r[3]:
            f = 0
            mode = "closed" if mode == "half_open" else mode
        else:
            f += 1
            if mode == "half_open" or (mode == "closed" and f >= threshold):
                mode, since = "open", r[2]
        out[r[0]] = mode
    return out


@pytest.mark.parametrize(("keys", "threshold", "cooldown"), [(4, 3, 1800), (1, 2, 90), (40, 1, 6000), (3, 0, 600), (3, 2, 0)])
def test_breaker_equals_plain_fold(spark, keys, threshold, cooldown):
    """Also with one key for all rows, and with reports of the same time."""
    rows, df = events(spark, n=900, keys=keys, seed=9, hot=0.3)
    rows = [(i, k, t.replace(second=0), ok) for i, k, t, ok in rows]
    df = spark.createDataFrame(rows, df.schema)
    want = {}
    for rs in by_key(rows).values():
        want |= breaker(rs, threshold or 10**9, cooldown)
    out = N.circuit_states(df, "k", ["ts", "id"], "ok", "ts", threshold, cooldown // 3, bucket_seconds=7200).collect()
    assert {r.id: r.state for r in out} == want
    for rs in by_key(rows).values():
        run = 0
        got = {r.id: r.failures for r in out}
        for r in rs:
            run = 0 if r[3] else run + 1
            assert got[r[0]] == run


@pytest.mark.parametrize(("keys", "ttl"), [(1, 60), (1, 4000), (6, 900), (300, 3600), (5, 0)])
def test_replays_since_accepted_equal_plain_fold(spark, keys, ttl):
    rows, df = events(spark, n=1500, keys=keys, seed=12, hot=0.2)
    rows = [(i, None if k == 2 else k, t.replace(second=t.second // 30 * 30), ok) for i, k, t, ok in rows]
    df = spark.createDataFrame(rows, df.schema)
    want, since = {}, {}
    for i, k, t, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = k in since and t - since[k] < dt.timedelta(seconds=ttl)
        if not want[i]:
            since[k] = t
    got = {r.id: r.is_replay for r in I.replays_since_accepted(df, ["k"], "ts", ["ts", "id"], ttl, 1800).collect()}
    assert got == want
    assert I.replays_since_accepted(df.where("false"), ["k"], "ts", ["ts", "id"], ttl).count() == 0


def test_replay_equals_plain_fold(spark):
    rnd = random.Random(5)
    states = ["approved", "rejected", "transferring", "completed", "failed", "expired"]
    rows = [(i, rnd.randrange(30), START + dt.timedelta(minutes=rnd.randrange(5000)), rnd.choice(states), rnd.choice("ab")) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, k int, ts timestamp, status string, approver string").withColumn("assigned", F.lit("a"))
    out = L.replay_state(df, "k", ["ts", "id"], "status", "approver", "assigned")
    got = {r.id: (r.state_before, r.state_after, r.accepted) for r in out.collect()}
    assert len(got) == len(rows)
    legal = set(L.APPROVAL_MOVES)
    cur = {}
    for i, k, _, to, who in sorted(rows, key=lambda r: (r[2], r[0])):
        s = cur.get(k, "pending_approval")
        ok = (s, to) in legal and (to not in ("approved", "rejected") or who == "a")
        cur[k] = to if ok else s
        assert got[i] == (s, cur[k], ok)
    assert [r.state for r in L.final_states(out, "k", ["ts", "id"]).orderBy("k").collect()] == [cur[k] for k in sorted(cur)]


def test_null_keys_are_a_key_of_their_own(spark):
    rows, df = events(spark)
    df = df.withColumn("k", F.when(F.col("k") != 0, F.col("k")))  # the hottest key is null
    bucket = time_bucket(F.col("ts"), 900)
    prev = {r.id: r.p for r in with_previous(df, ["k"], ["ts", "id"], {"p": "id"}, bucket).collect()}
    run = {r.id: r.s for r in with_running_sum(df, ["k"], ["ts", "id"], F.col("ok").cast("int"), "s", bucket).collect()}
    for rs in by_key(rows).values():
        total = 0
        for i, r in enumerate(rs):
            total += r[3]
            assert prev[r[0]] == (rs[i - 1][0] if i else None)
            assert run[r[0]] == total
    from tidewall.operators.audit import sessions

    six = spark.createDataFrame([(None, i, START + dt.timedelta(hours=12 * i)) for i in range(6)], "a int, id int, ts timestamp")
    assert sessions(six, "a", ["ts", "id"], "ts", 3600).count() == 6
    log = spark.createDataFrame([(None, 1, START, "approved"), (None, 2, START, "completed"), (7, 3, START, "approved")], "r int, id int, ts timestamp, status string")
    got = {r.id: (r.state_after, r.accepted) for r in L.replay_state(log, "r", ["ts", "id"], "status").collect()}
    assert got == {1: ("approved", True), 2: ("approved", False), 3: ("approved", True)}


def test_a_limit_of_zero_denies(spark):
    rows = [(i, 1, START + dt.timedelta(seconds=i)) for i in range(3)]
    df = spark.createDataFrame(rows, "id int, k int, ts timestamp")
    got = N.rate_limit(df, "k", ["ts", "id"], "ts", 0, 60).collect()
    assert [r.allowed for r in got] == [False] * 3
    assert {r.remaining for r in got} == {0}
    accounts = spark.createDataFrame([(1, 0)], "k int, hourly_limit int")
    assert all(r.allowed for r in N.hourly_limit(df, accounts, "k", ["ts", "id"], "ts").collect())


def test_a_role_of_most_members_is_no_single_task(spark):
    """Requests of one role are dealt to many tasks, and who has no approver is told without the pairs."""
    requests = spark.range(400).selectExpr("id as request_id", "id % 2 as template_id", "'d' as department").coalesce(1)
    templates = spark.createDataFrame([(0, "role", ["ADMIN"], None), (1, "custom", None, [])], "template_id bigint, pool string, roles array<string>, user_ids array<string>")
    members = spark.range(300).selectExpr("'Admin' as role", "concat('u', id) as user_id")
    out = L.select_approvers(requests, templates, members, spark.createDataFrame([], "department string, head_id string"))
    found = out.where("error is null")
    assert found.select(F.spark_partition_id()).distinct().count() > 4 and found.count() == 200 * 300
    assert sorted(r.request_id for r in out.where("error is not null").collect()) == list(range(1, 400, 2))
    anti = out.where("error is not null")._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_requests_and_members_take_little_disk(spark, tmp_path):
    """A role of more members than a dictionary of a file holds; nulls and repeats stay, and every pair is there."""
    requests = spark.range(40).selectExpr("case when id < 2 then null else id div 2 end as request_id", "id % 4 as template_id", "'d' as department")
    templates = spark.createDataFrame(
        [(0, "role", ["ADMIN"], None), (1, "role", ["admin", "Clerk"], None), (2, "role", ["nobody"], None), (3, "role", ["clerk", "CLERK"], None)],
        "template_id bigint, pool string, roles array<string>, user_ids array<string>",
    )
    many = spark.range(70_000).selectExpr("'Admin' as role", "concat('member-', sha2(cast(id as string), 224)) as user_id")
    few = spark.createDataFrame([("clerk", "c1"), ("CLERK", "c1"), ("clerk", None), (None, "lost"), ("other", "c2")], "role string, user_id string")
    heads = spark.createDataFrame([], "department string, head_id string")
    out = L.select_approvers(requests, templates, many.unionByName(few), heads)
    rows = requests.collect()
    admin = [r.request_id for r in rows if r.template_id in (0, 1)]
    clerk = [r.request_id for r in rows if r.template_id == 1] + [r.request_id for r in rows if r.template_id == 3] * 2
    out.write.parquet(str(tmp_path / "pairs"))
    back = spark.read.parquet(str(tmp_path / "pairs"))
    assert back.count() == len(admin) * 70_000 + len(clerk) * 3 + back.where("error is not null").count()
    pairs = back.where("approver_id like 'member-%'").groupBy("request_id").agg(F.count("*").alias("n"), F.count_distinct("approver_id").alias("d"))
    assert {r.request_id: (r.n, r.d) for r in pairs.collect()} == {i: (admin.count(i) * 70_000, 70_000) for i in set(admin)}
    got = sorted(str(tuple(r)) for r in back.where("error is null and (approver_id is null or approver_id not like 'member-%')").select("request_id", "approver_id").collect())
    assert got == sorted(str((i, u)) for i in clerk for u in ("c1", "c1", None))
    # the names take 4.4 MB, once for every file that holds them; row by row they would take 90 MB
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 20_000_000
