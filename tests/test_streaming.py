import datetime as dt
import gzip
import hashlib
import json
import random

from pyspark.sql import functions as F

from tidewall.operators import audit as U
from tidewall.sources import sinks
from tidewall.sources.digests import Md5, file_digests
from tidewall.sources.tables import scan_files
from tidewall.streaming import stateful as SF
from tidewall.streaming import streams as S

T0 = dt.datetime(2024, 1, 1)


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def drain(spark, df, base, name="q"):
    S.to_folder(df, f"{base}/{name}_out", f"{base}/{name}_cp").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/{name}_out")


def test_counters_drop_late_rows(spark, tmp_path):
    schema = "ts timestamp, kind string"
    src = tmp_path / "in"
    put(spark, src, [(T0 + dt.timedelta(hours=h), "a") for h in (0, 0, 5)], schema)
    stream = S.stream_counters(S.watch_dir(spark, str(src), schema), "ts", ["kind"])
    first = drain(spark, stream, tmp_path)
    assert [(r.window_start, r.events) for r in first.collect()] == [(T0, 2)]
    # too late for the closed window; the open one at hour five still counts
    put(spark, src, [(T0, "a"), (T0 + dt.timedelta(hours=5), "a"), (T0 + dt.timedelta(hours=9), "a")], schema)
    stream = S.stream_counters(S.watch_dir(spark, str(src), schema), "ts", ["kind"])
    second = drain(spark, stream, tmp_path)
    assert sorted((r.window_start.hour, r.events) for r in second.collect()) == [(0, 2), (5, 2)]


def test_dedupe_across_batches(spark, tmp_path):
    schema = "ts timestamp, nonce string"
    src = tmp_path / "in"
    put(spark, src, [(T0, "x"), (T0, "y")], schema)
    make = lambda: S.stream_dedupe(S.watch_dir(spark, str(src), schema), "ts", ["nonce"], "1 hour")
    drain(spark, make(), tmp_path)
    put(spark, src, [(T0 + dt.timedelta(minutes=5), "x"), (T0 + dt.timedelta(minutes=6), "z")], schema)
    assert sorted(r.nonce for r in drain(spark, make(), tmp_path).collect()) == ["x", "y", "z"]


def test_approvals_with_expiry(spark, tmp_path):
    schema = "request_id bigint, ts timestamp, status string"
    src = tmp_path / "in"
    h = lambda n: T0 + dt.timedelta(hours=n)
    put(spark, src, [(1, h(0), "approved"), (1, h(1), "completed"), (1, h(2), "transferring"), (2, h(0), "completed")], schema)
    make = lambda: SF.stream_approvals(S.watch_dir(spark, str(src), schema), "request_id", "ts", "status", expiry_seconds=6 * 3600)
    drain(spark, make(), tmp_path)
    # a later event moves the watermark past the expiry of request 2
    put(spark, src, [(3, h(30), "rejected")], schema)
    out = drain(spark, make(), tmp_path)
    got = sorted((r.request_id, r.state_before, r.state_after, r.accepted) for r in out.collect())
    assert (1, "pending_approval", "approved", True) in got and (1, "approved", "approved", False) in got and (1, "approved", "transferring", True) in got
    assert (2, "pending_approval", "pending_approval", False) in got and (2, "pending_approval", "expired", True) in got
    assert (3, "pending_approval", "rejected", True) in got


def test_assembly_and_idle_drop(spark, tmp_path):
    schema = "id bigint, ts timestamp, chunk_index bigint, data string, expected_count bigint"
    src = tmp_path / "in"
    put(spark, src, [(1, T0, 1, "b", 2), (2, T0, 0, "x", 3), (1, T0, 1, "b", 2)], schema)
    make = lambda: SF.stream_assemble(S.watch_dir(spark, str(src), schema), "id", "ts", idle_seconds=3600)
    drain(spark, make(), tmp_path)
    put(spark, src, [(1, T0, 0, "a", 2), (9, T0 + dt.timedelta(hours=9), 0, "q", 1)], schema)
    out = {r.file_id: (r.outcome, r.content, r.file_md5) for r in drain(spark, make(), tmp_path).collect()}
    assert out[1] == ("complete", "ab", hashlib.md5(b"ab").hexdigest())
    assert out[9][:2] == ("complete", "q") and out[2][0] == "dropped_idle"


def test_limiter_stream(spark, tmp_path):
    schema = "id bigint, k string, ts timestamp"
    src = tmp_path / "in"
    put(spark, src, [(i, "c", T0 + dt.timedelta(minutes=10 * i)) for i in range(4)], schema)
    out = drain(spark, SF.stream_limiter(S.watch_dir(spark, str(src), schema), "k", "ts", "id", 2, 1800), tmp_path)
    assert [r.allowed for r in out.orderBy("request_id").collect()] == [True, True, False, True]


def test_decisions_follow_a_changed_rule_file(spark, tmp_path):
    rules = tmp_path / "rules.json"

    def policy(effect):
        rules.write_text(json.dumps({"rules": [{"id": "r", "effect": effect, "conditions": [{"attr": "role", "op": "eq", "value": "a"}]}]}))

    policy("permit")
    src, schema = tmp_path / "in", "id bigint, role string"

    def go(i):
        put(spark, src, [(i, "a")], schema)
        S.stream_decide(S.watch_dir(spark, str(src), schema), str(rules), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()

    go(1)
    policy("deny")
    go(2)
    assert {r.id: r.effect for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1: "permit", 2: "deny"}
    live = S.ReloadingRules(spark, str(rules))
    rules.write_text("{broken")
    assert live.refresh()[0].effect == "deny" and live.last_error


def test_audit_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", T0), ("2", T0 + dt.timedelta(days=1))], "event_id string, ts timestamp")
    sinks.write_audit(df, str(tmp_path / "log"))
    sinks.write_audit(df, str(tmp_path / "log"))
    back = sinks.read_audit(spark, str(tmp_path / "log"), "event_id string, ts timestamp")
    day = U.audit_query(back, start="2024-01-02 00:00:00", date_column="event_date")
    assert back.count() == 4 and day.count() == 2
    assert "PartitionFilters: [isnotnull(event_date" in day._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_file_digests_read_large_files_in_ranges(spark, tmp_path):
    """Files above the range have the MD5 of all their bytes, whatever their lines, and no task is given a whole one."""
    r = random.Random(3)
    made = {
        "random.bin": r.randbytes(70_000), "ends.bin": r.randbytes(40_000) + b"\r\n", "feeds.bin": b"\n" * 30_001, "one line.bin": b"\x00" * 50_000,
        "mark.bin": b"\xef\xbb\xbf" + r.randbytes(30_000) + b"\n", "a%20[b].bin": b"\nx\n" * 9_000, "edge.bin": r.randbytes(10_000), "over.bin": r.randbytes(10_001),
        "small.bin": b"abc", "packed.bin.gz": gzip.compress(r.randbytes(20_000)), "unread.txt": r.randbytes(20_000),
    }
    (tmp_path / "sub").mkdir()
    for i, (name, data) in enumerate(made.items()):
        (tmp_path / ("sub" if i % 2 else ".") / name).write_bytes(data)
    got = {x.name: (x["size"], x.md5, x.magic) for x in file_digests(spark, str(tmp_path), "*.bin*", most=10_000).collect()}
    want = {n: (len(d), hashlib.md5(d).hexdigest(), d[:4].hex().upper()) for n, d in made.items() if n != "unread.txt"}
    assert got == want
    assert file_digests(spark, str(tmp_path), "*.bin*", most=1 << 20).count() == len(want)
    for k in (0, 63, 64, 65):
        half = Md5(Md5().update(made["random.bin"][:k]).state)
        assert half.update(made["random.bin"][k:]).hexdigest() == want["random.bin"][1]


def test_scan_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_bytes(b"hello")
    (tmp_path / "b.bin").write_bytes(b"x")
    got = {r.name: (r["size"], bytes(r.content)) for r in scan_files(spark, str(tmp_path), "*.txt").collect()}
    assert got == {"a.txt": (5, b"hello")}
    assert "content" not in scan_files(spark, str(tmp_path), content=False).columns


def test_sessions_and_link_hash_change(spark):
    df = spark.createDataFrame([(1, "u", T0), (2, "u", T0 + dt.timedelta(minutes=10)), (3, "u", T0 + dt.timedelta(hours=2))], "event_id int, u string, ts timestamp")
    got = [(r.events, r.session_start) for r in U.sessions(df, "u", ["ts", "event_id"], "ts", 1800).orderBy("session_start").collect()]
    assert got == [(2, T0), (1, T0 + dt.timedelta(hours=2))]
    whole = {r.event_id: r.link_hash for r in U.audit_hash(df).collect()}
    cut = {r.event_id: r.link_hash for r in U.audit_hash(df.where("event_id <> 2")).collect()}
    assert whole[1] == cut[1] and whole[3] != cut[3]
    assert U.day_digest(U.audit_hash(df)).count() == 1
    assert df.select(F.to_date("ts")).distinct().count() == 1


class FakeState:
    """A state store of one key that counts its calls."""

    def __init__(self):
        self.values, self.timers, self.calls = {}, set(), 0

    def getValueState(self, name, schema):
        return FakeValue(self, name)

    def getListState(self, name, schema):
        return FakeValue(self, name)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class FakeValue:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def get(self):
        self.store.calls += 1
        return self.store.values.get(self.name, [] if self.name == "chunks" else None)

    def update(self, value):
        self.store.calls += 1
        self.store.values[self.name] = value

    put = update

    def appendList(self, more):
        self.store.calls += 1
        self.store.values.setdefault(self.name, []).extend(more)

    def clear(self):
        self.store.calls += 1
        self.store.values.pop(self.name, None)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):
        return self.ms

    getCurrentWatermarkInMs = getExpiryTimeInMs


def test_a_bucket_of_requests_is_one_read_and_one_write():
    store, machine = FakeState(), SF.ApprovalMachine("bigint", 6)
    machine.init(store)
    us = 1_000_000
    rows = [(0, k, (k + s) * us, status, None) for k in (*range(500), None) for s, status in ((0, "completed"),) if k is not None] + [(0, None, None, None, None), (0, 7, 8 * us, "approved", None), (0, 8, 20 * us, "approved", None)]
    out = [tuple(r) for r in machine.handleInputRows((0,), iter(rows), At(0))]
    assert store.calls <= 3 and len(out) == 504
    assert (7, "pending_approval", "approved", True, 8 * us) in out and (8, "pending_approval", "expired", True, 14 * us) in out and (8, "expired", "expired", False, 20 * us) in out
    assert store.timers == {SF.NO_TIME_MS + 6000}
    out = [tuple(r) for r in machine.handleExpiredTimer((0,), At(9000), At(SF.NO_TIME_MS + 6000))]
    assert sorted((r[0] is not None, r[0] or 0) for r in out) == [(False, 0), (True, 0), (True, 1), (True, 2)] and 9000 in store.timers


def test_chunks_of_a_batch_are_one_write_and_are_read_once():
    store, machine = FakeState(), SF.AssemblyMachine(10)
    machine.init(store)
    parts = lambda *at: iter([(5, None, i, f"{i},", 300, 0) for i in at])
    assert list(machine.handleInputRows((5,), parts(*range(200), *range(50)), At(0))) == []
    assert store.calls <= 4
    assert list(machine.handleInputRows((5,), parts(*range(150, 290)), At(0))) == []  # 50 come again
    out = list(machine.handleInputRows((5,), parts(*range(285, 300)), At(0)))
    assert [tuple(r)[:3] for r in out] == [(5, "complete", 300)] and out[0]["content"] == "".join(f"{i}," for i in range(300))
    assert "chunks" not in store.values and list(machine.handleInputRows((5,), parts(1), At(0))) == []


def test_decision_files_are_written_by_several_tasks(spark, monkeypatch):
    from tidewall.plans import catalog
    from tidewall.plans.catalog import streams

    catalog.load_all()
    seen = []
    monkeypatch.setattr(streams.S, "stream_decision_files", lambda spark, path, **k: seen.append(path) or spark.readStream.format("rate").load().selectExpr("'a' as decided_file_id", "'b' as target_state"))
    monkeypatch.setattr(streams, "run", lambda spark, stream, label: stream)
    catalog.QUERIES["X9_stream_decision_files"](spark, "/root/testdata/sf0.01")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(seen[0]).select("path").collect()
    assert len(files) == 100 and len({f.path.rsplit("/", 1)[1].split("-")[1] for f in files}) > 1
