"""Keyed state machines on streams (transformWithState; needs the RocksDB state store)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from tidewall.operators.lifecycle import APPROVAL_MOVES

MOVES = frozenset(APPROVAL_MOVES)
MOVE = Row("request_id", "state_before", "state_after", "accepted", "at")
FILE = Row("file_id", "outcome", "chunks", "file_md5", "content")
NO_TIME_MS = -9223372036855  # before all times: of a row without one


def _ms(t) -> int:
    return int(pd.Timestamp(t).value // 1_000_000)


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """A key's rows of one micro-batch in event order; the source's rate limit bounds them."""
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


class ApprovalMachine(StatefulProcessor):
    """State of the requests of one bucket; a request still pending at its expiry becomes expired by a timer.

    Calls to the state store cost more than the moves themselves, so a bucket of requests is read and written as one
    value, and one timer stands at the earliest expiry of its pending requests.
    """

    def __init__(self, kind: str, expiry_seconds: int):
        self.kind, self.expiry_ms = kind, expiry_seconds * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.requests = handle.getValueState("requests", f"request_id array<{self.kind}>, status array<string>, expires array<bigint>")

    def _known(self) -> dict:
        request, status, expires = self.requests.get() or ((), (), ())
        return dict(zip(request, zip(status, expires, strict=True), strict=True))

    @staticmethod
    def _next_expiry(known: dict) -> int | None:
        return min((expires for status, expires in known.values() if status == "pending_approval"), default=None)

    def _keep(self, known: dict, timer: int | None) -> None:
        """Write the bucket; ``timer`` is the one that stands already."""
        status, expires = zip(*known.values(), strict=True)
        self.requests.update((list(known), list(status), list(expires)))
        due = self._next_expiry(known)
        if due is not None and due != timer:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues):
        known = self._known()
        timer = self._next_expiry(known)
        batch = [(r[1], r[2], r[3]) for r in rows]
        batch.sort(key=lambda r: (r[1] is None, r[1] or 0, r[2] is None, r[2] or ""))
        for request, at, target in batch:
            t = NO_TIME_MS if at is None else at // 1000
            before, expires = known.get(request) or ("pending_approval", t + self.expiry_ms)
            if before == "pending_approval" and t > expires:
                yield MOVE(request, before, "expired", True, expires * 1000)
                before = "expired"
            legal = (before, target) in MOVES
            known[request] = (target if legal else before, expires)
            yield MOVE(request, before, known[request][0], legal, at)
        self._keep(known, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        fired, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        known = self._known()
        due = [(request, expires) for request, (status, expires) in known.items() if status == "pending_approval" and (expires <= fired or expires < now)]
        if due:
            for request, expires in due:
                known[request] = ("expired", expires)
                yield MOVE(request, "pending_approval", "expired", True, expires * 1000)
            self._keep(known, None)

    def close(self) -> None:
        pass


def stream_approvals(
    events: DataFrame, key: str, ts: str, status: str, expiry_seconds: int = 72 * 3600, lateness: str = "1 hour", buckets: int = 16384
) -> DataFrame:
    """Every move of every request: state before and after, accepted or not, and timed expiries.

    Requests are dealt to ``buckets`` by a hash of their key; a bucket is one key of the state store. The number cannot change between
    two runs on one checkpoint.
    """
    kind = events.schema[key].dataType.simpleString()
    schema = StructType.fromDDL(f"request_id {kind}, state_before string, state_after string, accepted boolean, at bigint")
    moves = (
        events.select(key, ts, status)
        .withWatermark(ts, lateness)
        .select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.col(key).alias("request_id"), F.unix_micros(ts).alias("micros"), F.col(status).alias("status"), F.col(ts).alias("ts"))
        .groupBy("bucket")
        .transformWithState(ApprovalMachine(kind, expiry_seconds), schema, "Append", "EventTime")
    )
    return moves.withColumn("at", F.timestamp_micros("at"))


class LimiterMachine(StatefulProcessor):
    """Times of the allowed requests within the window; never more than the limit."""

    def __init__(self, ts: str, id_col: str, limit: int, window_seconds: int):
        self.ts, self.id_col, self.limit, self.window_ms = ts, id_col, limit, window_seconds * 1000

    def init(self, handle) -> None:
        self.recent = handle.getValueState("recent", "times string")

    def handleInputRows(self, key, rows, timerValues):
        recent = json.loads(self.recent.get()[0]) if self.recent.exists() else []
        out = []
        batch = _in_order(rows, [self.ts, self.id_col])
        for at, request in zip(batch[self.ts], batch[self.id_col]):
            t = _ms(at)
            recent = [x for x in recent if x > t - self.window_ms]
            ok = len(recent) < self.limit
            if ok:
                recent.append(t)
            out.append((request, key[0], ok, self.limit - len(recent)))
        self.recent.update((json.dumps(recent),))
        yield pd.DataFrame(out, columns=["request_id", "client", "allowed", "remaining"])

    def close(self) -> None:
        pass


def stream_limiter(events: DataFrame, key: str, ts: str, id_col: str, limit: int, window_seconds: int, lateness: str = "1 hour") -> DataFrame:
    """Exact sliding-window limiter on a stream whose rows arrive in order per key."""
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, id_col)}
    schema = StructType.fromDDL(f"request_id {kinds[id_col]}, client {kinds[key]}, allowed boolean, remaining bigint")
    return (
        events.select(key, ts, id_col)
        .withWatermark(ts, lateness)
        .groupBy(key)
        .transformWithStateInPandas(LimiterMachine(ts, id_col, limit, window_seconds), schema, "Append", "EventTime")
    )


class AssemblyMachine(StatefulProcessor):
    """Chunks of a file until all are there; an idle file is dropped by a timer.

    Chunks are written as one list per batch and read back when they may be complete. Of a chunk that comes twice the
    first counts.
    """

    def __init__(self, idle_seconds: int):
        self.idle_ms = idle_seconds * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", "chunk_index bigint, data string")
        # received: chunks in the list; one that came in several batches counts in each until the list is read
        self.seen = handle.getValueState("seen", "expected bigint, received bigint, last bigint")

    def _stored(self) -> dict[int, str]:
        out: dict[int, str] = {}
        for i, data in self.chunks.get():
            out.setdefault(i, data)
        return out

    def handleInputRows(self, key, rows, timerValues):
        expected, received, last = self.seen.get() or (0, 0, 0)
        if received < 0:
            return
        fresh: dict[int, str] = {}
        for _, _, i, data, n, t in rows:
            fresh.setdefault(int(i), data)
            expected, last = int(n), max(last, t)
        parts = fresh
        if received and received + len(fresh) >= expected:
            stored = self._stored()
            parts = fresh | stored
            fresh = {i: data for i, data in fresh.items() if i not in stored}
            if len(stored) < received:
                self.chunks.put(list(stored.items()))
                received = len(stored)
        if expected and received + len(fresh) >= expected and all(i in parts for i in range(expected)):
            content = "".join(parts[i] for i in range(expected))
            if received:
                self.chunks.clear()
            self.seen.update((expected, -1, last))
            yield FILE(key[0], "complete", expected, hashlib.md5(content.encode()).hexdigest(), content)
        else:
            if fresh:
                self.chunks.appendList(list(fresh.items()))
            self.seen.update((expected, received + len(fresh), last))
            self.handle.registerTimer(last + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        seen = self.seen.get()
        if seen is None:
            return
        _, received, last = seen
        if received >= 0 and expiredTimerInfo.getExpiryTimeInMs() >= last + self.idle_ms:
            received = len(self._stored())
            self.chunks.clear()
            self.seen.clear()
            yield FILE(key[0], "dropped_idle", received, None, None)

    def close(self) -> None:
        pass


def stream_assemble(chunks: DataFrame, key: str, ts: str, idle_seconds: int = 3600, lateness: str = "10 minutes") -> DataFrame:
    """One row per finished or dropped file. ``chunks``: key, ts, chunk_index, data, expected_count."""
    kind = chunks.schema[key].dataType.simpleString()
    schema = StructType.fromDDL(f"file_id {kind}, outcome string, chunks bigint, file_md5 string, content string")
    return (
        chunks.select(key, ts, "chunk_index", "data", "expected_count")
        .withWatermark(ts, lateness)
        .select(F.col(key).alias("file_id"), ts, "chunk_index", "data", "expected_count", F.coalesce(F.unix_millis(ts), F.lit(NO_TIME_MS)).alias("millis"))
        .groupBy("file_id")
        .transformWithState(AssemblyMachine(idle_seconds), schema, "Append", "EventTime")
    )
