"""Relay topology, bounded shortest paths, breakers, limits, health and device checks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewall.functions.ordered import (
    fold_in_order,
    next_after,
    reached,
    time_bucket,
    trailing_count,
    with_next_marked,
    with_previous,
    with_running_max,
    with_running_sum,
)
from tidewall.session import cut_lineage

LATENCY_MS_PER_HOP = 10
HUB_EDGES = 10_000  # edges of a node that share a task


def validate_topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Violations: edge ends that are no node, and node ids given more than once."""
    known = nodes.select(F.col("node_id"))

    def dangling(end: str, label: str) -> DataFrame:
        return (
            edges.join(known, edges[end] == known["node_id"], "left_anti")
            .select(F.lit(label).alias("violation"), "from_node", "to_node", F.col(end).alias("node_id"))
        )

    repeated = (
        nodes.groupBy("node_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(
            F.lit("duplicate_node").alias("violation"),
            F.lit(None).cast("bigint").alias("from_node"),
            F.lit(None).cast("bigint").alias("to_node"),
            "node_id",
        )
    )
    return dangling("from_node", "unknown_source").unionByName(dangling("to_node", "unknown_target")).unionByName(repeated)


def ordered_edges(edges: DataFrame, order: str | None = None) -> DataFrame:
    """Edges (from_node, to_node, edge_ord); parallel edges keep the first. Default order: target id."""
    ord_col = F.col(order) if order else F.col("to_node")
    return edges.groupBy("from_node", "to_node").agg(F.min(ord_col.cast("bigint")).alias("edge_ord"))


def _adjacency(hop: DataFrame) -> DataFrame:
    """Edges with the number of edges out of and into both of their ends."""
    out = hop.groupBy("from_node").agg(F.count(F.lit(1)).alias("n"))
    into = hop.groupBy("to_node").agg(F.count(F.lit(1)).alias("n"))
    edges = hop.join(out.select("from_node", F.col("n").alias("from_out")), "from_node").join(into.select("to_node", F.col("n").alias("to_in")), "to_node")
    edges = edges.join(into.select(F.col("to_node").alias("from_node"), F.col("n").alias("from_in")), "from_node", "left")
    return cut_lineage(edges.join(out.select(F.col("from_node").alias("to_node"), F.col("n").alias("to_out")), "to_node", "left"))


class _Ball:
    """What is reached from one end of the asked pairs, level by level: start, node, ords and hops (both in the order of the path), degree.

    ``rows`` and ``cost`` are the rows of the level and the edges that the next one will meet, null before the first.
    """

    def __init__(self, starts: DataFrame, edges: DataFrame, forward: bool):
        self.forward = forward
        near, far, own, ahead = ("from_node", "to_node", "from_out", "to_out") if forward else ("to_node", "from_node", "to_in", "from_in")
        self.edges = edges.select(
            F.col(near).alias("node"), F.col(far).alias("other"), "edge_ord", F.coalesce(ahead, F.lit(0)).alias("next_degree"),
            F.pmod(F.xxhash64(far), F.ceil(F.col(own) / HUB_EDGES)).alias("salt"),
        )
        degree = edges.groupBy(F.col(near).alias("start")).agg(F.min(own).alias("degree"))
        self.level = starts.distinct().join(degree, "start", "left").select(
            "start", F.col("start").alias("node"), F.array().cast("array<bigint>").alias("ords"),
            F.array(F.col("start").cast("bigint")).alias("hops"), F.coalesce("degree", F.lit(0)).alias("degree"),
        )
        self.reached = self.level.select("start", "node")
        self.rows = self.cost = None

    def grow(self, open_starts: DataFrame) -> None:
        """One hop further from the given starts; a node reached before is left out, and of several ways to a node the first by edge order stays."""
        salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("degree") / HUB_EDGES) - 1))
        front = self.level.where("degree > 0").join(open_starts.distinct(), "start", "left_semi").withColumn("salt", salts).drop("degree")
        ords, hops = F.array(F.col("edge_ord")), F.array(F.col("other").cast("bigint"))
        step = front.join(self.edges, ["node", "salt"]).select(
            "start", F.col("other").alias("node"), F.col("next_degree").alias("degree"),
            (F.concat("ords", ords) if self.forward else F.concat(ords, "ords")).alias("ords"),
            (F.concat("hops", hops) if self.forward else F.concat(hops, "hops")).alias("hops"),
        )
        fresh = step.join(self.reached, ["start", "node"], "left_anti")
        best = fresh.groupBy("start", "node").agg(F.min(F.struct("ords", "hops")).alias("b"), F.min("degree").alias("degree"))
        seen = Observation()
        size = best.select("start", "node", "b.ords", "b.hops", "degree").observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("degree"), F.lit(0)).alias("e"))
        self.level = cut_lineage(size)
        self.rows, self.cost = seen.get["n"], seen.get["e"]
        self.reached = self.reached.unionByName(self.level.select("start", "node"))


def _with_open(state: DataFrame) -> tuple[DataFrame, int]:
    """The state of the pairs, kept, and how many of them have no path yet."""
    seen = Observation()
    state = cut_lineage(state.observe(seen, F.count_if(F.col("hops").isNull()).alias("n")))
    return state, seen.get["n"]


def _meetings(pairs: DataFrame, ahead: _Ball, back: _Ball, ahead_first: bool) -> DataFrame:
    """source, target, met (hops) of the pairs whose two levels share a node: the first path by edge order.

    One level is dealt out to the pairs, the other is looked up by start and node.
    """
    f = ahead.level.select(F.col("start").alias("source"), "node", F.col("ords").alias("o1"), F.col("hops").alias("h1"))
    b = back.level.select(F.col("start").alias("target"), "node", F.col("ords").alias("o2"), F.col("hops").alias("h2"))
    met = pairs.join(f, "source").join(b, ["target", "node"]) if ahead_first else pairs.join(b, "target").join(f, ["source", "node"])
    whole = met.select("source", "target", F.concat("o1", "o2").alias("ords"), F.concat("h1", F.slice("h2", 2, F.size("h2"))).alias("hops"))
    return whole.groupBy("source", "target").agg(F.min(F.struct("ords", "hops")).alias("b")).select("source", "target", F.col("b.hops").alias("met"))


def shortest_path(
    nodes: DataFrame, edges: DataFrame, pairs: DataFrame, max_hops: int, order: str | None = None
) -> DataFrame:
    """Fewest-hop path of each (source, target), at most ``max_hops``; ties go by edge order.

    Both ends of every asked pair are searched, each one hop at first, then the one whose next step meets fewer edges: a path of n hops
    is found when the levels n - k from the source and k from the target share a node, so no table of sources and nodes within
    ``max_hops`` is made. Ends without an open pair stop. The edges of a hub are dealt to several tasks. ``status`` is ok, no_path or
    unknown_node. Repeated pairs, nodes and edges count once; pairs with a null and empty tables give no path.
    """
    known = nodes.select(F.col("node_id")).distinct()
    asked = pairs.select("source", "target").distinct()
    none = F.array().cast("array<bigint>")
    itself = F.when(F.col("source") == F.col("target"), F.array(F.col("source").cast("bigint")))
    valid = asked.join(known, asked["source"] == known["node_id"], "left_semi").join(known, F.col("target") == known["node_id"], "left_semi")
    state, left = _with_open(valid.select("source", "target", itself.alias("hops")))
    open_ = state.where("hops is null")
    hop = _adjacency(ordered_edges(edges, order))
    ahead = _Ball(open_.select(F.col("source").alias("start")), hop, True)
    back = _Ball(open_.select(F.col("target").alias("start")), hop, False)
    for _ in range(max_hops):
        if not left or ahead.cost == 0 or back.cost == 0:
            break  # no pair is open, or one end has nowhere to go
        open_ = state.where("hops is null").select("source", "target")
        if back.cost is None and ahead.cost is not None or (ahead.cost or 0) > (back.cost or 0):
            back.grow(open_.select(F.col("target").alias("start")))
        else:
            ahead.grow(open_.select(F.col("source").alias("start")))
        met = _meetings(open_, ahead, back, (ahead.rows or 0) <= (back.rows or 0))
        state, left = _with_open(state.join(met, ["source", "target"], "left").select("source", "target", F.coalesce("hops", "met").alias("hops")))
    out = asked.join(state.withColumn("__valid", F.lit(True)), ["source", "target"], "left")
    total = F.size("hops").cast("bigint") - 1
    got = F.col("hops").isNotNull()
    return out.select(
        "source",
        "target",
        F.when(got, F.lit("ok")).when(F.col("__valid"), F.lit("no_path")).otherwise(F.lit("unknown_node")).alias("status"),
        F.coalesce(F.when(got, total), F.lit(-1)).alias("total_hops"),
        F.when(got, F.col("hops")).otherwise(none).alias("hops"),
    )


def hops_text(hops: Column) -> Column:
    return F.array_join(F.transform(hops, lambda h: h.cast("string")), ">")


def _legs(paths: DataFrame, keys: list[str]) -> DataFrame:
    """One row per edge of each path."""
    n = F.size("hops")
    legs = F.when(
        n > 1,
        F.transform(
            F.sequence(F.lit(1), n - 1),
            lambda i: F.struct(F.element_at("hops", i).alias("from_node"), F.element_at("hops", i + 1).alias("to_node")),
        ),
    )
    return paths.select(*keys, F.posexplode(legs).alias("leg", "e")).select(*keys, "leg", "e.*")


def path_flags(paths: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Hops, latency (10 ms per hop) and whether any edge needs encryption or approval."""
    rules = edges.groupBy("from_node", "to_node").agg(
        F.bool_or("require_encryption").alias("enc"), F.bool_or("require_approval").alias("app")
    )
    flags = (
        _legs(paths, keys)
        .join(rules, ["from_node", "to_node"], "left")
        .groupBy(*keys)
        .agg(F.bool_or(F.coalesce("enc", F.lit(False))).alias("enc"), F.bool_or(F.coalesce("app", F.lit(False))).alias("app"))
    )
    return paths.join(flags, keys, "left").select(
        *keys,
        "total_hops",
        (F.greatest(F.col("total_hops"), F.lit(0)) * LATENCY_MS_PER_HOP).alias("latency_ms"),
        F.coalesce("enc", F.lit(False)).alias("requires_encryption"),
        F.coalesce("app", F.lit(False)).alias("requires_approval"),
    )


def local_egress(pairs: DataFrame, egress: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs served by the source's own egress list and a direct edge. ``egress``: node_id, target."""
    own = egress.select(F.col("node_id").alias("source"), "target").distinct()
    direct = edges.select(F.col("from_node").alias("source"), F.col("to_node").alias("target")).distinct()
    return pairs.join(own, ["source", "target"], "left_semi").join(direct, ["source", "target"], "left_semi")


def egress_first(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, egress: DataFrame, max_hops: int) -> DataFrame:
    """Local egress where it applies, else the shortest path."""
    local = local_egress(pairs, egress, edges).select(
        "source",
        "target",
        F.lit("local_egress").alias("via"),
        F.lit(1).cast("bigint").alias("total_hops"),
        F.array("source", "target").cast("array<bigint>").alias("hops"),
    )
    rest = pairs.join(local, ["source", "target"], "left_anti")
    routed = shortest_path(nodes, edges, rest, max_hops).select("source", "target", F.col("status").alias("via"), "total_hops", "hops")
    return local.unionByName(routed)


def hub_path(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, hubs: list[int], max_hops: int) -> DataFrame:
    """Best source → hub → target over the hubs; the first hub wins ties."""
    if not hubs:
        raise ValueError("at least one hub is needed")
    spark = pairs.sparkSession
    hub = F.broadcast(spark.createDataFrame([(h, i) for i, h in enumerate(hubs)], "hub bigint, hub_ord bigint"))
    legs = pairs.select("source", "target").distinct().withColumn("h", F.explode(F.array(*[F.lit(h).cast("bigint") for h in hubs])))
    ask = legs.select("source", F.col("h").alias("target")).unionByName(legs.select(F.col("h").alias("source"), "target")).distinct()
    paths = shortest_path(nodes, edges, ask, max_hops).where("status = 'ok'").select("source", "target", "hops")
    first = paths.select("source", F.col("target").alias("h"), F.col("hops").alias("to_hub"))
    second = paths.select(F.col("source").alias("h"), "target", F.col("hops").alias("from_hub"))
    whole = (
        legs.join(first, ["source", "h"])
        .join(second, ["h", "target"])
        .join(hub, F.col("h") == F.col("hub"))
        .select("source", "target", "hub", "hub_ord", F.concat("to_hub", F.slice("from_hub", 2, F.size("from_hub"))).alias("hops"))
    )
    return whole.groupBy("source", "target").agg(
        F.min(F.struct(F.size("hops").alias("n"), "hub_ord", "hub", "hops")).alias("b")
    ).select("source", "target", "b.hub", (F.col("b.n") - 1).cast("bigint").alias("total_hops"), "b.hops")


def validate_path(paths: DataFrame, edges: DataFrame, key: str, max_hops: int) -> DataFrame:
    """Verdict per given path: ok, empty, too_long or missing_edge."""
    real = edges.select("from_node", "to_node").distinct()
    broken = _legs(paths, [key]).join(real, ["from_node", "to_node"], "left_anti").select(key).distinct().withColumn("__gap", F.lit(True))
    return paths.join(broken, key, "left").select(
        key,
        F.when(F.size("hops") < 1, F.lit("empty"))
        .when(F.size("hops") - 1 > max_hops, F.lit("too_long"))
        .when(F.col("__gap"), F.lit("missing_edge"))
        .otherwise(F.lit("ok"))
        .alias("verdict"),
    )


def edges_of(edges: DataFrame) -> DataFrame:
    """Out- and in-degree per node; nodes with only one of them appear too."""
    out = edges.groupBy(F.col("from_node").alias("node_id")).agg(F.count(F.lit(1)).alias("out_edges"))
    into = edges.groupBy(F.col("to_node").alias("node_id")).agg(F.count(F.lit(1)).alias("in_edges"))
    return out.join(into, "node_id", "full_outer").select(
        "node_id", F.coalesce("out_edges", F.lit(0)).alias("out_edges"), F.coalesce("in_edges", F.lit(0)).alias("in_edges")
    )


def healthy_nodes(nodes: DataFrame, breakers: DataFrame) -> DataFrame:
    """Nodes that are not unhealthy and whose breaker is not open, by tier. ``breakers``: node_id, state."""
    shut = breakers.where("state = 'open'").select("node_id")
    return nodes.where("health <> 'unhealthy'").join(shut, "node_id", "left_anti").orderBy("tier", "node_id")


# ---- breakers and limits: ordered folds ----
def circuit_states(
    events: DataFrame,
    node: str,
    order: list[str],
    ok: str,
    ts: str,
    threshold: int = 3,
    heartbeat_seconds: int = 30,
    bucket_seconds: int = 86400,
) -> DataFrame:
    """Adds state and failures after each report: open after ``threshold`` failures in a row, half-open after
    three heartbeats, closed by a success then, reopened by a failure.

    Where a breaker opens again follows from where it opened: the first report after the heartbeats reopens it if it failed, else
    the next run of ``threshold`` failures does. Every failure therefore has at most one successor, and the openings are those reached from a
    node's first run; jumps are doubled, so one node may hold all reports. A null node is a node of its own, a null outcome is a failure, and
    ``ts`` must not be null. A threshold of 0 never opens.
    """
    bucket = time_bucket(F.col(ts), bucket_seconds)
    cooldown = 3 * heartbeat_seconds
    good = F.coalesce(F.col(ok), F.lit(False))
    base = cut_lineage(events.withColumn("__id", F.monotonically_increasing_id()))
    rows = with_running_sum(base, [node], order, F.when(good, F.lit(0)).otherwise(F.lit(1)), "__bad", bucket)
    rows = with_running_max(rows, [node], order, F.when(good, F.col("__bad")), "__before", bucket)
    rows = rows.withColumn("failures", (F.col("__bad") - F.coalesce("__before", F.lit(0))).cast("bigint")).drop("__bad", "__before")
    opens = F.when(F.col("failures") == (threshold if threshold > 0 else -1), F.col("__id"))
    rows = cut_lineage(with_next_marked(rows, [node], order, opens, "__opens", bucket))
    after = next_after(rows, [node], order, ts, "__id", cooldown, max(bucket_seconds, cooldown))
    tried = rows.select(F.col("__id").alias("next_id"), F.when(good, F.col("__opens")).otherwise(F.col("__id")).alias("to"))
    jumps = rows.where(~good).select("__id").join(after, "__id").join(tried, "next_id").select(F.col("__id").alias("at"), "to")
    firsts = rows.where(F.col("__opens") == F.col("__id")).groupBy(node).agg(F.min_by("__id", F.struct(*order)).alias("at"))
    openings = reached(jumps, firsts).select(F.col("at").alias("__id"), F.lit(True).alias("__opening"))
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    marked = rows.drop("__opens").join(openings, "__id", "left").withColumn("__t", micros)
    since = with_running_max(marked, [node], order, F.when(F.col("__opening"), F.col("__t")), "__since", bucket)
    open_ = F.coalesce(F.col("__opening") | (F.col("__t") - F.col("__since") < cooldown * 1_000_000), F.lit(False))
    return since.select(*events.columns, F.when(open_, F.lit("open")).otherwise(F.lit("closed")).alias("state"), "failures")


def limit_fold(limit_col: str, window_seconds: int, ts: str, zero_is_unlimited: bool = False):
    """Fold for ``fold_in_order``: allow while fewer than the limit were allowed in the window.

    A limit of 0 denies everything, or nothing with ``zero_is_unlimited``. A denied request with nothing in the window to
    wait for resets one window later.
    """
    window = window_seconds * 1_000_000

    def fold(state, rows):
        from collections import deque

        recent = deque(json.loads(state)) if state else deque()
        allowed, remaining, reset = [], [], []
        times = rows[ts].astype("datetime64[us]").astype("int64")
        last = 0
        for t, limit in zip(times, rows[limit_col]):
            last = int(t)
            while recent and recent[0] <= t - window:
                recent.popleft()
            free = zero_is_unlimited and limit == 0
            if free or len(recent) < limit:
                if limit:
                    recent.append(last)
                allowed.append(True)
                remaining.append(int(limit) - len(recent) if limit else -1)
                reset.append(last + window)
            else:
                allowed.append(False)
                remaining.append(0)
                reset.append((recent[0] if recent else last) + window)
        while recent and recent[0] <= last - window:
            recent.popleft()
        return json.dumps(list(recent)) if recent else "", {"allowed": allowed, "remaining": remaining, "reset_at_us": reset}

    return fold


def rate_limit(
    events: DataFrame, key: str, order: list[str], ts: str, limit: int, window_seconds: int, bucket_seconds: int | None = None
) -> DataFrame:
    """Sliding-window limiter; denied requests are not recorded, and a limit of 0 denies all. Adds allowed, remaining, reset_at_us."""
    with_limit = events.withColumn("__limit", F.lit(limit).cast("bigint"))
    bucket = time_bucket(F.col(ts), bucket_seconds or max(86400, window_seconds))
    return fold_in_order(
        with_limit, [key], order, bucket, limit_fold("__limit", window_seconds, ts), "allowed boolean, remaining bigint, reset_at_us bigint"
    ).drop("__limit")


def hourly_limit(events: DataFrame, accounts: DataFrame, account: str, order: list[str], ts: str, bucket_seconds: int = 86400) -> DataFrame:
    """Per-account hourly limit (``hourly_limit``; 0 = unlimited). Unknown accounts are denied."""
    joined = events.join(accounts.select(account, F.col("hourly_limit").cast("bigint").alias("__limit")), account, "left")
    known = joined.where("__limit is not null")
    judged = fold_in_order(
        known, [account], order, time_bucket(F.col(ts), bucket_seconds), limit_fold("__limit", 3600, ts, zero_is_unlimited=True),
        "allowed boolean, remaining bigint, reset_at_us bigint",
    ).select(*events.columns, "allowed")
    unknown = joined.where("__limit is null").select(*events.columns, F.lit(False).alias("allowed"))
    return judged.unionByName(unknown)


def failure_runs(events: DataFrame, key: str, order: list[str], ok: str, ts: str, min_length: int = 1, bucket_seconds: int = 3600) -> DataFrame:
    """Runs of consecutive failures per key: start, end, length.

    A run is numbered by the changes of outcome before it, which is a running sum over buckets.
    """
    bucket = time_bucket(F.col(ts), bucket_seconds)
    prev = with_previous(events, [key], order, {"__prev": ok}, bucket)
    change = F.when(F.col("__prev").isNull() | (F.col("__prev") != F.col(ok)), F.lit(1)).otherwise(F.lit(0))
    numbered = with_running_sum(prev.withColumn("__change", change), [key], order, F.col("__change"), "run_no", bucket)
    return (
        numbered.where(~F.col(ok))
        .groupBy(key, "run_no")
        .agg(F.min(ts).alias("run_start"), F.max(ts).alias("run_end"), F.count(F.lit(1)).alias("failures"))
        .where(F.col("failures") >= min_length)
        .drop("run_no")
    )


def trailing_rate(events: DataFrame, key: str, ts: str, window_seconds: int, id_col: str) -> DataFrame:
    """All requests of the key in the trailing window of each request."""
    return trailing_count(events, [key], ts, window_seconds, "requests_in_window", id_col)


def transfer_result(hops: DataFrame, by: list[str], ok: str = "ok", path_hops: str | None = None) -> DataFrame:
    """Chunks sent and failed, latency and overall success per transfer."""
    n_hops = F.max(path_hops) if path_hops else F.lit(1)
    return hops.groupBy(*by).agg(
        F.count_if(ok).alias("chunks_ok"),
        F.count_if(~F.col(ok)).alias("chunks_failed"),
        (n_hops * LATENCY_MS_PER_HOP).cast("bigint").alias("latency_ms"),
        F.bool_and(ok).alias("success"),
    )


def overall_health(checks: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """Unhealthy if any part is, else degraded if any is degraded or unknown, else healthy."""
    s = F.col(status)
    return checks.groupBy(*by).agg(
        F.when(F.bool_or(s == "unhealthy"), F.lit("unhealthy"))
        .when(F.bool_or(s.isin("degraded", "unknown")), F.lit("degraded"))
        .otherwise(F.lit("healthy"))
        .alias("overall")
    )


def posture_score(
    devices: DataFrame,
    min_score: int = 70,
    failure_action: str = "block",
    require_antivirus: bool = True,
    require_edr: bool = True,
) -> DataFrame:
    """Device score: 100 less 30 (system), 25 (antivirus), 20 or 10 (patches), 5 (EDR).

    A failed critical check blocks whatever the score; below the minimum the failure action applies.
    """
    os_bad = ~F.col("os_supported")
    av_bad = ~F.col("antivirus_enabled") if require_antivirus else F.lit(False)
    patch_bad = ~(F.col("patch_compliant") & (F.col("critical_patches_missing") == 0))
    patch_critical = patch_bad & (F.col("critical_patches_missing") > 0)
    edr_bad = ~F.col("edr_present") if require_edr else F.lit(False)

    def cost(test: Column, points: int) -> Column:
        return F.when(test, F.lit(points)).otherwise(F.lit(0))

    score = 100 - cost(os_bad, 30) - cost(av_bad, 25) - cost(patch_critical, 20) - cost(patch_bad & ~patch_critical, 10) - cost(edr_bad, 5)
    failed = F.array_compact(
        F.array(F.when(os_bad, F.lit("os_version")), F.when(av_bad, F.lit("antivirus")), F.when(patch_critical, F.lit("patch_compliance")))
    )
    staged = devices.withColumns(
        {"score": F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("bigint"), "failed_critical": F.array_join(failed, ",")}
    )
    low = F.col("score") < min_score
    return staged.withColumn(
        "action",
        F.when(F.col("failed_critical") != "", F.lit("block")).when(low, F.lit(failure_action)).otherwise(F.lit("allow")),
    ).withColumn("allowed", F.col("action") != "block")


def fingerprint_similarity(a: DataFrame, b: DataFrame, device: str, threshold: float = 0.7) -> DataFrame:
    """Weighted match of two fingerprints per device: user agent 0.4, canvas 0.3 if both have one, screen 0.3."""
    other = b.select(device, F.col("user_agent").alias("__ua"), F.col("canvas_hash").alias("__canvas"), F.col("screen").alias("__screen"))
    j = a.join(other, device)
    both = F.col("canvas_hash").isNotNull() & F.col("__canvas").isNotNull()
    same = (
        F.when(F.col("user_agent") == F.col("__ua"), F.lit(0.4)).otherwise(F.lit(0.0))
        + F.when(both & (F.col("canvas_hash") == F.col("__canvas")), F.lit(0.3)).otherwise(F.lit(0.0))
        + F.when(F.col("screen").eqNullSafe(F.col("__screen")), F.lit(0.3)).otherwise(F.lit(0.0))
    )
    total = F.lit(0.7) + F.when(both, F.lit(0.3)).otherwise(F.lit(0.0))
    scored = j.withColumn("similarity", same / total)
    return scored.select(device, "similarity", (F.col("similarity") >= threshold).alias("same_device"))
