import datetime as dt
import random
from collections import deque

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewall.operators import audit as U
from tidewall.operators import calendar as C
from tidewall.operators import integrity as I
from tidewall.operators import lifecycle as L
from tidewall.operators import network as N
from tidewall.sources import text as X


def test_chunks_round_trip(spark):
    rows = [(1, "日本語" * 500), (2, ""), (3, "x" * 129), (4, "line\nbreak " * 40)]
    df = spark.createDataFrame(rows, "id int, t string")
    parts = I.chunk(df, "id", "t", 64)
    files = df.select("id", F.md5("t").alias("file_md5"))
    back = I.reassemble(parts.orderBy(F.rand(1)), files, "id").collect()
    assert {r.id: r.content for r in back} == dict(rows) and all(r.status == "ok" for r in back)
    small = {r.id: r.status for r in I.reassemble(parts, files, "id", max_bytes=200).collect()}
    assert small == {1: "too_large", 2: "ok", 3: "ok", 4: "too_large"}
    blob = df.select("id", F.col("t").cast("binary").alias("b"))
    whole = I.chunk(blob, "id", "b", 50).groupBy("id").agg(F.sum("chunk_size").alias("n")).collect()
    assert {r.id: r.n for r in whole} == {i: len(t.encode()) for i, t in rows}


def test_repeated_chunks_reassemble_in_joins_of_both_kinds(spark, tmp_path):
    """The query's chunks come twice and meet their files in joins without a broadcast, as large tables do, and with one: a file is one row."""
    import hashlib

    from tidewall.plans.catalog import QUERIES, load_all

    load_all()
    rows = [(1, "日本語" * 90), (2, "x" * 64 * 9 + "y"), (3, ""), (4, "z" * 64 * 30), (5, None), (None, "no key"), (6, "short"), (6, "short")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def sent(i, text):
        cut = [text[k : k + 64] for k in range(0, max(len(text), 1), 64)]
        return len(cut), "".join(c + "!" * ((i * 7 + k * 13) % 29 == 0 and i % 2 == 0) for k, c in enumerate(cut))

    want = []
    for i, text in rows:
        if i is not None and text is not None:
            n, content = sent(i, text)
            want.append((i, n, hashlib.md5(content.encode()).hexdigest(), "ok" if content == text else "hash_mismatch"))
    assert {w[3] for w in want} == {"ok", "hash_mismatch"}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            got = [(r.doc_id, r.chunk_count, r.content_md5, r.status) for r in QUERIES["I9_reassemble"](spark, str(tmp_path)).collect()]
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert sorted(got) == sorted(want), limit


def test_hash_trees_of_files(spark):
    """Roots equal a plain tree; a changed, moved, lost or added page gives another root; pages come with their places."""
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [(1, "x" * 1000), (2, ""), (3, "日本語" * 30), (None, "null key"), (5, "y" * 64 * 9)]
    parts = I.chunk(spark.createDataFrame(rows, "id int, t string").where("id is not null"), "id", "t", 64)

    def plain(text):
        level = [sha(f"{i}:{sha(p)}") for i, p in enumerate([text[k : k + 64] for k in range(0, max(len(text), 1), 64)])]
        while len(level) > 1:
            level = [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)]
        return level[0]

    roots = I.merkle_roots(parts.union(parts), "id", fanout=3)
    got = {r.id: r for r in roots.collect()}
    assert {k: r.root for k, r in got.items()} == {k: plain(t) for k, t in rows if k}
    assert {k: r.total_size for k, r in got.items()} == {k: len(t.encode()) for k, t in rows if k}
    last = F.max("chunk_index").over(Window.partitionBy("id"))
    worse = {
        "changed": parts.withColumn("data", F.when(F.col("chunk_index") == 1, F.lit("?")).otherwise(F.col("data"))),
        "lost": parts.withColumn("l", last).where("chunk_index < l or l = 0").drop("l"),
        "moved": parts.withColumn("chunk_index", F.when(F.col("chunk_index") < 2, 1 - F.col("chunk_index")).otherwise(F.col("chunk_index"))),
    }
    files = roots.select("id", "root")
    for name, sent in worse.items():
        status = {r.id: r.status for r in I.verified_pages(sent, files, "id", fanout=3).collect()}
        assert status[1] == ("ok" if name == "moved" else "hash_mismatch"), name  # the first pages of file 1 are equal but for their places
    pages = I.verified_pages(parts.orderBy(F.rand(2)), files, "id", fanout=3).collect()
    assert {r.status for r in pages} == {"ok"}
    for k, t in rows:
        if k:
            mine = sorted((r for r in pages if r.id == k), key=lambda r: r.chunk_index)
            assert "".join(r.data for r in mine) == t
            assert [r.start for r in mine] == [len(t[: 64 * i].encode()) for i in range(len(mine))]
    assert I.merkle_roots(parts.where("false"), "id").count() == 0


def test_day_roots_see_every_change(spark):
    rows = [(dt.date(2024, 1, 1 + i % 2), f"{i * 2654435761 % 2**32:08x}") for i in range(300)] + [(dt.date(2024, 1, 1), "00000000")] * 5
    df = spark.createDataFrame(rows, "event_date date, link_hash string")
    base = {r.event_date: (r.events, r.root) for r in U.day_roots(df, 2).collect()}
    again = {r.event_date: (r.events, r.root) for r in U.day_roots(df.repartition(7), 2).collect()}
    assert base == again and base[dt.date(2024, 1, 1)][0] == 155
    for other in (df.limit(304), df.union(df.limit(1)), df.withColumn("link_hash", F.regexp_replace("link_hash", "^0000000", "1000000"))):
        got = {r.event_date: (r.events, r.root) for r in U.day_roots(other, 2).collect()}
        assert got[dt.date(2024, 1, 1)] != base[dt.date(2024, 1, 1)]


def test_envelope_reasons(spark):
    df = spark.createDataFrame([(1, "a" * 200)], "id int, t string")
    sealed = I.envelopes(I.chunk(df, "id", "t", 64), "id")
    assert {r.verdict for r in I.verify_envelopes(sealed).collect()} == {"ok"}
    cut = sealed.withColumn("previous_chunk_hash", F.lit(None).cast("string"))
    cut = cut.withColumn("envelope_hash", I.seal(F.col("chunk_index"), F.col("data_hash"), F.col("sequence_nonce"), F.col("previous_chunk_hash")))
    assert [r.verdict for r in I.verify_envelopes(cut).orderBy("chunk_index").collect()] == ["ok", "missing_link", "missing_link", "missing_link"]
    zero = sealed.withColumn("sequence_nonce", F.lit(0).cast("bigint"))
    zero = zero.withColumn("envelope_hash", I.seal(F.col("chunk_index"), F.col("data_hash"), F.col("sequence_nonce"), F.col("previous_chunk_hash")))
    assert [r.verdict for r in I.verify_envelopes(zero).orderBy("chunk_index").collect()][:2] == ["ok", "nonce"]


def test_empty_chunk_under_zero_tolerance(spark):
    parts = I.chunk(spark.createDataFrame([(1, "")], "id int, t string"), "id", "t", 8)
    sealed = I.envelopes(parts, "id")
    assert I.verify_chunks(parts, sealed, "id").first().corrupt
    assert not I.verify_chunks(parts, sealed, "id", zero_tolerance=False).first().corrupt


def test_missing_modes(spark):
    got = spark.createDataFrame([(1, 0), (1, 2), (1, 2)], "id int, chunk_index bigint")
    want = spark.createDataFrame([(1, 4), (2, 1)], "id int, expected_count bigint")
    assert {(r.id, r.chunk_index) for r in I.missing_chunks(got, want, "id").collect()} == {(1, 1), (1, 3), (2, 0)}
    assert {(r.id, r.chunk_index) for r in I.missing_chunks(got, want, "id", mode="tail").collect()} == {(1, 2), (1, 3), (2, 0)}


def test_repair_and_backoff(spark):
    none = spark.createDataFrame([], "ok boolean")
    assert I.repair_totals(none).first().success_rate == 1.0
    df = spark.createDataFrame([(1, 7), (2, 0)], "id int, n int")
    rows = I.backoff(df, "id", "n").orderBy("attempt").collect()
    assert [r.wait_seconds for r in rows] == [1, 2, 4, 8, 16, 30, 30] and rows[-1].elapsed_seconds == 91


def bfs(edges, a, b, limit):
    if a == b:
        return [a]
    seen, queue = {a}, deque([[a]])
    while queue:
        path = queue.popleft()
        for n in sorted(edges.get(path[-1], ())):
            if n in seen or len(path) > limit:
                continue
            if n == b:
                return path + [n]
            seen.add(n)
            queue.append(path + [n])
    return None


def test_shortest_paths_equal_bfs(spark):
    rnd = random.Random(11)
    pairs = {(rnd.randrange(18), rnd.randrange(18)) for _ in range(34)}
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
    nodes = spark.range(18).withColumnRenamed("id", "node_id")
    edges = spark.createDataFrame(sorted(pairs), "from_node bigint, to_node bigint")
    ask = [(a, b) for a in range(0, 18, 3) for b in range(20)]
    out = N.shortest_path(nodes, edges, spark.createDataFrame(ask, "source bigint, target bigint"), 3).collect()
    assert len(out) == len(ask)
    for r in out:
        want = None if r.target > 17 else bfs(adj, r.source, r.target, 3)
        if want is None:
            assert r.status == ("unknown_node" if r.target > 17 else "no_path") and r.total_hops == -1
        else:
            assert (list(r.hops), r.total_hops, r.status) == (want, len(want) - 1, "ok")


@pytest.mark.parametrize("hops", [1, 2, 5])
def test_paths_from_both_ends_equal_bfs(spark, hops):
    """Ties go by edge order, here not the order of the nodes; repeated edges, nodes and pairs count once."""
    rnd = random.Random(40 + hops)
    links = {(rnd.randrange(60), rnd.randrange(60)): rnd.random() for _ in range(130)}
    ranked = {e: i for i, e in enumerate(sorted(links, key=links.get))}
    adj = {}
    for a, b in sorted(ranked, key=ranked.get):
        adj.setdefault(a, []).append(b)
    edges = spark.createDataFrame([(a, b, i) for (a, b), i in ranked.items()] * 2, "from_node bigint, to_node bigint, at bigint")
    nodes = spark.range(60).withColumnRenamed("id", "node_id")
    ask = [(rnd.randrange(60), rnd.randrange(62)) for _ in range(300)] + [(7, b) for b in range(60)]

    def first_path(a, b):
        seen, queue = {a}, deque([[a]])
        while queue:
            path = queue.popleft()
            if path[-1] == b:
                return path
            if len(path) <= hops:
                for n in adj.get(path[-1], []):
                    if n not in seen:
                        seen.add(n)
                        queue.append([*path, n])

    got = N.shortest_path(nodes.union(nodes), edges, spark.createDataFrame(ask, "source bigint, target bigint"), hops, order="at").collect()
    assert len(got) == len(set(ask))
    for r in got:
        want = first_path(r.source, r.target) if r.target < 60 else None
        assert list(r.hops) == (want or []), (r, want)


def test_paths_through_a_hub(spark):
    """100,000 edges out of one node, which a third of the pairs start from and many paths cross."""
    n = 100_000
    out = spark.range(1, n + 1).selectExpr("0L as from_node", "id as to_node")
    back = spark.range(1, n + 1).where("id % 1000 = 0").selectExpr("id as from_node", "id + 1000000 as to_node")
    into = spark.range(2_000_000, 2_000_030).selectExpr("id as from_node", "0L as to_node")
    edges = out.union(back).union(into)
    nodes = edges.select("from_node").union(edges.select("to_node")).distinct().withColumnRenamed("from_node", "node_id")
    ask = [(0, 5), (0, 1_001_000), (2_000_003, 1_005_000), (2_000_004, 77), (1_001_000, 0)]
    got = {(r.source, r.target): list(r.hops) for r in N.shortest_path(nodes, edges, spark.createDataFrame(ask, "source bigint, target bigint"), 3).collect()}
    assert got == {
        (0, 5): [0, 5], (0, 1_001_000): [0, 1000, 1_001_000], (2_000_003, 1_005_000): [2_000_003, 0, 5000, 1_005_000], (2_000_004, 77): [2_000_004, 0, 77],
        (1_001_000, 0): [],
    }


def test_paths_in_empty_tables(spark):
    none = spark.createDataFrame([], "source bigint, target bigint")
    nodes, edges = spark.range(3).withColumnRenamed("id", "node_id"), spark.createDataFrame([(0, 1)], "from_node bigint, to_node bigint")
    assert N.shortest_path(nodes, edges, none, 3).count() == 0
    ask = spark.createDataFrame([(0, 1), (0, 0), (None, 1)], "source bigint, target bigint")
    got = N.shortest_path(nodes, edges.where("false"), ask, 3).collect()
    assert {(r.source, r.target): r.status for r in got} == {(0, 1): "no_path", (0, 0): "ok", (None, 1): "unknown_node"}
    assert {r.status for r in N.shortest_path(nodes.where("false"), edges, ask, 3).collect()} == {"unknown_node"}


def test_hourly_limit(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, a, t0 + dt.timedelta(minutes=20 * i)) for i in range(6) for a in ("two", "free", "unknown")]
    ev = spark.createDataFrame([(n, a, t) for n, (_, a, t) in enumerate(rows)], "id int, account string, ts timestamp")
    acc = spark.createDataFrame([("two", 2), ("free", 0)], "account string, hourly_limit int")
    out = N.hourly_limit(ev, acc, "account", ["ts", "id"], "ts").orderBy("ts", "id").collect()
    assert [r.allowed for r in out if r.account == "two"] == [True, True, False, True, True, False]
    assert all(r.allowed for r in out if r.account == "free") and not any(r.allowed for r in out if r.account == "unknown")


def test_posture(spark):
    df = spark.createDataFrame(
        [(1, True, True, 0, True, True), (2, False, False, 2, False, False), (3, True, True, 0, False, False)],
        "id int, os_supported boolean, antivirus_enabled boolean, critical_patches_missing int, patch_compliant boolean, edr_present boolean",
    )
    got = [(r.score, r.action, r.failed_critical) for r in N.posture_score(df, 90, "warn").collect()]
    assert got == [(100, "allow", ""), (20, "block", "os_version,antivirus,patch_compliance"), (85, "warn", "")]


@pytest.mark.parametrize(
    "day,name,year", [("1989-01-07", "Showa", 64), ("1989-01-08", "Heisei", 1), ("2019-04-30", "Heisei", 31), ("2019-05-01", "Reiwa", 1), ("1868-01-24", None, None)]
)
def test_eras(spark, day, name, year):
    r = C.to_era(spark.createDataFrame([(day,)], "d string"), "d").first()
    assert (r.era_name, r.era_year) == (name, year)


def test_holidays_and_business_days(spark):
    days = dict(C.holiday_list())
    assert len(C.holiday_list()) == 11 * 16
    assert days[dt.date(2024, 1, 8)] == "Coming of Age Day" and days[dt.date(2024, 9, 22)] == "Autumn Equinox Day"
    off = set(days)
    rnd = random.Random(2)
    rows = []
    for _ in range(60):
        a = dt.date(2021, 1, 1) + dt.timedelta(days=rnd.randrange(2000))
        rows.append((a, a + dt.timedelta(days=rnd.randrange(-3, 60))))
    out = C.business_days(spark.createDataFrame(rows, "a date, b date"), "a", "b", list(off)).collect()
    for r in out:
        span = [r.a + dt.timedelta(days=i) for i in range((r.b - r.a).days + 1)]
        assert r.business_days == sum(1 for d in span if d.weekday() < 5 and d not in off)


def test_era_filename(spark):
    df = spark.createDataFrame([("doc_R06.pdf",), ("令和8年.txt",), ("H31昭和5",), ("plain",)], "n string")
    assert [r[0] for r in df.select(C.era_in_filename(F.col("n"))).collect()] == [2024, 2026, 2019, None]


def test_votes(spark):
    t = [dt.datetime(2024, 1, 1, 0, i) for i in range(6)]
    votes = [(1, "a", t[0], 1, True), (1, "a", t[1], 2, False), (1, "b", t[2], 3, True), (1, "c", t[3], 4, False), (2, "a", t[0], 5, True), (3, "a", t[0], 6, True), (3, "b", t[1], 7, False), (3, "c", t[2], 8, True)]
    v = spark.createDataFrame(votes, "request_id int, approver_id string, voted_at timestamp, event_id int, approved boolean")
    r = spark.createDataFrame([(1, 2), (2, 2), (3, 2), (4, 1)], "request_id int, required_approvers int")
    got = {x.request_id: (x.status, x.approvals, x.counted_votes) for x in L.tally_votes(v, r).collect()}
    assert got == {1: ("approved", 2, 2), 2: ("pending", 1, 1), 3: ("rejected", 1, 2), 4: ("pending", 0, 0)}


def test_filename_patterns(spark):
    df = spark.createDataFrame([("ok_7.txt",), ("ok_.txt",), ("no_9.txt",), ("ok_.tx",)], "n string")
    got = [(r.decided_file_id, r.target_state) for r in L.classify_filename(df, "n", "ok_{file_id}.txt", "no_{file_id}.txt").collect()]
    assert got == [("7", "approved"), (None, None), ("9", "rejected"), (None, None)]
    assert spark.range(1).select(L.id_from_filename(F.lit("x"), "no place")).first()[0] is None


def test_cef_and_csv(spark):
    row = [("e1", dt.datetime(2024, 1, 1), "security_violation", "a=b", "A|B", "f,1", False, "bad\nline", None)]
    df = spark.createDataFrame(row, "event_id string, ts timestamp, event_type string, actor_id string, actor_name string, filename string, success boolean, error_message string, ip_address string")
    line = U.audit_cef(df, "V", "P|x", "1").first().line
    assert line.startswith("CEF:0|V|P\\|x|1|security_violation|security_violation FAILED: bad\nline|10|suser=a\\=b act=")
    assert "src=" not in line and "filePath=f\\,1" in line and line.endswith("msg=security_violation FAILED: bad\\nline")
    audit = U.to_audit(df, {"event_id": F.col("event_id"), "success": F.col("success"), "error_message": F.lit(None)})
    assert len(audit.columns) == 28 and U.audit_csv(audit).first().status == "ERROR"


def test_csv_text(spark):
    doc = 'a,b,c\r\n1,"x, ""y""",3\r\n\r\n,,\r\n4\r\n5,6,7,8\r\n'
    df = spark.createDataFrame([(1, doc), (2, None)], "id int, t string")
    cells = [(r.row_index, r.column_name, r.value) for r in X.read_csv_text(df, "id", "t").orderBy("row_index", "col_index").collect()]
    assert cells == [(0, "a", "1"), (0, "b", 'x, "y"'), (0, "c", "3"), (2, "a", "4"), (3, "a", "5"), (3, "b", "6"), (3, "c", "7"), (3, "column_3", "8")]
    assert X.read_csv_text(df, "id", "t", X.CsvOptions(max_rows=1)).select("row_index").distinct().count() == 1


def test_xml_depth(spark):
    df = spark.createDataFrame([("<a><b><c/></b></a>",), ("<a/>",)], "t string")
    assert [r[0] for r in df.select(X.xml_depth(F.col("t"))).collect()] == [2, 0]


def test_hard_csv(spark):
    long = "q" * 20_000
    doc = f'id,note\r\n1,"{long}\nsecond ""line"""\n,\n\n2,plain "x"\r3,"a,b",extra\n4'
    df = spark.createDataFrame([(1, doc), (2, None), (3, "")], "id int, t string")
    got = {(r.row_index, r.column_name): r.value for r in X.read_csv_text(df, "id", "t").collect()}
    assert got == {
        (0, "id"): "1", (0, "note"): f'{long}\nsecond "line"', (2, "id"): "2", (2, "note"): 'plain "x"',
        (3, "id"): "3", (3, "note"): "a,b", (3, "column_2"): "extra", (4, "id"): "4",
    }
    assert {r.row_index for r in X.read_csv_text(df, "id", "t", X.CsvOptions(max_rows=2)).collect()} == {0}


def test_a_huge_declared_count_is_dealt_out(spark):
    expected = spark.createDataFrame([(1, 3000), (2, 0), (3, 1)], "id int, expected_count bigint")
    have = spark.createDataFrame([(1, i) for i in range(0, 3000, 2)], "id int, chunk_index bigint")
    got = {(r.id, r.chunk_index) for r in I.missing_chunks(have, expected, "id", "expected_count").collect()}
    assert got == {(1, i) for i in range(1, 3000, 2)} | {(3, 0)}


def test_chunks_dealt_out_by_file_are_not_moved_again(spark):
    """Only rows of whole texts and of nodes travel: no exchange lies above the chunks."""
    from tidewall.plans import catalog
    from tidewall.plans.catalog import integrity as Q

    catalog.load_all()
    d = "/root/testdata/sf0.01"

    def exchanges_over_chunks(df):
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
        at = [i for i, x in enumerate(plan) if "Generate posexplode" in x]
        depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
        above = []
        for i in at:
            d0 = depth(plan[i])
            for x in reversed(plan[:i]):
                if depth(x) < d0:
                    d0 = depth(x)
                    above.append(x)
                    if "partial_" in x:  # one row per file or run of chunks from here on
                        break
        return [x for x in above if "Exchange" in x]

    assert exchanges_over_chunks(I.envelopes(Q.parts(spark, d), "doc_id")) == []
    assert exchanges_over_chunks(I._pages_once(Q.parts(spark, d), "doc_id", "data", 256)) == []
