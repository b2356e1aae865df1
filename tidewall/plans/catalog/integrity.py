"""Chunks, hash chains, completeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewall.operators import integrity as I
from tidewall.plans.catalog import query
from tidewall.plans.views import load

SIZE = 64
PARTS = f"""
parts as (select doc_id, cast(i as bigint) as chunk_index, substring(text, i * {SIZE} + 1, {SIZE}) as data
  from documents, unnest(range(0, greatest((length(text) + {SIZE - 1}) // {SIZE}, 1))) as u(i))
"""
# some chunks are lost, some are damaged
LOST = "(doc_id * 31 + chunk_index * 17) % 23 = 0"
HURT = "(doc_id * 7 + chunk_index * 13) % 29 = 0"


def documents(spark, d):
    """Texts dealt out by document: the steps on a file's chunks find them together, so the text moves once and its chunks, of several times its bytes, do not."""
    return load(spark, d, "documents").select("doc_id", "text").repartition("doc_id")


def parts(spark, d):
    return I.chunk(documents(spark, d), "doc_id", "text", SIZE)


def damaged(spark, d):
    return parts(spark, d).withColumn("data", F.expr(f"case when {HURT} then concat(data, '!') when chunk_index % 41 = 5 then '' else data end"))


def third_twice(chunks):
    """Every third chunk comes twice. A union would not do: Spark 4.1 says that it keeps how the chunks are dealt out, runs it with twice the partitions, and a sort-merge join of it fails."""
    return chunks.withColumn("again", F.explode(F.sequence(F.lit(0), F.expr("case when chunk_index % 3 = 0 then 1 else 0 end")))).drop("again")


def expected(spark, d):
    return parts(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("expected_count"))


@query("I1_content_hash", "select doc_id, md5(text) as md5, sha256(text) as sha256 from documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", I.content_hash(F.col("text"), "md5").alias("md5"), I.content_hash(F.col("text")).alias("sha256"))


@query("I1_sha512")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", I.content_hash(F.col("text"), "sha512").alias("sha512"))


@query("I2_chunk", f"with {PARTS} select doc_id, chunk_index, data, cast(octet_length(encode(data)) as bigint) as chunk_size, md5(data) as chunk_md5 from parts")
def _(spark, d):
    return parts(spark, d)


@query(
    "I3_manifest",
    f"""with {PARTS} select doc_id, cast(count(*) as bigint) as chunk_count, cast(sum(octet_length(encode(data))) as bigint) as total_size from parts group by 1""",
)
def _(spark, d):
    return I.manifest(parts(spark, d), "doc_id").drop("digest")


@query(
    "I3_manifest_pages",
    f"""with {PARTS} select doc_id, chunk_index // 16 as page, cast(count(*) as bigint) as chunks, md5(string_agg(md5(data), ',' order by chunk_index)) as list_md5 from parts group by 1, 2""",
)
def _(spark, d):
    out = I.manifest_pages(parts(spark, d), "doc_id", 16)
    return out.select("doc_id", "page", "chunks", F.md5(F.array_join("chunk_list", ",")).alias("list_md5"))


# pages of a tree with four hashes under a node, as deep as the longest file needs
TREE = f"""{PARTS}, l0 as (select doc_id, chunk_index as i, sha256(concat(chunk_index, ':', sha256(data))) as h, count(*) over (partition by doc_id) as n, octet_length(encode(data)) as size from parts),
s as (select doc_id, count(*) as pages, cast(sum(size) as bigint) as total_size from l0 group by 1)"""
for _n in range(1, 9):
    TREE += f""",
l{_n} as (select doc_id, i // 4 as i, case when min(n) = 1 then min(h) else sha256(string_agg(h, '' order by i)) end as h, (min(n) + 3) // 4 as n from l{_n - 1} group by doc_id, i // 4)"""


@query("I3_merkle_roots", f"with {TREE} select s.doc_id, s.pages, s.total_size, l8.h as root from s join l8 on l8.doc_id = s.doc_id")
def _(spark, d):
    return I.merkle_roots(parts(spark, d), "doc_id", fanout=4)


@query(
    "I9_verified_pages",
    f"""with {PARTS}, x as (select *, {HURT} and doc_id % 2 = 0 as hurt from parts), t as (select doc_id, bool_or(hurt) as bad from x group by 1),
        y as (select doc_id, chunk_index, case when hurt then concat(data, '!') else data end as data from x)
        select y.doc_id, chunk_index, cast(sum(octet_length(encode(data))) over (partition by y.doc_id order by chunk_index) - octet_length(encode(data)) as bigint) as start,
          md5(data) as page_md5, case when bad then 'hash_mismatch' else 'ok' end as status from y join t on t.doc_id = y.doc_id""",
)
def _(spark, d):
    sent = parts(spark, d)
    files = I.merkle_roots(sent, "doc_id").select("doc_id", "root")
    hurt = sent.withColumn("data", F.expr(f"case when {HURT} and doc_id % 2 = 0 then concat(data, '!') else data end"))
    return I.verified_pages(third_twice(hurt), files, "doc_id").select("doc_id", "chunk_index", "start", F.md5("data").alias("page_md5"), "status")


SEALED = f"""{PARTS}, h as (select *, sha256(data) as data_hash from parts),
p as (select *, lag(data_hash) over (partition by doc_id order by chunk_index) as prev from h),
sealed as (select *, sha256(concat('{{"chunk_index":', chunk_index, ',"data_hash":"', data_hash, '","sequence_nonce":', chunk_index + 1,
   case when prev is null then '' else concat(',"previous_chunk_hash":"', prev, '"') end, '}}')) as envelope_hash from p)"""


@query(
    "I4_envelopes",
    f"with {SEALED} select doc_id, chunk_index, data_hash, chunk_index + 1 as sequence_nonce, prev as previous_chunk_hash, envelope_hash from sealed",
)
def _(spark, d):
    return I.envelopes(parts(spark, d), "doc_id").select("doc_id", "chunk_index", "data_hash", "sequence_nonce", "previous_chunk_hash", "envelope_hash")


@query(
    "I5_verify_chunks",
    f"""with {PARTS}, x as (select doc_id, chunk_index, {HURT} or chunk_index % 41 = 5 as corrupt from parts)
        select doc_id, cast(count(*) as bigint) as chunks, cast(count(*) filter (where corrupt) as bigint) as corrupt_chunks,
          coalesce(min(chunk_index) filter (where corrupt), -1) as first_corrupt from x group by 1""",
)
def _(spark, d):
    return I.corrupt_summary(I.verify_chunks(damaged(spark, d), I.envelopes(parts(spark, d), "doc_id"), "doc_id"), "doc_id")


@query("I5_corrupt_indices", f"with {PARTS} select doc_id, chunk_index from parts where {HURT} or chunk_index % 41 = 5")
def _(spark, d):
    checked = I.verify_chunks(damaged(spark, d), I.envelopes(parts(spark, d), "doc_id"), "doc_id")
    return checked.where("corrupt").select("doc_id", "chunk_index")


@query(
    "I6_verify_envelopes",
    f"""with {PARTS} select case when {HURT} then 'data_hash' when chunk_index % 10 = 7 then 'envelope_hash' else 'ok' end as verdict, cast(count(*) as bigint) as chunks from parts group by 1""",
)
def _(spark, d):
    sealed = I.envelopes(parts(spark, d), "doc_id").withColumn("data", F.expr(f"case when {HURT} then concat(data, '!') else data end"))
    forged = sealed.withColumn("sequence_nonce", F.expr("case when chunk_index % 10 = 7 then 0 else sequence_nonce end"))
    return I.verify_envelopes(forged).groupBy("verdict").agg(F.count(F.lit(1)).alias("chunks"))


@query("I7_missing_chunks", f"with {PARTS} select doc_id, chunk_index from parts where {LOST}")
def _(spark, d):
    return I.missing_chunks(parts(spark, d).where(f"not ({LOST})"), expected(spark, d), "doc_id")


@query(
    "I7_missing_tail",
    f"""with {PARTS}, g as (select doc_id, count(*) as n, count(*) filter (where not ({LOST})) as got from parts group by 1)
        select doc_id, cast(i as bigint) as chunk_index from g, unnest(range(got, n)) as u(i)""",
)
def _(spark, d):
    return I.missing_chunks(parts(spark, d).where(f"not ({LOST})"), expected(spark, d), "doc_id", mode="tail")


@query(
    "I8_complete_files",
    f"""with {PARTS} select doc_id, cast(count(*) filter (where not ({LOST})) as bigint) as received, bool_and(not ({LOST})) as complete from parts group by 1""",
)
def _(spark, d):
    return I.complete_files(parts(spark, d).where(f"not ({LOST})"), expected(spark, d), "doc_id")


@query(
    "I9_reassemble",
    f"""with {PARTS}, w as (select doc_id, count(*) as n, string_agg(case when {HURT} and doc_id % 2 = 0 then concat(data, '!') else data end, '' order by chunk_index) as content from parts group by 1)
        select w.doc_id, cast(w.n as bigint) as chunk_count, md5(w.content) as content_md5, case when md5(w.content) = md5(d.text) then 'ok' else 'hash_mismatch' end as status from w join documents d on d.doc_id = w.doc_id""",
)
def _(spark, d):
    sent = parts(spark, d).withColumn("data", F.expr(f"case when {HURT} and doc_id % 2 = 0 then concat(data, '!') else data end"))
    files = load(spark, d, "documents").select("doc_id", F.md5("text").alias("file_md5"))
    return I.reassemble(third_twice(sent), files, "doc_id").select("doc_id", "chunk_count", F.md5("content").alias("content_md5"), "status")


@query(
    "I10_chunk_mismatch",
    f"with {PARTS} select doc_id, chunk_index, md5(data) as expected_md5, md5(concat(data, '!')) as actual_md5 from parts where {HURT}",
)
def _(spark, d):
    sent = parts(spark, d).withColumnRenamed("chunk_md5", "expected_md5").withColumn("data", F.expr(f"case when {HURT} then concat(data, '!') else data end"))
    return I.chunk_mismatch(sent).select("doc_id", "chunk_index", "expected_md5", "actual_md5")


@query(
    "I11_session_progress",
    """with s as (select session_id, max(chunk_index) as n from v_chunk_ack group by 1), a as (select distinct session_id, chunk_index - 1 as i from v_chunk_ack where ok),
       p as (select s.session_id, u.i, a.i is not null as seen from s cross join unnest(range(0, s.n)) as u(i) left join a on a.session_id = s.session_id and a.i = u.i)
       select session_id, cast(count(*) filter (where seen) as bigint) as confirmed, cast(count(*) filter (where not seen) as bigint) as pending,
         bool_and(seen) as complete from p group by 1""",
)
def _(spark, d):
    ack, sessions = acks(spark, d)
    return I.session_progress(ack.where("ok"), sessions, "session_id")


def acks(spark, d):
    ack = load(spark, d, "v_chunk_ack").withColumn("chunk_index", F.col("chunk_index") - 1)
    return ack, ack.groupBy("session_id").agg((F.max("chunk_index") + 1).alias("expected_count"))


@query(
    "I11_pending_chunks",
    """with s as (select session_id, max(chunk_index) as n from v_chunk_ack group by 1), a as (select distinct session_id, chunk_index - 1 as i from v_chunk_ack where ok)
       select s.session_id, cast(u.i as bigint) as chunk_index from s cross join unnest(range(0, s.n)) as u(i) left join a on a.session_id = s.session_id and a.i = u.i where a.i is null""",
)
def _(spark, d):
    ack, sessions = acks(spark, d)
    return I.missing_chunks(ack.where("ok"), sessions, "session_id")


@query(
    "I12_expired_sessions",
    """with l as (select session_id, max(acked_at) as last_seen from v_chunk_ack group by 1)
       select session_id, last_seen, cast(epoch(timestamp '1998-01-01 00:00:00') - epoch(last_seen) as bigint) as idle_seconds from l
       where epoch(timestamp '1998-01-01 00:00:00') - epoch(last_seen) > 86400 * 900""",
)
def _(spark, d):
    return I.expired_sessions(load(spark, d, "v_chunk_ack"), "session_id", "acked_at", 86400 * 900, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))


@query(
    "I13_repair_progress",
    """select session_id, cast(count(*) as bigint) as requested, cast(count(*) filter (where not ok) as bigint) as failed,
         round(cast(count(*) filter (where ok) as double) / count(*), 9) as success_rate from v_chunk_ack group by 1""",
)
def _(spark, d):
    return I.repair_progress(load(spark, d, "v_chunk_ack"), "session_id").withColumn("success_rate", F.round("success_rate", 9))


@query(
    "I13_repair_totals",
    """select cast(count(*) as bigint) as requested, cast(count(*) filter (where not ok) as bigint) as failed, round(cast(count(*) filter (where ok) as double) / count(*), 9) as success_rate from v_chunk_ack""",
)
def _(spark, d):
    return I.repair_totals(load(spark, d, "v_chunk_ack")).withColumn("success_rate", F.round("success_rate", 9))


@query(
    "I14_backoff",
    """with a as (select c_custkey, i, least(cast(pow(2, i - 1) as bigint), 30) as w from customer, unnest(range(1, c_custkey % 9 + 1)) as u(i))
       select c_custkey, cast(i as bigint) as attempt, w as wait_seconds, cast(sum(w) over (partition by c_custkey order by i) as bigint) as elapsed_seconds from a""",
)
def _(spark, d):
    return I.backoff(load(spark, d, "customer").withColumn("n", F.col("c_custkey") % 9), "c_custkey", "n")


@query(
    "I15_hash_changed",
    "select page_id, sha256(html) as original_hash, sha256(replace(html, '<script', '<x-script')) as sanitized_hash, html <> replace(html, '<script', '<x-script') as changed from pages",
)
def _(spark, d):
    p = load(spark, d, "pages").withColumn("safe", F.replace("html", F.lit("<script"), F.lit("<x-script")))
    return I.hash_changed(p, "html", "safe").select("page_id", "original_hash", "sanitized_hash", "changed")


@query(
    "I16_replays",
    """with p as (select event_id, user_id, ts, lag(ts) over (partition by user_id, event_type order by ts, event_id) as previous_ts from events)
       select event_id, user_id, ts, previous_ts from p where ts - previous_ts < interval 2 hours""",
)
def _(spark, d):
    e = load(spark, d, "events")
    return I.replays(e, ["user_id", "event_type"], "ts", ["ts", "event_id"], 7200).select("event_id", "user_id", "ts", "previous_ts")


@query(
    "I16_replays_exact",
    """with recursive o as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as n from events),
       w as (select user_id, event_id, n, ts as since, false as is_replay from o where n = 1
         union all
         select o.user_id, o.event_id, o.n, case when o.ts - w.since < interval 6 hours then w.since else o.ts end, o.ts - w.since < interval 6 hours
         from w join o on o.user_id = w.user_id and o.n = w.n + 1)
       select event_id, is_replay from w""",
)
def _(spark, d):
    e = load(spark, d, "events").select("event_id", "user_id", "ts")
    return I.replays_since_accepted(e, ["user_id"], "ts", ["ts", "event_id"], 6 * 3600, 5 * 86400).select("event_id", "is_replay")
