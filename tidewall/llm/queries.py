"""One named query per operator over its whole table, with its DuckDB statement where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.llm import bagminhash, digests, filter_audit, forest, language, lexical, nbest, packing, quality, records, shards, substrings, surrogates
from tidewall.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op8_line_first")
def op8(spark: SparkSession, d: str) -> DataFrame:
    """Counts and verdict of every document, and what the line rules left of it."""
    judged = quality.clean_lines(read_table(spark, d, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_boilerplate", "n_navigation", "n_punctuation",
        F.sha2(F.col("clean_text"), 256).alias("clean_sha256"),
    )


@query("op10_byte_shards")
def op10(spark: SparkSession, d: str) -> DataFrame:
    """Every document in one of eight contiguous shards of nearly equal bytes."""
    slim = read_table(spark, d, "documents").select(
        "doc_id", shards.byte_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shards.byte_shards(slim, 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "first_byte",
    )


@query("op7_length_delimited")
def op7(spark: SparkSession, d: str) -> DataFrame:
    """Every document written as a record and read back from the files."""
    folder = records.new_folder(spark, "records")
    index = records.write_records(read_table(spark, d, "documents"), folder)
    return records.read_records(index, folder)


@query("op9_configuration_lp")
def op9(spark: SparkSession, d: str) -> DataFrame:
    """Every document's pieces and their places in as few sequences of 2,048 ids as the program finds."""
    return packing.pack(packing.token_pieces(read_table(spark, d, "documents")))


@query("op1_surrogates")
def op1(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its personal data replaced by surrogates."""
    return surrogates.pseudonymise(read_table(spark, d, "documents").select("doc_id", "text"))


@query("op2_nbest_pieces")
def op2(spark: SparkSession, d: str) -> DataFrame:
    """The four best segmentations of every whole text."""
    return nbest.n_best(read_table(spark, d, "documents"), 4, with_ids=False)


@query("op3_suffix_automata")
def op3(spark: SparkSession, d: str) -> DataFrame:
    """Words of every document that lie in a passage of 20 words that starts earlier."""
    found = substrings.repeated_spans(read_table(spark, d, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op4_prefix_forest")
def op4(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    rows = read_table(spark, d, "embeddings")
    return forest.nearest(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


@query("op5_bagminhash")
def op5(spark: SparkSession, d: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return bagminhash.classes(read_table(spark, d, "documents"))


@query("op6_language_fusion")
def op6(spark: SparkSession, d: str) -> DataFrame:
    """The language of every page; the text model is fitted on labelled documents."""
    model = language.fit_text_model(read_table(spark, d, "documents"))
    return language.identify(read_table(spark, d, "pages"), model)


AUDIT_SQL = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by t) as first_id from d),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
f as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    (case when len(words) < 50 then 1 else 0 end)
    + (case when 100 * len(list_distinct(words)) < 65 * len(words) then 2 else 0 end)
    + (case when 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) then 4 else 0 end)
    + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end)
    + (case when w.doc_id > first_id then 16 else 0 end) as mask
  from w left join l on w.doc_id = l.doc_id),
m as (
  select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f group by part, mask),
c as (select unnest(['A', 'B', 'C', 'D', 'E']) as c, unnest([1, 2, 4, 8, 16]) as b),
o as (
  select a.c || b.c || c.c || d.c || e.c as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits
  from c a, c b, c c, c d, c e where a.b + b.b + c.b + d.b + e.b = 31 and a.b | b.b | c.b | d.b | e.b = 31),
s as (
  select filter_order, cast(step as int) as step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as before
  from o, (select unnest(range(1, 6)) as step))
select part, filter_order, step,
  cast(sum(case when mask & (before | bit) = 0 then n else 0 end) as bigint) as kept,
  cast(sum(case when mask & bit <> 0 and mask & before = 0 then n else 0 end) as bigint) as removed,
  cast(sum(case when mask & bit <> 0 and mask & before <> 0 then n else 0 end) as bigint) as redundant,
  cast(sum(case when mask = bit then n else 0 end) as bigint) as unique_fails,
  cast(sum(case when mask & bit <> 0 and mask & before = 0 then good else 0 end) as bigint) as good_lost,
  cast(sum(case when mask & bit <> 0 and mask & before = 0 then toxic else 0 end) as bigint) as toxic_lost,
  cast(sum(case when mask & bit <> 0 then n * (120 // bit_count(mask)) else 0 end) as bigint) as shapley
from m, s group by part, filter_order, step"""


@query("op12_filter_matrix", AUDIT_SQL)
def op12(spark: SparkSession, d: str) -> DataFrame:
    """What five filters remove in each of their 120 orders, per source."""
    return filter_audit.audit(read_table(spark, d, "documents"), read_table(spark, d, "labels"))


DIGEST_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n_chars from documents),
n as (
  select *, coalesce(lead(t) over (order by doc_id), first_value(t) over (order by doc_id)) as nt,
    coalesce(lead(doc_id) over (order by doc_id), first_value(doc_id) over (order by doc_id)) as next_id from d),
e as (select doc_id, next_id, n_chars, t, left(t, n_chars - n_chars // 2) || left(nt, n_chars // 2) as et from n),
x as (
  select doc_id, 0 as ed, octet_length(encode(t)) as size, hex(encode(t)) as h from e
  union all select doc_id, 1, octet_length(encode(et)), hex(encode(et)) from e),
b as (select doc_id, ed, size, list_transform(regexp_extract_all(h, '..'), lambda y: cast('0x' || y as bigint)) as b from x),
z as (
  select doc_id, ed, size,
    list_transform(list_zip(b, b[2:], b[3:])[:greatest(size - 2, 0)], lambda y: ((((y[1] * 65536 + y[2] * 256 + y[3]) * 2654435761) & 4294967295) >> 24)) as z from b),
u as (select doc_id, ed, unnest(z) as bucket from z),
g as (select doc_id, ed, bucket, count(*) as n from u group by all),
m as (select doc_id, ed, map(list(bucket), list(n)) as m from g group by all),
c as (
  select z.doc_id, z.ed, z.size + 1 as size,
    list_transform(range(0, 256), lambda k: coalesce(m[k], 0)) as c
  from z left join m on z.doc_id = m.doc_id and z.ed = m.ed),
q as (select *, list_sort(c)[64] as q1, list_sort(c)[128] as q2, list_sort(c)[192] as q3, length(bin(size)) as o from c),
p as (
  select doc_id, ed, 4 * o + (((size << 2) >> (o - 1)) & 3) as len, 16 * q1 // (q3 + 1) as r1, 16 * q2 // (q3 + 1) as r2,
    list_transform(c, lambda y: (case when y > q3 then 3 when y > q2 then 2 when y > q1 then 1 else 0 end)) as k from q),
f as (
  select doc_id, ed, list_concat([len, r1, r2], k) as v,
    lower(printf('%02x', len) || printf('%x', r1) || printf('%x', r2)
      || list_aggregate(list_transform(range(0, 128), lambda i: printf('%x', 4 * k[2 * i + 1] + k[2 * i + 2])), 'string_agg', '')) as fp
  from p)
select e.doc_id, cast(e.n_chars as bigint) as n_chars, sha256(et) as edited_sha256, a.fp as fingerprint, w.fp as edited_fingerprint,
  1.0::double - least(list_sum(list_transform(list_zip(a.v, w.v), lambda y: abs(y[1] - y[2]))), 320) / 320::double as near_edited,
  1.0::double - least(list_sum(list_transform(list_zip(a.v, s.v), lambda y: abs(y[1] - y[2]))), 320) / 320::double as near_next
from e join f a on a.doc_id = e.doc_id and a.ed = 0 join f w on w.doc_id = e.doc_id and w.ed = 1 join f s on s.doc_id = e.next_id and s.ed = 0"""


@query("op13_quartile_digest", DIGEST_SQL)
def op13(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of every document, its edited text and how like they are to it and to the next document."""
    return digests.compare_with_next(read_table(spark, d, "documents"))


RANK_SQL = r"""
with t as (
  select doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents where text is not null),
s as (select count(*) as n_docs, cast(sum(len(w)) as bigint) as n_terms from t where len(w) > 0),
i as (
  select distinct item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
u as (select doc_id, len(w) as n, unnest(w) as term from t),
p as (select doc_id, n, term, count(*) as tf from u where term in (select term from i) group by doc_id, n, term),
g as (select term, cast(floor(1000 * ln(cast(2 * n_docs + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as weight from p, s group by term, n_docs),
x as (
  select item_id, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) as bigint) as score
  from i join p using (term) join g using (term), s group by item_id, doc_id),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from x where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from r where rank <= 50"""


@query("op11_document_fp_tree", RANK_SQL)
def op11(spark: SparkSession, d: str) -> DataFrame:
    """The fifty best documents of every benchmark item."""
    return lexical.rank(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"), 50)
