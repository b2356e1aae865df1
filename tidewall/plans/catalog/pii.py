"""Personal data in free text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewall.functions.rows import inline_rows
from tidewall.functions.text import context_excerpt, mask_value
from tidewall.operators import pii as P
from tidewall.plans.catalog import query
from tidewall.plans.views import load
from tidewall.rules import context as C
from tidewall.rules import pii as R
from tidewall.session import spread


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def mask_sql(value: str, ch: str) -> str:
    return (
        f"case when length({value}) <= 2 then repeat({ch}, length({value})) "
        f"else concat(left({value}, 1), repeat({ch}, length({value}) - 2), right({value}, 1)) end"
    )


def scan_sql(table: str, key: str, text: str, rules, where: str = "true") -> str:
    """Matches by splitting around the hits: one branch per rule."""
    branches = []
    for i, r in enumerate(rules):
        rx = lit(r.pattern)
        branches.append(
            f"""select {key}, {i} as rule_ord, {lit(r.name)} as rule, {lit(r.action)} as action,
              {lit(R.PII_TYPE_OF.get(r.name, r.name))} as pii_type, {lit(r.mask_char)} as ch, hits[i] as matched_text,
              cast(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
                + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) as bigint) as off
            from (select {key}, regexp_extract_all({text}, {rx}) as hits, string_split_regex({text}, {rx}) as gaps
                  from {table} where {where}) s, unnest(range(1, len(hits) + 1)) as t(i)"""
        )
    return " union all ".join(branches)


JP, INTL, KR = R.rules_jp(), R.rules_intl(), R.rules_kr()
ALL = JP + INTL + KR
JP_SCAN = scan_sql("documents", "doc_id", "text", JP)
LONG = ["doc_id", "rule", "action", "matched_text", "masked_text", "offset", "length"]


def long_sql(scan: str, key: str = "doc_id") -> str:
    return f"""select {key}, rule, action, matched_text, {mask_sql('matched_text', 'ch')} as masked_text,
      cast(off as bigint) as "offset", cast(length(matched_text) as bigint) as length from ({scan}) q"""


def long(df, key="doc_id"):
    return df.select(
        key, "rule", "action", "matched_text", "masked_text",
        F.col("offset").cast("bigint").alias("offset"), F.col("length").cast("bigint").alias("length"),
    )


def documents(spark, d):
    return spread(load(spark, d, "documents"))


@query("P1_pii_scan", long_sql(JP_SCAN))
def _(spark, d):
    return long(P.pii_scan(documents(spark, d), ["doc_id"], "text", JP))


def rules_sql(rules) -> str:
    rows = ", ".join(f"({i}, {lit(r.name)}, {lit(r.pattern)}, {lit(r.action)}, {lit(r.mask_char)})" for i, r in enumerate(rules))
    return f"(values {rows}) as r(ord, name, pattern, action, mask_char)"


@query(
    "P2_rules_jp_hits",
    f"""select r.name as rule, r.action, r.mask_char, cast(count(d.doc_id) as bigint) as docs
        from {rules_sql(JP)} left join documents d on regexp_matches(d.text, r.pattern) group by 1, 2, 3""",
)
def _(spark, d):
    found = P.with_matches(documents(spark, d).select("doc_id", "text"), "text", JP)
    per = found.select("doc_id", F.explode_outer(F.array_distinct(F.transform("matches", lambda m: m["rule"]))).alias("name"))
    counts = per.groupBy("name").agg(F.count(F.lit(1)).alias("docs"))
    pack = R.rules_frame(spark, JP)
    return pack.join(counts, "name", "left").select(
        F.col("name").alias("rule"), "action", "mask_char", F.coalesce("docs", F.lit(0)).alias("docs")
    )


def region_sql(region: str) -> str:
    return long_sql(scan_sql("documents", "doc_id", "text", R.rules_intl(region)))


@query("P3_rules_intl_scan", long_sql(scan_sql("documents", "doc_id", "text", INTL)))
def _(spark, d):
    return long(P.pii_scan(documents(spark, d), ["doc_id"], "text", INTL))


@query("P3_rules_region_eu", region_sql("EU"))
def _(spark, d):
    pack = R.rules_from_frame(R.rules_for_region(R.rules_frame(spark, INTL), "EU"))
    return long(P.pii_scan(documents(spark, d), ["doc_id"], "text", pack))


@query(
    "P4_rules_kr_scan",
    long_sql(
        scan_sql(
            """(select l_orderkey * 10 + l_linenumber as line_id, concat('rrn ',
                  right(concat('000000', cast(l_partkey as string)), 6), case when l_linenumber % 2 = 0 then '-' else '' end,
                  right(concat('0000000', cast(l_orderkey as string)), 7), ' end') as note from lineitem) n""",
            "line_id", "note", KR,
        ),
        "line_id",
    ),
)
def _(spark, d):
    notes = load(spark, d, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber as line_id",
        """concat('rrn ', right(concat('000000', cast(l_partkey as string)), 6), case when l_linenumber % 2 = 0 then '-' else '' end,
           right(concat('0000000', cast(l_orderkey as string)), 7), ' end') as note""",
    )
    return long(P.pii_scan(notes, ["line_id"], "note", KR), "line_id")


EXTRA = R.TextRule("iso_date", r"\b(?:19|20)\d{2}-\d{2}-\d{2}\b", "block", "#")


@query("P5_added_rule_scan", long_sql(scan_sql("documents", "doc_id", "text", [*JP, EXTRA])))
def _(spark, d):
    pack = R.valid_rules([*R.add_rule(JP, EXTRA), R.TextRule("broken", "(", "mask")])
    return long(P.pii_scan(documents(spark, d), ["doc_id"], "text", pack))


@query(
    "P6_mask_value",
    f"""select c_custkey, {mask_sql('c_name', "'*'")} as masked_name, {mask_sql('left(c_mktsegment, c_custkey % 4)', "'#'")} as masked_short from customer""",
)
def _(spark, d):
    short = F.expr("left(c_mktsegment, cast(c_custkey % 4 as int))")
    return load(spark, d, "customer").select(
        "c_custkey", mask_value(F.col("c_name")).alias("masked_name"), mask_value(short, "#").alias("masked_short")
    )


REDACT_SQL = f"""
with m as ({JP_SCAN}),
masks as (select doc_id, off, rule_ord, {mask_sql('matched_text', 'ch')} as t from m),
cells as (
  select doc_id, off + i as pos, arg_min(substring(t, i + 1, 1), struct_pack(a := off, b := -rule_ord)) as c
  from masks, unnest(range(0, length(t))) as u(i) group by 1, 2),
chars as (
  select doc_id, unnest(range(0, len(cs))) as pos, unnest(cs) as c
  from (select doc_id, string_split(text, '') as cs from documents where doc_id in (select doc_id from m)) x),
built as (
  select ch.doc_id, string_agg(coalesce(ce.c, ch.c), '' order by ch.pos) as redacted_text
  from chars ch left join cells ce on ce.doc_id = ch.doc_id and ce.pos = ch.pos group by 1)
select d.doc_id, coalesce(b.redacted_text, d.text) as redacted_text from documents d left join built b on b.doc_id = d.doc_id
"""


@query("P7_redact_text", REDACT_SQL)
def _(spark, d):
    found = P.with_matches(documents(spark, d).select("doc_id", "text"), "text", JP)
    return P.redact_text(found, "text").select("doc_id", "redacted_text")


ACTION_SQL = f"""
with m as ({JP_SCAN}),
r as (select doc_id, max(case action when 'block' then 3 when 'mask' then 2 else 1 end) as k from m group by 1)
select d.doc_id, case r.k when 3 then 'block' when 2 then 'mask' else 'alert_only' end as doc_action
from documents d left join r on r.doc_id = d.doc_id"""


@query("P8_doc_action", ACTION_SQL)
def _(spark, d):
    found = P.with_matches(documents(spark, d).select("doc_id", "text"), "text", JP)
    return found.select("doc_id", P.doc_action(F.col("matches")).alias("doc_action"))


@query("P8_doc_action_from_table", ACTION_SQL)
def _(spark, d):
    docs = documents(spark, d).select("doc_id", "text")
    return P.doc_actions(docs, P.pii_scan(docs, ["doc_id"], "text", JP), "doc_id")


@query(
    "P9_pii_summary",
    f"""with m as ({JP_SCAN}), j as (select d.source, m.rule, m.doc_id from m join documents d on d.doc_id = m.doc_id),
        p as (select source, rule, doc_id, count(*) as n from j group by 1, 2, 3)
        select source, rule, cast(sum(n) as bigint) as hits, cast(count(*) as bigint) as doc_rules from p group by rollup (source, rule)""",
)
def _(spark, d):
    return P.pii_summary(documents(spark, d), "source", "text", "doc_id", JP)


@query(
    "P9_scan_bytes",
    f"""with m as ({JP_SCAN}), c as (select doc_id, count(*) as n from m group by 1)
        select d.source, cast(count(*) as bigint) as docs, cast(count(c.n) as bigint) as docs_found, cast(coalesce(sum(c.n), 0) as bigint) as matches,
          cast(sum(octet_length(encode(d.text))) as bigint) as bytes
        from documents d left join c on c.doc_id = d.doc_id group by 1""",
)
def _(spark, d):
    per = P.scan_bytes(documents(spark, d), "doc_id", "text", JP, ["source"])
    return per.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if("found").alias("docs_found"),
        F.sum("match_count").alias("matches"), F.sum("bytes_scanned").alias("bytes"),
    )


def excerpt_sql(off: str, ln: str) -> str:
    start, end = f"greatest({off} - 40, 0)", f"least({off} + {ln} + 40, length(text))"
    raw = f"substring(text, {start} + 1, {end} - {start})"
    return f"""concat(case when {start} > 0 then '…' else '' end,
      case when {start} > 0 and left({raw}, 1) <> ' ' and position(' ' in {raw}) > 0 then substring({raw}, position(' ' in {raw})) else {raw} end,
      case when {end} < length(text) then '…' else '' end)"""


@query(
    "P10_context_excerpt",
    f"""with m as ({JP_SCAN}), j as (select m.*, d.text, cast(m.off as bigint) as o, length(m.matched_text) as n from m join documents d on d.doc_id = m.doc_id)
        select doc_id, rule, o as "offset", {excerpt_sql('o', 'n')} as excerpt from j""",
)
def _(spark, d):
    found = P.with_matches(documents(spark, d).select("doc_id", "text"), "text", JP)
    excerpts = F.transform(
        "matches",
        lambda m: F.struct(
            m["rule"].alias("rule"), m["offset"].cast("bigint").alias("offset"),
            context_excerpt(F.col("text"), m["offset"], m["length"]).alias("excerpt"),
        ),
    )
    return inline_rows(found, ["doc_id"], excerpts, "rule")


WINDOWS = f"""
select m.doc_id, m.rule, m.pii_type, cast(m.off as bigint) as o, m.matched_text,
  substring(d.text, greatest(m.off - 100, 0) + 1, m.off - greatest(m.off - 100, 0)) as prefix,
  substring(d.text, m.off + length(m.matched_text) + 1, 100) as suffix
from ({scan_sql('documents', 'doc_id', 'text', ALL)}) m join documents d on d.doc_id = m.doc_id"""


@query("P11_context_window", f'select doc_id, rule, o as "offset", prefix, suffix from ({WINDOWS}) w')
def _(spark, d):
    return P.context_window(documents(spark, d), ["doc_id"], "text", ALL).select(
        "doc_id", "rule", F.col("offset").cast("bigint").alias("offset"), "prefix", "suffix"
    )


def keyword_sql(words) -> str:
    rows = ", ".join(
        f"({i}, {lit(k.pii_type)}, {lit(k.polarity)}, {lit(k.keyword.lower())}, {float(k.weight)!r}::double, {lit(k.position)})"
        for i, k in enumerate(words)
    )
    return f"(values {rows}) as k(ord, pii_type, polarity, word, weight, position)"


def score_sql(words) -> str:
    return f"""
with w as ({WINDOWS}), h as (
  select w.doc_id, w.rule, w.o, k.ord, k.pii_type as scope, k.polarity, k.word, k.weight
  from w join {keyword_sql(words)} on (k.pii_type = '*' or k.pii_type = w.pii_type)
   and ((k.position <> 'after' and contains(lower(w.prefix), k.word)) or (k.position <> 'before' and contains(lower(w.suffix), k.word)))),
s as (
  select w.doc_id, w.rule, w.o, w.pii_type,
    coalesce(sum(case when h.polarity = 'positive' then h.weight end), 0.0) - coalesce(sum(case when h.polarity = 'anti' then h.weight end), 0.0) as net,
    coalesce(string_agg(case when h.polarity = 'positive' then h.word end, ',' order by h.ord), '') as positive_words,
    coalesce(string_agg(case when h.polarity = 'anti' then case when h.scope = '*' then concat('global:', h.word) else h.word end end, ',' order by h.ord), '') as negative_words
  from w left join h on h.doc_id = w.doc_id and h.rule = w.rule and h.o = w.o group by 1, 2, 3, 4),
z as (select *, (tanh(net) + 1) / 2 as score from s)
select doc_id, rule, pii_type, o as "offset", round(score, 9) as score, score >= 0.7 as is_pii,
  round(case when score >= 0.7 then least(score + 0.15, 1.0) else least(1 - score + 0.20, 1.0) end, 9) as confidence, positive_words, negative_words
from z"""


WORDS = C.default_keywords()


def scored(spark, d, words=WORDS):
    return P.score_context(P.context_window(documents(spark, d), ["doc_id"], "text", ALL), words)


def flat_scores(df):
    return df.select(
        "doc_id", "rule", "pii_type", F.col("offset").cast("bigint").alias("offset"),
        F.round("score", 9).alias("score"), "is_pii", F.round("confidence", 9).alias("confidence"),
        F.array_join("positive_words", ",").alias("positive_words"), F.array_join("negative_words", ",").alias("negative_words"),
    )


@query("P12_score_context", score_sql(WORDS))
def _(spark, d):
    return flat_scores(scored(spark, d))


@query("P13_confirmed_matches", f'select doc_id, rule, "offset" from ({score_sql(WORDS)}) q where is_pii')
def _(spark, d):
    return P.confirm_matches(scored(spark, d)).select("doc_id", "rule", F.col("offset").cast("bigint").alias("offset"))


@query("P13_confirmed_in_row", f'select doc_id, rule, "offset" from ({score_sql(WORDS)}) q where is_pii')
def _(spark, d):
    found = P.with_context(P.with_matches(documents(spark, d).select("doc_id", "text"), "text", ALL), "text")
    kept = P.keep_confirmed(found, "matches", WORDS)
    return P.explode_matches(kept, ["doc_id"]).select("doc_id", "rule", F.col("offset").cast("bigint").alias("offset"))


@query(
    "P13_rejected_by_rule",
    f"select rule, cast(count(*) as bigint) as rejected from ({score_sql(WORDS)}) q where not is_pii group by 1",
)
def _(spark, d):
    return P.rejected_matches(scored(spark, d)).groupBy("rule").agg(F.count(F.lit(1)).alias("rejected"))


OWN = [
    C.Keyword("email", "positive", "contact", 0.9, "before"),
    C.Keyword("email", "positive", "write", 0.6, "either"),
    C.Keyword("ip_address_v4", "positive", "host", 0.95, "before"),
    C.Keyword("ip_address_v4", "positive", "server", 0.95, "either"),
    C.Keyword(C.GLOBAL, "anti", "draft", 0.4, "either"),
]
MERGED = P.merge_rulesets([WORDS, OWN])
MERGE_SQL = f"""
with r as (select 0 as source_ord, ord, pii_type, polarity, word, weight, position from {keyword_sql(WORDS)}
  union all select 1, ord, pii_type, polarity, word, weight, position from {keyword_sql(OWN)}),
last as (select pii_type, max(source_ord) as s from r where pii_type <> '*' group by 1),
merged as (select r.* from r left join last l on l.pii_type = r.pii_type where r.pii_type = '*' or r.source_ord = l.s)
select m.pii_type, m.polarity, m.word as keyword, cast(count(d.doc_id) as bigint) as docs
from merged m left join documents d on contains(lower(d.text), m.word) group by 1, 2, 3"""


@query("P14_merge_rulesets", MERGE_SQL)
def _(spark, d):
    both = C.keywords_frame(spark, WORDS, 0).unionByName(C.keywords_frame(spark, OWN, 1))
    merged = C.keywords_from_frame(P.merge_ruleset_frames(both))
    words = list(dict.fromkeys(k.keyword.lower() for k in merged))
    low = documents(spark, d).select(F.lower("text").alias("t"))
    hits = F.array_compact(F.array(*[F.when(F.contains("t", F.lit(w)), F.lit(w)) for w in words]))
    counts = low.select(F.explode(hits).alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("docs"))
    pack = C.keywords_frame(spark, merged).select("pii_type", "polarity", F.lower("keyword").alias("keyword"))
    return pack.join(counts, "keyword", "left").select("pii_type", "polarity", "keyword", F.coalesce("docs", F.lit(0)).alias("docs"))


EDITED = P.remove_keyword(P.add_keyword(WORDS, C.Keyword("email", "positive", "the", 0.9, "either")), "email", "email")


@query("P15_edited_keywords", score_sql(EDITED))
def _(spark, d):
    return flat_scores(scored(spark, d, EDITED))


@query(
    "P16_score_with_fallback",
    f"""with q as ({score_sql(WORDS)}),
        e as (select doc_id, quality = 1 as ext_is_pii, case when quality = 1 then 0.9 else 0.6 end as ext_confidence from labels)
        select q.doc_id, q.rule, q."offset", coalesce(e.ext_is_pii, q.is_pii) as is_pii,
          round(cast(coalesce(e.ext_confidence, q.confidence) as double), 9) as confidence,
          case when e.doc_id is null then 'keyword' else 'external' end as score_source
        from q left join e on e.doc_id = q.doc_id""",
)
def _(spark, d):
    ext = load(spark, d, "labels").selectExpr(
        "doc_id", "quality = 1 as ext_is_pii", "cast(case when quality = 1 then 0.9 else 0.6 end as double) as ext_confidence"
    )
    found = P.context_window(documents(spark, d), ["doc_id"], "text", ALL)
    out = P.score_with_fallback(found, ext, ["doc_id"], WORDS)
    return out.select(
        "doc_id", "rule", F.col("offset").cast("bigint").alias("offset"), "is_pii", F.round("confidence", 9).alias("confidence"), "score_source"
    )


BLOCK_KEY = "image_id, block_no"
NOTE = "concat(text, ' mail u', cast(block_no as string), '@corp.example from 10.0.', cast(image_id % 256 as string), '.7')"
BLOCKS = f"(select *, {NOTE} as note from v_ocr_block) b"


@query(
    "P17_scan_blocks",
    f"""select image_id, cast(block_no as bigint) as block_no, rule, matched_text, cast(off as bigint) as "offset"
        from ({scan_sql(BLOCKS, BLOCK_KEY, 'note', ALL, 'confidence >= 0.2')}) q""",
)
def _(spark, d):
    found = P.pii_scan_blocks(spread(load(spark, d, "v_ocr_block")).withColumn("note", F.expr(NOTE)), ["image_id", "block_no"], "note", "confidence", ALL, 0.2)
    return found.select("image_id", "block_no", "rule", "matched_text", F.col("offset").cast("bigint").alias("offset"))


@query(
    "P18_size_guard",
    """select lang, cast(count(*) filter (where octet_length(encode(text)) <= 4000) as bigint) as within_limit,
         cast(count(*) filter (where octet_length(encode(text)) > 4000) as bigint) as over_limit,
         cast(coalesce(sum(octet_length(encode(text))) filter (where octet_length(encode(text)) > 4000), 0) as bigint) as over_bytes
       from documents group by 1""",
)
def _(spark, d):
    ok, over = P.size_guard(load(spark, d, "documents").select("lang", "text"), "text", 4000)
    both = ok.select("lang", F.lit(1).alias("ok"), F.lit(0).alias("over"), F.lit(0).alias("b")).unionByName(
        over.select("lang", F.lit(0).alias("ok"), F.lit(1).alias("over"), F.octet_length("text").alias("b"))
    )
    return both.groupBy("lang").agg(
        F.sum("ok").alias("within_limit"), F.sum("over").alias("over_limit"), F.sum("b").alias("over_bytes")
    )


@query(
    "P19_pii_types",
    f"""with m as ({scan_sql('documents', 'doc_id', 'text', ALL)}), t as (select distinct doc_id, pii_type from m)
        select d.doc_id, coalesce(string_agg(t.pii_type, ',' order by t.pii_type), '') as pii_types
        from documents d left join t on t.doc_id = d.doc_id group by 1""",
)
def _(spark, d):
    found = P.with_matches(documents(spark, d).select("doc_id", "text"), "text", ALL)
    return found.select("doc_id", F.array_join(P.pii_types(F.col("matches")), ",").alias("pii_types"))
