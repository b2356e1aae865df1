"""Secrecy classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewall.operators import pii as P
from tidewall.operators import secrecy as K
from tidewall.plans.catalog import query
from tidewall.plans.catalog.pii import ALL, INTL, JP, WINDOWS, WORDS, documents, mask_sql, scan_sql, score_sql
from tidewall.plans.flagship import protect_documents
from tidewall.plans.views import load
from tidewall.rules.secrecy import LEVELS, RULES, SecrecyRule, secrecy_scheme

SCHEME = secrecy_scheme()
EXCLUDE_ANY = secrecy_scheme(
    LEVELS,
    (*RULES, SecrecyRule("not_both", "low", "not both email and phone", exclude_any=("email", "phone"))),
    conflict="lowest",
)


def typed(spark, d, extra=()):
    found = P.with_matches(documents(spark, d).select("doc_id", "text", *extra), "text", ALL)
    return found.select("doc_id", *extra, P.pii_types(F.col("matches")).alias("pii_types"))


# independent statement of the rules over flags per document
FLAGS = f"""
f as (select d.doc_id, d.source, d.lang,
  count(m.pii_type) = 0 as empty,
  coalesce(bool_or(m.pii_type = 'national_id'), false) as nid, coalesce(bool_or(m.pii_type = 'credit_card'), false) as card,
  coalesce(bool_or(m.pii_type = 'full_name'), false) as fn, coalesce(bool_or(m.pii_type = 'address'), false) as addr,
  coalesce(bool_or(m.pii_type = 'phone'), false) as phone, coalesce(bool_or(m.pii_type = 'email'), false) as email,
  coalesce(bool_or(m.pii_type in ('employee_id', 'department')), false) as org
  from documents d left join ({scan_sql('documents', 'doc_id', 'text', ALL)}) m on m.doc_id = d.doc_id group by 1, 2, 3),
hits as (
  select doc_id, 0 as ord, 'rule_national_id_critical' as rule_id, 'critical' as level_id, 4 as rank, 'Contains national identity identifier' as why from f where nid
  union all select doc_id, 1, 'rule_credit_card_critical', 'critical', 4, 'Contains payment card information' from f where card
  union all select doc_id, 2, 'rule_full_identity_critical', 'critical', 4, 'Contains complete identity set' from f where fn and addr and phone
  union all select doc_id, 3, 'rule_identity_high', 'high', 3, 'Contains identifiable personal information' from f where (fn or addr or phone) and not nid and not card
  union all select doc_id, 4, 'rule_contact_medium', 'medium', 2, 'Contains contact information only' from f where (email or phone) and not fn and not addr and not nid
  union all select doc_id, 5, 'rule_internal_low', 'low', 1, 'Contains internal identifiers only' from f where org and not nid and not fn and not phone and not email
  union all select doc_id, 6, 'rule_public', 'public', 0, 'No personal information detected' from f where empty)
"""
CLASSED = f"""
{FLAGS}, best as (
  select doc_id, arg_max(level_id, rank * 100 + ord) as level_id, arg_max(why, rank * 100 + ord) as why, arg_max(rule_id, rank * 100 + ord) as rid,
    count(*) as n, string_agg(rule_id, ',' order by ord) as matched_rules, max(rank) as rank from hits group by 1),
classed as (
  select f.doc_id, f.source, f.lang, coalesce(b.level_id, 'medium') as level_id, cast(coalesce(b.rank, 2) as bigint) as level_rank,
    case when b.n is null then 'No rules matched; using fallback level: medium' when b.n = 1 then concat('Rule ''', b.rid, ''' matched: ', b.why) else b.why end as reason,
    coalesce(b.matched_rules, '') as matched_rules
  from f left join best b on b.doc_id = f.doc_id)
"""


@query("K1_eval_conditions", f"with {FLAGS} select doc_id, cast(ord as bigint) as rule_ord, rule_id, level_id from hits")
def _(spark, d):
    return K.eval_conditions(typed(spark, d), "doc_id", "pii_types", SCHEME)


@query("K2_classify_secrecy", f"with {CLASSED} select doc_id, level_id, level_rank, reason, matched_rules from classed")
def _(spark, d):
    out = K.classify_secrecy(typed(spark, d), "pii_types", SCHEME)
    return out.select("doc_id", "level_id", "level_rank", "reason", F.array_join("matched_rules", ",").alias("matched_rules"))


@query(
    "K2_classify_lowest",
    f"""with {FLAGS}, more as (select doc_id, ord, rule_id, level_id, rank from hits
          union all select doc_id, 7, 'not_both', 'low', 1 from f where not (email and phone))
        select f.doc_id, coalesce(arg_min(m.level_id, m.rank * 100 + m.ord), 'medium') as level_id from f left join more m on m.doc_id = f.doc_id group by 1""",
)
def _(spark, d):
    return K.classify_secrecy(typed(spark, d), "pii_types", EXCLUDE_ANY).select("doc_id", "level_id")


LEVEL_VALUES = ", ".join(f"('{lv.id}', '{lv.display_name}', {lv.rank}, '{lv.color}', {lv.retention_years})" for lv in LEVELS)


@query(
    "K3_level_info",
    f"""with {CLASSED}, l as (select * from (values {LEVEL_VALUES}) as v(id, display_name, rank, color, years))
        select c.doc_id, c.level_id, l.display_name, cast(l.rank as bigint) as level_rank, l.color, cast(l.years as bigint) as retention_years
        from classed c join l on l.id = c.level_id""",
)
def _(spark, d):
    classed = K.classify_secrecy(typed(spark, d), "pii_types", SCHEME).select("doc_id", "level_id")
    return K.level_info(classed, SCHEME)


CONTROL_VALUES = ", ".join(
    f"('{lv.id}', '{i}', '{n}', {str(req).lower()}, '{spec}')" for lv in LEVELS for i, n, req, spec in lv.controls
)


@query(
    "K4_required_controls",
    f"""with {CLASSED}, c as (select * from (values {CONTROL_VALUES}) as v(level_id, control_id, control_name, mandatory, spec))
        select x.doc_id, x.level_id, c.control_id, c.spec from classed x join c on c.level_id = x.level_id where c.mandatory""",
)
def _(spark, d):
    classed = K.classify_secrecy(typed(spark, d), "pii_types", SCHEME).select("doc_id", "level_id")
    return K.required_controls(classed, "doc_id", SCHEME, mandatory=True).select("doc_id", "level_id", "control_id", "spec")


@query(
    "K5_scheme_first_match",
    f"""with {FLAGS}, b as (select doc_id, arg_min(level_id, ord) as level_id from hits group by 1)
        select coalesce(b.level_id, 'high') as level_id, count(*) as "count" from f left join b on b.doc_id = f.doc_id group by 1""",
)
def _(spark, d):
    scheme = secrecy_scheme(LEVELS, RULES, fallback="high", conflict="first")
    return K.classify_secrecy(typed(spark, d), "pii_types", scheme).groupBy("level_id").count()


@query(
    "K6_secrecy_report",
    f"""with {CLASSED} select source, lang, level_id, cast(count(*) as bigint) as docs, cast(grouping(source) * 4 + grouping(lang) * 2 + grouping(level_id) as bigint) as grouping_id
        from classed group by cube (source, lang, level_id)""",
)
def _(spark, d):
    classed = K.classify_secrecy(typed(spark, d, ("source", "lang")), "pii_types", SCHEME)
    return K.secrecy_report(classed, "source", "lang")


def flagship_sql(threshold: float) -> str:
    """The whole chain in SQL: scan, score, keep, classify, redact."""
    scan = scan_sql("documents", "doc_id", "text", JP + INTL)
    windows = WINDOWS.replace(scan_sql("documents", "doc_id", "text", ALL), scan)
    kept = score_sql(WORDS).replace(WINDOWS, windows)
    # names of the inner chain are kept apart from the outer one
    return f"""
with q as ({kept}),
m as (select s.* from ({scan}) s join q on q.doc_id = s.doc_id and q.rule = s.rule and q."offset" = s.off where q.score >= {threshold}),
t as (select doc_id, string_agg(distinct pii_type, ',' order by pii_type) as types, count(*) as n, max(case action when 'mask' then 2 else 1 end) as act from m group by 1),
x as (select d.doc_id, coalesce(t.types, '') as types, coalesce(t.n, 0) as n, coalesce(t.act, 1) as act,
  concat(',', coalesce(t.types, ''), ',') as s from documents d left join t on t.doc_id = d.doc_id),
lv as (select *, case when contains(s, ',national_id,') or contains(s, ',credit_card,') then 'critical' when contains(s, ',phone,') then 'high' when contains(s, ',email,') then 'medium'
  when types = '' then 'public' else 'medium' end as level_id from x),
masks as (select doc_id, off, rule_ord, {mask_sql('matched_text', 'ch')} as mt from m),
cells as (select doc_id, off + i as pos, arg_min(substring(mt, i + 1, 1), struct_pack(a := off, b := -rule_ord)) as c from masks, unnest(range(0, length(mt))) as u(i) group by 1, 2),
chars as (select doc_id, unnest(range(0, len(cs))) as pos, unnest(cs) as c from (select doc_id, string_split(text, '') as cs from documents where doc_id in (select doc_id from m)) y),
built as (select ch.doc_id, string_agg(coalesce(ce.c, ch.c), '' order by ch.pos) as rt from chars ch left join cells ce on ce.doc_id = ch.doc_id and ce.pos = ch.pos group by 1)
select lv.doc_id, cast(lv.n as bigint) as confirmed, lv.types as pii_types, case lv.act when 2 then 'mask' else 'alert_only' end as doc_action, lv.level_id,
  cast(case lv.level_id when 'critical' then 4 when 'high' then 3 when 'medium' then 2 else 0 end as bigint) as level_rank, md5(coalesce(b.rt, d.text)) as redacted_md5
from lv join documents d on d.doc_id = lv.doc_id left join built b on b.doc_id = lv.doc_id"""


@query("flagship_protect_documents", flagship_sql(0.5))
def _(spark, d):
    out = protect_documents(load(spark, d, "documents"))
    return out.withColumn("redacted_md5", F.md5("redacted_text")).drop("redacted_text")
