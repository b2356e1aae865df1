"""Personal data found by field name."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewall.operators import structured as S
from tidewall.plans.catalog import query
from tidewall.plans.catalog.pii import lit, mask_sql
from tidewall.plans.views import load
from tidewall.rules import fields as R
from tidewall.session import spread

MAPS = R.default_mappings()
TITLED = [*MAPS, R.FieldMapping("c_*", "customer_field", 0.5, "mask"), R.FieldMapping("*acct*", "account", 0.7, "redact")]


def like_sql(name: str, pattern: str) -> str:
    """A mapping pattern as string tests, not as the regex the library uses."""
    if pattern.startswith("(?i)"):
        return f"lower({name}) = {lit(pattern[4:].strip('^$').lower())}"
    body = lit(pattern.strip("*"))
    if pattern.startswith("*") and pattern.endswith("*"):
        return f"contains({name}, {body})"
    if pattern.startswith("*"):
        return f"ends_with({name}, {body})"
    if pattern.endswith("*"):
        return f"starts_with({name}, {body})"
    return f"lower({name}) = {lit(pattern.lower())}"


def mapping_sql(maps, name: str) -> str:
    rows = " union all ".join(
        f"select {i} as ord, {lit(m.pii_type)} as pii_type, cast({m.confidence} as double) as confidence, {lit(m.action)} as action, {name} as field where {like_sql(name, m.pattern)}"
        for i, m in enumerate(maps)
    )
    return f"(select pii_type, confidence, action from ({rows}) q order by confidence desc, ord limit 1)"


FIELD_WORDS = "('full_name'), ('FIRST_NAME'), ('Name'), ('ssn'), ('E-mail'), ('email'), ('user_id'), ('order_no'), ('c_custkey'), ('c_acctbal'), ('misc'), ('api_key')"


def names_sql(maps) -> str:
    return f"""
with names as (select distinct n as field from (
  select c_mktsegment as n from customer union all select concat(lower(c_mktsegment), '_id') from customer
  union all select concat(lower(c_mktsegment), '_no') from customer union all select * from (values {FIELD_WORDS}) v)),
hits as (select n.field, m.* from names n, lateral {mapping_sql(maps, 'n.field')} m)
select n.field, coalesce(h.pii_type, 'unknown') as pii_type, coalesce(h.confidence, 0.0) as confidence, coalesce(h.action, 'log_only') as action, h.pii_type is not null as matched
from names n left join hits h on h.field = n.field"""


def names(spark, d):
    c = load(spark, d, "customer")
    words = [w.strip("(' )") for w in FIELD_WORDS.split(",")]
    return (
        c.select(F.explode(F.array("c_mktsegment", F.concat(F.lower("c_mktsegment"), F.lit("_id")), F.concat(F.lower("c_mktsegment"), F.lit("_no")))).alias("field"))
        .unionByName(spark.createDataFrame([(w,) for w in words], "field string"))
        .distinct()
    )


@query("F1_classify_fields", names_sql(TITLED))
def _(spark, d):
    return S.classify_fields(names(spark, d), TITLED)


CELLS = """
cells as (
  select person_id, 'full_name' as field, full_name as value, 'full_name' as pii_type, 0.99 as confidence, 'mask' as action from v_people
  union all select person_id, 'email', email, 'email', 0.98, 'mask' from v_people
  union all select person_id, 'phone', phone, 'phone', 0.92, 'mask' from v_people
  union all select person_id, 'account_key', account_key, 'generic_key', 0.35, 'log_only' from v_people
  union all select person_id, 'ccv', ccv, 'credit_card_cvv', 0.95, 'redact' from v_people)
"""


def customers(spark, d, *columns):
    """Customers dealt out evenly: a row of few bytes becomes a document to parse."""
    return spread(load(spark, d, "customer").select(*columns))


def scan(spark, d):
    return S.scan_table(load(spark, d, "v_people"), "person_id", MAPS)


@query(
    "F2_scan_table",
    f"with {CELLS} select person_id, field, value, pii_type, cast(confidence as double) as confidence, action from cells where length(trim(value)) > 0",
)
def _(spark, d):
    return scan(spark, d)


JSON_DOC = "to_json(named_struct('id', c_custkey, 'full_name', c_name, 'contact', named_struct('email', concat('c', c_custkey, '@x.org'), 'tel', array('1', '2')), 'items', array(named_struct('ssn', concat('9', c_custkey), 'qty', 3))))"


@query(
    "F3_scan_json",
    """select c_custkey, 'full_name' as path, c_name as value, 'full_name' as pii_type from customer
       union all select c_custkey, 'contact.email', concat('c', cast(c_custkey as string), '@x.org'), 'email' from customer
       union all select c_custkey, 'items[0].ssn', concat('9', cast(c_custkey as string)), 'national_id' from customer""",
)
def _(spark, d):
    docs = customers(spark, d, "c_custkey", "c_name").selectExpr("c_custkey", f"{JSON_DOC} as doc")
    return S.scan_json(docs, "c_custkey", "doc", MAPS).select("c_custkey", "path", "value", "pii_type")


@query(
    "F3_scan_event_props",
    """select event_id, 'user_ref' as path, 'user_ref' as field, cast(user_id as string) as value, 'user_ref' as pii_type, cast(0.9 as double) as confidence,
         'mask' as action, 'found' as status from events where user_id is not null""",
)
def _(spark, d):
    maps = [R.FieldMapping("*user*", "user_ref", 0.9, "mask"), R.FieldMapping("k", "key", 0.9, "mask")]
    quoted = load(spark, d, "events").selectExpr("event_id", "to_json(map('user_ref', cast(user_id as string), 'raw', props)) as doc")
    return S.scan_json(quoted, "event_id", "doc", maps)


# documents that are fine, cut short, and two levels too deep
BROKEN_JSON = """case c_custkey % 3 when 0 then concat('{"email":"c', c_custkey, '@x.org"}') when 1 then concat('{"email":"c', c_custkey)
  else concat('{"email":"c', c_custkey, '@x.org","a":{"b":{"c":{"email":"deep"}}}}') end"""


@query(
    "F3_json_status",
    """select c_custkey, 'email' as path, concat('c', cast(c_custkey as string), '@x.org') as value, 'found' as status from customer where c_custkey % 3 <> 1
       union all select c_custkey, null, null, case c_custkey % 3 when 1 then 'malformed' else 'depth_exceeded' end from customer where c_custkey % 3 > 0""",
)
def _(spark, d):
    docs = customers(spark, d, "c_custkey").selectExpr("c_custkey", f"{BROKEN_JSON} as doc")
    return S.scan_json(docs, "c_custkey", "doc", MAPS, depth=1).select("c_custkey", "path", "value", "status")


BROKEN_XML = """case c_custkey % 3 when 0 then concat('<r><email>c', c_custkey, '@x.org</email></r>') when 1 then concat('<r><email>c', c_custkey, '@x.org</email>')
  else concat('<r><email>c', c_custkey, '@x.org</email><a><b><email>deep</email></b></a></r>') end"""


@query(
    "F4_xml_status",
    """select c_custkey, 'r/email' as path, concat('c', cast(c_custkey as string), '@x.org') as value, 'found' as status from customer
       union all select c_custkey, null, null, case c_custkey % 3 when 1 then 'malformed' else 'depth_exceeded' end from customer where c_custkey % 3 > 0""",
)
def _(spark, d):
    docs = customers(spark, d, "c_custkey").selectExpr("c_custkey", f"{BROKEN_XML} as doc")
    return S.scan_xml(docs, "c_custkey", "doc", MAPS, max_depth=2).select("c_custkey", "path", "value", "status")


XML_DOC = "concat('<row id=\"', c_custkey, '\"><full_name>', c_name, '</full_name><contact email=\"c', c_custkey, '@x.org\"/><note>plain</note></row>')"


@query(
    "F4_scan_xml",
    """select c_custkey, 'row/full_name' as path, c_name as value, 'full_name' as pii_type from customer
       union all select c_custkey, 'row/contact/@email', concat('c', cast(c_custkey as string), '@x.org'), 'email' from customer""",
)
def _(spark, d):
    docs = customers(spark, d, "c_custkey", "c_name").selectExpr("c_custkey", f"{XML_DOC} as doc")
    return S.scan_xml(docs, "c_custkey", "doc", MAPS).select("c_custkey", "path", "value", "pii_type")


M = "'*'"


@query(
    "F5_mask_table",
    f"""select person_id, {mask_sql('full_name', M)} as full_name, {mask_sql('email', M)} as email, {mask_sql('phone', M)} as phone,
          balance, segment, account_key, '[REDACTED]' as ccv from v_people""",
)
def _(spark, d):
    return S.mask_table(load(spark, d, "v_people"), MAPS, keep=["person_id"])


@query(
    "F5_masked_cells",
    f"""with {CELLS} select person_id, field, case action when 'mask' then {mask_sql('value', M)} when 'redact' then '[REDACTED]' else value end as masked_value
        from cells where length(trim(value)) > 0""",
)
def _(spark, d):
    return S.masked_cells(scan(spark, d)).select("person_id", "field", "masked_value")


@query(
    "F6_table_action",
    f"""with {CELLS}, r as (select person_id, max(case action when 'redact' then 4 when 'mask' then 3 when 'alert_only' then 2 else 1 end) as k
          from cells where length(trim(value)) > 0 group by 1)
        select person_id, case k when 4 then 'redact' when 3 then 'mask' when 2 then 'alert_only' else 'log_only' end as table_action from r""",
)
def _(spark, d):
    return S.table_action(scan(spark, d), ["person_id"])


EDITED = R.remove_mapping(R.add_mapping(MAPS, R.FieldMapping("automobile*", "car", 0.99, "redact")), "*_no")


@query("F7_edited_mappings", names_sql(EDITED))
def _(spark, d):
    return S.classify_fields(names(spark, d), EDITED)


@query(
    "F8_to_field_action",
    """select l_returnflag, l_linestatus, case l_returnflag when 'A' then 'redact' when 'N' then 'mask' when 'R' then 'alert_only' else 'log_only' end as field_action,
         cast(count(*) as bigint) as n from lineitem group by 1, 2, 3""",
)
def _(spark, d):
    action = F.expr("case l_returnflag when 'A' then 'block' when 'N' then 'mask' when 'R' then 'alert_only' end")
    rows = load(spark, d, "lineitem").select("l_returnflag", "l_linestatus", S.to_field_action(action).alias("field_action"))
    return rows.groupBy("l_returnflag", "l_linestatus", "field_action").agg(F.count(F.lit(1)).alias("n"))


@query(
    "F9_field_report",
    f"""with {CELLS} select field, pii_type, action, cast(count(*) as bigint) as cells, cast(count(distinct value) as bigint) as distinct_values
        from cells where length(trim(value)) > 0 group by 1, 2, 3""",
)
def _(spark, d):
    return S.field_report(scan(spark, d))
