"""Sources and sinks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from tidewall.operators import audit as U
from tidewall.plans.catalog import query
from tidewall.plans.views import load
from tidewall.session import checkpoint_dir, spread
from tidewall.sources import sinks, text
from tidewall.sources.digests import file_digests
from tidewall.sources.rules import load_rules
from tidewall.sources.tables import list_tables, read_table, table_exists


def scratch(spark, label: str) -> str:
    """A new folder under the session's checkpoint folder; Spark makes it on the folder's own file system."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@query("S1_read_table", "select n_name, cast(n_regionkey as bigint) as region from nation")
def _(spark, d):
    assert table_exists(spark, d, "nation") and not table_exists(spark, d, "no_such_table")
    return read_table(spark, d, "nation").select("n_name", F.col("n_regionkey").cast("bigint").alias("region"))


@query("S1_list_tables", "select 'part' as name, count(*) as n from part union all select 'pages', count(*) from pages")
def _(spark, d):
    counts = [read_table(spark, d, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n")) for t in list_tables(spark, d, "pa")]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query("S2_scan_files")
def _(spark, d):
    return file_digests(spark, d, "*.parquet").select("name", "size", "md5", "magic")


CSV_COLS = ["c_custkey", "c_name", "c_mktsegment", "note"]
NOTE = "concat('a \"', c_mktsegment, '\", b')"


def csv_docs(spark, d):
    c = spread(load(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")).withColumn("note", F.expr(NOTE))
    line = text.to_csv_line(CSV_COLS)
    blank = F.when(F.col("c_custkey") % 10 == 0, F.lit("\n,,,")).otherwise(F.lit(""))
    return c.select("c_custkey", F.concat(F.lit(",".join(CSV_COLS) + "\n"), line, blank).alias("doc"))


@query(
    "S3_read_csv_text",
    f"""with r as (select c_custkey as id, unnest(['c_custkey', 'c_name', 'c_mktsegment', 'note']) as column_name,
           unnest([cast(c_custkey as string), c_name, c_mktsegment, {NOTE}]) as value, unnest(range(0, 4)) as i from customer)
        select id, cast(0 as bigint) as row_index, cast(i as bigint) as col_index, column_name, value from r""",
)
def _(spark, d):
    return text.read_csv_text(csv_docs(spark, d), "c_custkey", "doc").withColumnRenamed("c_custkey", "id")


@query(
    "S4_read_json_text",
    """select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events where octet_length(encode(props)) <= 1048576""",
)
def _(spark, d):
    docs = load(spark, d, "events").select("event_id", "props")
    return text.read_json_text(docs, "props", max_mb=1).where("status = 'ok'").selectExpr("event_id", "variant_get(doc, '$.k', 'bigint') as k")


JSON_CASES = """case event_id % 3 when 0 then props when 1 then concat('{', props) else concat('{"k":"', repeat('x', 300), '"}') end"""


@query(
    "S4_json_status",
    "select event_id, case event_id % 3 when 0 then 'ok' when 1 then 'not_json' else 'too_large' end as status, case when event_id % 3 = 0 then cast(json_extract_string(props, '$.k') as bigint) end as k from events",
)
def _(spark, d):
    docs = load(spark, d, "events").selectExpr("event_id", f"{JSON_CASES} as doc_text")
    return text.read_json_text(docs, "doc_text", max_mb=0.0002).selectExpr("event_id", "status", "variant_get(doc, '$.k', 'bigint') as k")


XML_CASES = """case c_custkey % 3 when 0 then concat('<row><id>', c_custkey, '</id></row>') when 1 then concat('<row><id>', c_custkey, '</id>')
  else concat('<row><a><b><c>', c_custkey, '</c></b></a></row>') end"""


@query(
    "S5_xml_status",
    "select c_custkey, case c_custkey % 3 when 0 then 'ok' when 1 then 'malformed' else 'depth_exceeded' end as status, case when c_custkey % 3 = 0 then c_custkey end as id from customer",
)
def _(spark, d):
    docs = load(spark, d, "customer").selectExpr("c_custkey", f"{XML_CASES} as doc_text")
    return text.read_xml_text(docs, "doc_text", "id bigint", max_depth=3, out="r").select("c_custkey", "status", "r.id")


HARD_CSV = (
    "concat('id,note', chr(10), c_custkey, ',\"', repeat('q', 20000), chr(10), 'second \"\"line\"\"\"', chr(10), ',', chr(10), chr(10), "
    "c_custkey, ',plain \"x\"', chr(13), chr(10), c_custkey, ',beyond')"
)


@query(
    "S3_hard_csv",
    """select c_custkey as key, cast(r as bigint) as row_index, cast(c as bigint) as col_index, case c when 0 then 'id' else 'note' end as column_name,
         md5(case when c = 0 then cast(c_custkey as string) when r = 0 then concat(repeat('q', 20000), chr(10), 'second "line"') else 'plain "x"' end) as value_md5
       from customer, unnest([0, 2]) as a(r), unnest([0, 1]) as b(c)""",
)
def _(spark, d):
    # a key of 8 bytes becomes a text of 20,000: the keys are dealt out, not the texts
    docs = spread(load(spark, d, "customer").select("c_custkey")).selectExpr("c_custkey as key", f"{HARD_CSV} as doc")
    cells = text.read_csv_text(docs, "key", "doc", text.CsvOptions(max_rows=3))
    return cells.select("key", "row_index", "col_index", "column_name", F.md5("value").alias("value_md5"))


@query("S4_rejected_json", "select doc_id, 'not_json' as reason from documents where not json_valid(text)")
def _(spark, d):
    return text.rejected_json_text(load(spark, d, "documents").select("doc_id", "text"), "text", max_mb=100).select("doc_id", "reason")


@query(
    "S5_read_xml_text",
    "select c_custkey as id, c_name as name, c_mktsegment as segment from customer",
)
def _(spark, d):
    docs = load(spark, d, "customer").selectExpr(
        "c_custkey", "concat('<row><id>', c_custkey, '</id><name>', c_name, '</name><segment>', c_mktsegment, '</segment></row>') as doc"
    )
    return text.read_xml_text(docs, "doc", "id bigint, name string, segment string", out="r").select("r.id", "r.name", "r.segment")


RULES_YAML = """{
  "pii_types": {"segment": {"positive": [{"keyword": "building", "weight": 0.9, "position": "before"}],
                             "anti": [{"keyword": "machinery", "weight": 0.4}]}},
  "global_anti_keywords": [{"keyword": "household", "weight": 0.5}]
}"""


@query(
    "S6_load_rules",
    """with k as (select * from (values ('segment', 'positive', 'building'), ('segment', 'anti', 'machinery'), ('*', 'anti', 'household')) as v(pii_type, polarity, keyword))
       select k.pii_type, k.polarity, k.keyword, cast(count(c.c_custkey) as bigint) as customers from k left join customer c on contains(lower(c.c_mktsegment), k.keyword) group by 1, 2, 3""",
)
def _(spark, d):
    path = scratch(spark, "rules") + "/rules"
    spark.createDataFrame([(RULES_YAML,)], "value string").coalesce(1).write.text(path)
    words = load_rules(spark, path, "keywords")
    seen = load(spark, d, "customer").select(F.lower("c_mktsegment").alias("s"))
    counts = [F.count_if(F.contains("s", F.lit(k.keyword))).alias(f"n{i}") for i, k in enumerate(words)]
    rows = F.array(
        *[
            F.struct(F.lit(k.pii_type).alias("pii_type"), F.lit(k.polarity).alias("polarity"), F.lit(k.keyword).alias("keyword"), F.col(f"n{i}").alias("customers"))
            for i, k in enumerate(words)
        ]
    )
    return seen.agg(*counts).select(F.inline(rows))


@query("S7_write_audit", "select strftime(ts, '%Y-%m-%d') as event_day, cast(count(*) as bigint) as events, cast(sum(processing_time_ms) as bigint) as ms from v_audit group by 1")
def _(spark, d):
    path = scratch(spark, "audit") + "/log"
    sinks.write_audit(load(spark, d, "v_audit"), path)
    schema = "event_id bigint, ts timestamp_ntz, event_type string, actor_id string, processing_time_ms bigint"
    back = sinks.read_audit(spark, path, schema)
    return back.groupBy(F.col("event_date").cast("string").alias("event_day")).agg(
        F.count(F.lit(1)).alias("events"), F.sum("processing_time_ms").alias("ms")
    )


def full_audit(spark, d):
    a = load(spark, d, "v_audit")
    return U.to_audit(
        a,
        {
            "event_id": F.col("event_id"), "timestamp": F.col("ts"), "event_type": F.col("event_type"), "actor_id": F.col("actor_id"),
            "actor_name": F.upper("actor_id"), "file_id": F.col("file_id"), "filename": F.concat("file_id", F.lit(",a=b.txt")),
            "success": F.col("success"), "error_message": F.col("error_message"), "processing_time_ms": F.col("processing_time_ms"),
            "original_hash": F.md5("file_id"),
        },
        custom=["props"],
    )


@query(
    "S8_audit_csv",
    """select cast(event_id as string) as event_id, strftime(ts, '%Y-%m-%d %H:%M') as minute, event_type, actor_id, upper(actor_id) as actor_name, file_id,
         concat(file_id, ',a=b.txt') as filename, md5(file_id) as original_hash, case when success then 'OK' else coalesce(error_message, 'ERROR') end as status from v_audit""",
)
def _(spark, d):
    out = U.audit_csv(full_audit(spark, d))
    return out.withColumn("minute", F.substring("timestamp", 1, 16)).drop("timestamp")


def esc(v: str) -> str:
    return f"replace(replace(replace(replace({v}, '\\', '\\\\'), '=', '\\='), ',', '\\,'), chr(10), '\\n')"


MSG = "case when success then concat(event_type, ' ', upper(actor_id), ' ', file_id, ',a=b.txt') else concat(event_type, ' FAILED: ', coalesce(error_message, 'unknown error')) end"
CEF_SQL = f"""
select cast(event_id as string) as event_id,
  concat('CEF:0|Acme|Gate|1.0|', event_type, '|', {MSG}, '|',
    case event_type when 'transfer_requested' then '6' when 'system_error' then '7' else '3' end, '|suser=', {esc('actor_id')}, ' act=', event_type,
    ' filePath=', {esc("concat(file_id, ',a=b.txt')")}, ' origHash=', md5(file_id), ' msg=', {esc(MSG)}) as line
from v_audit"""


@query("S9_audit_cef", CEF_SQL)
def _(spark, d):
    return U.audit_cef(full_audit(spark, d), "Acme", "Gate", "1.0")


@query(
    "S10_audit_template",
    "select cast(event_id as string) as event_id, concat('[', event_type, '] ', actor_id, ' -> ', file_id, ' (', coalesce(error_message, ''), ')') as line from v_audit",
)
def _(spark, d):
    return U.audit_template(full_audit(spark, d), "[{{ event_type }}] {{actor_id}} -> {{ file_id }} ({{ error_message }})")


@query(
    "S10_template_fallback",
    """select event_id, concat('{"event_id":', event_id, ',"event_type":"', event_type, '","actor_id":"', actor_id, '"}') as line from v_audit""",
)
def _(spark, d):
    return U.audit_template(load(spark, d, "v_audit").select("event_id", "event_type", "actor_id"), "{{ no_such_column }}")


@query("S12_audit_jsonl")
def _(spark, d):
    return U.audit_jsonl(full_audit(spark, d))
