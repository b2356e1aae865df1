"""Derived input views, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidewall.sources.tables import read_table

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    "v_access_request": """
        select event_id as request_id, ts, user_id,
          case user_id % 5 when 0 then 'admin' when 1 then 'security_officer' when 2 then 'manager' when 3 then 'staff' else 'guest' end as role,
          case user_id % 4 when 0 then 'finance' when 1 then 'hr' when 2 then 'it' else 'sales' end as department,
          concat(case event_id % 4 when 0 then '10.0.' when 1 then '192.168.' when 2 then '172.20.' else '203.0.' end,
                 cast(user_id % 256 as string), '.', cast(event_id % 256 as string)) as ip_address,
          case event_type when 'purchase' then 'secret' when 'error' then 'internal' else 'public' end as data_classification,
          cast(floor(value * 1000) as bigint) as file_size_bytes, (event_id % 3 = 0) as contains_pii, (user_id % 2 = 0) as mfa_verified
        from events""",
    "v_audit": """
        select event_id, ts,
          case event_type when 'signup' then 'transfer_requested' when 'view' then 'file_downloaded' when 'click' then 'file_uploaded'
               when 'purchase' then 'transfer_completed' else 'system_error' end as event_type,
          concat('user-', cast(user_id as string)) as actor_id, concat('file-', cast(event_id % 97 as string)) as file_id,
          (event_type <> 'error') as success,
          case when event_type = 'error' then 'Disk full, retry=1' end as error_message,
          cast(floor(value * 10) as bigint) as processing_time_ms, props
        from events""",
    "v_transfer_event": """
        select event_id, user_id as request_id, ts,
          case event_type when 'signup' then 'approved' when 'view' then 'transferring' when 'click' then 'rejected'
               when 'purchase' then 'completed' else 'failed' end as status,
          concat('approver-', cast(event_id % 3 as string)) as approver_id
        from events""",
    "v_vote": """
        select user_id as request_id, ts as voted_at, event_id, concat('approver-', cast(event_id % 7 as string)) as approver_id,
          (event_type <> 'error') as approved
        from events""",
    "v_transfer": """
        select o_orderkey as request_id, o_custkey as applicant_id, concat('approver-', cast(o_custkey % 5 as string)) as approver_id,
          case o_orderstatus when 'O' then 'pending_approval' when 'F' then 'completed' else 'approved' end as status,
          o_orderdate as created_at, o_orderdate + interval 72 hours as expires_at
        from orders""",
    "v_chunk_ack": """
        select l_orderkey as session_id, l_linenumber as chunk_index, l_shipdate as acked_at, l_partkey % 10 <> 0 as ok from lineitem""",
    "v_archive_entry": """
        select p_partkey % 20 as archive_id, p_partkey as entry_id,
          concat(case p_partkey % 11 when 0 then '../' when 1 then '/' else '' end, 'part', cast(p_partkey as string),
                 case p_partkey % 6 when 0 then '.exe' when 1 then '.docm' when 2 then '.zip' when 3 then '.pdf' when 4 then '.xlsm' else '.txt' end) as entry_name,
          p_size % 7 as depth, cast(p_size as bigint) * 4000000 as uncompressed_size,
          cast(floor(p_size * 4000000.0 / (1 + p_partkey % 15)) as bigint) as compressed_size, (p_partkey % 9 = 0) as encrypted
        from part""",
    "v_scanner_result": """
        select doc_id, 'scan-a' as scanner, 1 as ord, case when toxic = 1 then 'infected' else 'clean' end as verdict,
          case when toxic = 1 then 4 else 0 end as severity from labels
        union all select doc_id, 'scan-b', 2, case when quality = 0 then 'infected' else 'clean' end, case when quality = 0 then 2 else 0 end from labels
        union all select doc_id, 'scan-c', 3, case when doc_id % 10 = 0 then 'error' when toxic = 1 then 'infected' else 'clean' end,
          case when doc_id % 10 <> 0 and toxic = 1 then 5 else 0 end from labels""",
    "v_node": """
        select s_suppkey as node_id, s_nationkey % 5 as tier, case when s_suppkey % 8 = 0 then 'unhealthy' else 'healthy' end as health from supplier""",
    "v_edge": """
        select s_suppkey as from_node, (s_suppkey * 3 + 1) % (select count(*) from supplier) as to_node,
          s_suppkey % 2 = 0 as require_encryption, s_suppkey % 5 = 0 as require_approval from supplier
        union all select s_suppkey, (s_suppkey + 5) % (select count(*) from supplier), false, s_suppkey % 7 = 0 from supplier
        union all select s_suppkey, (s_suppkey * 7 + 2) % (select count(*) from supplier), s_suppkey % 3 = 0, false from supplier where s_suppkey % 4 = 1""",
    "v_route": """
        select distinct c_custkey % (select count(*) from supplier) as source, (c_custkey * 7 + c_nationkey) % ((select count(*) from supplier) + 2) as target from customer""",
    "v_posture": """
        select c_custkey as device_id, case c_nationkey % 3 when 0 then 'windows' when 1 then 'macos' else 'linux' end as platform,
          (c_custkey % 9 <> 0) as os_supported, (c_custkey % 4 <> 0) as antivirus_enabled, c_custkey % 3 as critical_patches_missing,
          (c_custkey % 5 <> 0) as patch_compliant, (c_custkey % 2 = 0) as edr_present
        from customer""",
    "v_mail": """
        select conv_id, turn, concat(role, '@', case when conv_id % 3 = 0 then 'corp.example' else 'ext.example' end) as sender,
          concat('u', cast(turn as string), '@', case when turn % 2 = 0 then 'corp.example' else 'ext.example' end) as rcpt
        from conversations""",
    "v_ocr_block": """
        select conv_id as image_id, turn as block_no, text, (turn % 10) / cast(10 as double) as confidence from conversations""",
    "v_people": """
        select c_custkey as person_id, c_name as full_name, concat('user', cast(c_custkey as string), '@example.org') as email,
          concat('0', cast(c_nationkey as string), '-1234-', right(concat('0000', cast(c_custkey as string)), 4)) as phone,
          cast(c_acctbal as string) as balance, c_mktsegment as segment, concat('K', cast(c_custkey as string)) as account_key,
          case when c_custkey % 7 = 0 then '' else cast(c_custkey % 1000 as string) end as ccv
        from customer""",
    "v_file": """
        select l_orderkey * 10 + l_linenumber as file_id,
          concat(case l_partkey % 4 when 0 then 'inbox/' when 1 then 'outbox/' when 2 then 'archive/2020/' else '' end, 'doc', cast(l_partkey as string),
                 case l_partkey % 7 when 0 then '.pdf' when 1 then '.DOCX' when 2 then '.xlsm' when 3 then '.zip' when 4 then '.tar.gz' when 5 then '.txt' else '' end) as filename,
          cast(l_quantity * 3000000 as bigint) as file_size, l_shipdate as created_at,
          case l_returnflag when 'R' then 'rejected' when 'A' then 'approved' else 'ready' end as status, l_partkey % 13 as part_mod
        from lineitem""",
}


def _names(sql: str) -> set[str]:
    return set(re.findall(r"\b(?:from|join)\s+([a-z_]+)", sql))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived view as a DataFrame."""
    if name in TABLES:
        return read_table(spark, sf_dir, name)
    sql = VIEWS[name]
    used = sorted(_names(sql))
    for t in used:
        sql = re.sub(rf"\b(from|join)\s+{t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: load(spark, sf_dir, t) for t in used})


def oracle(sql: str) -> str:
    """SQL text with the views it names put in front as common table expressions."""
    need: list[str] = []

    def visit(text: str) -> None:
        for n in sorted(_names(text) & set(VIEWS)):
            if n not in need:
                visit(VIEWS[n])
                need.append(n)

    visit(sql)
    head = ",\n".join(f"{n} as ({VIEWS[n]})" for n in need)
    body = sql.strip()
    if not head:
        return body
    if body.lower().startswith("with recursive"):
        return f"with recursive {head},\n{body[len('with recursive'):]}"
    if body.lower().startswith("with "):
        return f"with {head},\n{body[5:]}"
    return f"with {head}\n{body}"
