"""File types, entropy, archives, presets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewall.operators import files as T
from tidewall.plans.catalog import query
from tidewall.plans.catalog.pii import lit
from tidewall.plans.views import load
from tidewall.rules import files as R
from tidewall.session import spread

# leading bytes of each file, in hex, by row
HEADS = ["25504446", "504B0304", "89504E470D0A1A0A", "D0CF11E0", "CAFEBABE", "52494646", "00000100", ""]
HEAD = "case file_id % 8 " + " ".join(f"when {i} then '{h}'" for i, h in enumerate(HEADS)) + " end"
KNOWN = sorted({e for e, _, _ in R.SIGNATURES})
BY_MAGIC = {h: next(e for e, m, _ in R.SIGNATURES if m == h) for h in HEADS if h}
EXT = "nullif(lower(regexp_extract(filename, '\\.([^.]+)$', 1)), '')"
MIME_CASE = " ".join(f"when '{k}' then {lit(v)}" for k, v in R.MIME_TYPES.items())
KNOWN_LIST = ", ".join(lit(e) for e in KNOWN)


def files(spark, d):
    f = load(spark, d, "v_file")
    return f.withColumn("content", F.concat(F.unhex(F.expr(HEAD)), F.expr("cast(filename as binary)")))


def detect_sql(prefer: bool) -> str:
    pick = " ".join(f"when '{h}' then " + (f"case when ext in ({', '.join(lit(x.lower()) for x, m, _ in R.SIGNATURES if m == h)}) then ext else '{e}' end" if prefer else f"'{e}'") for h, e in BY_MAGIC.items())
    return f"""
with f as (select file_id, {HEAD} as h, {EXT} as ext from v_file),
t as (select file_id, h, case when h <> '' then case h {pick} end when ext in ({KNOWN_LIST}) then ext else 'unknown' end as detected_ext, ext from f)
select file_id, detected_ext, cast(case when h <> '' then 1.0 when detected_ext <> 'unknown' then 0.3 else 0.0 end as double) as confidence,
  case detected_ext when 'unknown' then 'application/octet-stream' {MIME_CASE} else concat('application/x-', detected_ext) end as detected_mime from t"""


@query("T1_detect_type", detect_sql(False))
def _(spark, d):
    return T.detect_type(files(spark, d), "content", "filename").select("file_id", "detected_ext", "confidence", "detected_mime")


@query("T1_detect_type_by_name", detect_sql(True))
def _(spark, d):
    return T.detect_type(files(spark, d), "content", "filename", prefer_extension=True).select("file_id", "detected_ext", "confidence", "detected_mime")


@query("T2_mime_of", f"with f as (select file_id, {EXT} as ext from v_file) select file_id, case ext {MIME_CASE} else concat('application/x-', ext) end as mime from f where ext is not null")
def _(spark, d):
    return load(spark, d, "v_file").select("file_id", T.mime_of(F.col("filename")).alias("mime")).where("mime is not null")


DETS = """dets as (
  select l_orderkey as file_id, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey as ord, concat('detector-', cast(l_linenumber as string)) as detector, l_returnflag as detected_ext, l_discount * 10 as confidence from lineitem)"""


@query(
    "T3_best_detection",
    f"""with {DETS}, r as (select *, row_number() over (partition by file_id order by confidence desc, ord) as n from dets)
        select file_id, detector, detected_ext, confidence from r where n = 1""",
)
def _(spark, d):
    dets = load(spark, d, "lineitem").selectExpr(
        "l_orderkey as file_id", "l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey as ord", "concat('detector-', cast(l_linenumber as string)) as detector", "l_returnflag as detected_ext", "l_discount * 10 as confidence"
    )
    return T.best_detection(dets, "file_id")


@query(
    "T4_detect_by_extension",
    f"""with f as (select file_id, coalesce(case when part_mod = 3 then 'png' end, {EXT}) as ext from v_file)
        select file_id, case when ext in ({KNOWN_LIST}) then ext else 'unknown' end as named_ext,
          cast(case when ext in ({KNOWN_LIST}) then 0.5 else 0.0 end as double) as named_confidence from f""",
)
def _(spark, d):
    f = load(spark, d, "v_file").withColumn("declared", F.expr("case when part_mod = 3 then 'PNG' else '' end"))
    return T.detect_by_extension(f, "filename", "declared").select("file_id", "named_ext", "named_confidence")


@query(
    "T4_type_mismatch",
    f"""with f as (select file_id, {HEAD} as h, {EXT} as ext from v_file),
        t as (select file_id, ext, case h {' '.join(f"when '{h}' then '{e}'" for h, e in BY_MAGIC.items())} end as m from f)
        select file_id, m is not null and ext in ({KNOWN_LIST}) and (case m {MIME_CASE} end) <> (case ext {MIME_CASE} else concat('application/x-', ext) end) as mismatch
        from t where ext is not null""",
)
def _(spark, d):
    return T.type_mismatch(files(spark, d), "content", "filename").where(T.extension(F.col("filename")).isNotNull()).select("file_id", "mismatch")


@query("T5_detect_encoding")
def _(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang", "text")
    raw = docs.withColumn(
        "content",
        F.when(F.col("doc_id") % 4 == 0, F.encode("text", "ISO-8859-1")).when(F.col("doc_id") % 4 == 1, F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8")),
    )
    return T.detect_encoding(spread(raw), "content").groupBy("lang", "encoding", "is_unicode").agg(
        F.count(F.lit(1)).alias("docs"), F.round(F.avg("encoding_confidence"), 6).alias("confidence")
    )


@query(
    "T5_declared_encoding",
    """select doc_id, case when doc_id % 4 = 0 then 'windows-1252' when doc_id % 4 = 1 and length(text) > 0 then 'UTF-16BE' else 'UTF-8' end as encoding,
         cast(1 as double) as encoding_confidence, doc_id % 4 = 1 and length(text) > 0 or doc_id % 4 > 0 as is_unicode from documents""",
)
def _(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text")
    raw = docs.withColumns(
        {
            "content": F.when(F.col("doc_id") % 4 == 0, F.encode("text", "ISO-8859-1")).when(F.col("doc_id") % 4 == 1, F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8")),
            "declared": F.expr("case doc_id % 4 when 0 then 'ISO-8859-1' when 1 then 'utf-8' when 2 then 'UTF-8' end"),
        }
    )
    return T.detect_encoding(spread(raw), "content", declared="declared").select("doc_id", "encoding", "encoding_confidence", "is_unicode")


BYTES = "list_transform(regexp_extract_all(hex(encode({})), '..'), lambda x: x)"


@query(
    "T6_entropy",
    f"""with b as (select page_id, unnest({BYTES.format('html')}) as x from pages), c as (select page_id, x, count(*) as n from b group by 1, 2),
        t as (select *, sum(n) over (partition by page_id) as total from c)
        select page_id, round(sum(-(n / total) * log2(n / total)), 6) as entropy from t group by 1""",
)
def _(spark, d):
    return T.entropy(spread(load(spark, d, "pages")).select("page_id", "html"), "html").select("page_id", F.round("entropy", 6).alias("entropy"))


WIN = 512


@query(
    "T7_entropy_anomaly",
    f"""with p as (select page_id, {BYTES.format('html')} as bs from pages), q as (select page_id, bs, len(bs) as n from p where len(bs) >= {WIN * 2}),
        g as (select page_id, sum(-(k / n) * log2(k / n)) as whole from (select page_id, n, x, count(*) as k from (select page_id, n, unnest(bs) as x from q) u group by 1, 2, 3) z group by 1),
        w as (select page_id, s, unnest(bs[s + 1 : s + {WIN}]) as x from q, unnest(range(0, n - {WIN} + 1, {WIN // 2})) as t(s)),
        we as (select page_id, s, sum(-(k / {WIN}.0) * log2(k / {WIN}.0)) as e from (select page_id, s, x, count(*) as k from w group by 1, 2, 3) z group by 1, 2),
        a as (select we.page_id, count(*) filter (where abs(we.e - g.whole) / g.whole > 0.15) as bad, max(abs(we.e - g.whole)) as dev from we join g on g.page_id = we.page_id group by 1)
        select p.page_id, cast(coalesce(a.bad, 0) as bigint) as suspicious, cast(case when a.page_id is null then 0 else len(p.bs) // {WIN // 2} end as bigint) as windows,
          round(coalesce(a.dev, 0.0), 6) as max_deviation, coalesce(a.bad / (len(p.bs) // {WIN // 2}) > 0.30 and a.dev > 0.3, false) as anomaly
        from p left join a on a.page_id = p.page_id""",
)
def _(spark, d):
    out = T.entropy_anomaly(spread(load(spark, d, "pages")), "page_id", "html", WIN)
    return out.select("page_id", "suspicious", "windows", F.round("max_deviation", 6).alias("max_deviation"), "anomaly")


@query(
    "T8_recommend",
    """with f as (select l_orderkey as file_id, l_discount * 9 as confidence from lineitem),
       a as (select file_id, max(confidence) as m, count(*) filter (where confidence >= 0.4 and confidence < 0.7) as k from f group by 1)
       select file_id, case when m >= 0.85 then 'block' when m >= 0.7 or k >= 3 then 're_encode' when m >= 0.1 then 'investigate' else 'safe' end as recommendation from a""",
)
def _(spark, d):
    return T.recommend(load(spark, d, "lineitem").selectExpr("l_orderkey as file_id", "l_discount * 9 as confidence"), "file_id")


PARTS = """select p_partkey, case p_partkey % 6 when 0 then 'word/vbaProject.bin' when 1 then 'xl/ActiveX/activeX1.xml' when 2 then 'ppt/embeddings/oleObject1.bin' when 3 then 'word/document.xml' when 4 then 'word/media/a.png' else 'xl/vbadata.xml' end as part_name,
  case p_partkey % 5 when 0 then 'application/vnd.ms-office.VBAPROJECT' when 1 then 'image/png' when 2 then 'application/xml' when 3 then 'application/vnd.ms-office.activeX+xml' else 'text/plain' end as content_type from part"""


@query(
    "T13_scan_parts",
    f"""with p as ({PARTS}) select p_partkey, part_name, content_type, case
          when contains(lower(part_name), 'vbaproject.bin') then 'part:vbaProject.bin' when contains(lower(part_name), 'vbadata.xml') then 'part:vbaData.xml'
          when contains(lower(part_name), 'activex') then 'part:activeX' when contains(lower(part_name), 'oleobject') then 'part:oleObject'
          when contains(lower(content_type), 'vbaproject') then 'type:application/vnd.ms-office.vbaProject' when contains(lower(content_type), 'activex') then 'type:application/vnd.ms-office.activeX'
          else 'type:application/xml' end as reason
        from p where p_partkey % 6 not in (3, 4) or p_partkey % 5 in (0, 2, 3)""",
)
def _(spark, d):
    e = load(spark, d, "part").selectExpr(*[x.strip() for x in split_select(PARTS)])
    return T.scan_parts(e, "part_name", "content_type")


def split_select(sql: str) -> list[str]:
    """The expressions of a flat select list."""
    body = sql[len("select ") : sql.rindex(" from ")]
    out, depth, quoted, cur = [], 0, False, ""
    for ch in body:
        if ch == "'":
            quoted = not quoted
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0 and not quoted:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


OK_EXT = "('.pdf', '.txt')"


@query(
    "T14_check_entries",
    f"""with e as (select entry_id, array_to_string(list_sort(list_filter([
           case when contains(entry_name, '..') or starts_with(entry_name, '/') then 'path_traversal' end, case when depth >= 5 then 'too_deep' end,
           case when uncompressed_size > 104857600 then 'too_large' end, case when ends_with(entry_name, '.exe') then 'executable' end,
           case when right(entry_name, 4) not in {OK_EXT} then 'extension_not_allowed' end], lambda x: x is not null)), ',') as violations from v_archive_entry)
        select entry_id, violations, violations = '' as entry_ok from e""",
)
def _(spark, d):
    out = T.check_entries(load(spark, d, "v_archive_entry"))
    return out.select("entry_id", F.array_join("violations", ",").alias("violations"), "entry_ok")


@query(
    "T14_check_archives",
    """with s as (select archive_id, cast(sum(uncompressed_size) as bigint) as u, cast(sum(compressed_size) as bigint) as c from v_archive_entry group by 1)
       select archive_id, u as total_uncompressed, c as total_compressed, u // c as ratio, u // c > 4 as is_bomb, u > 1073741824 as over_total from s""",
)
def _(spark, d):
    return T.check_archives(load(spark, d, "v_archive_entry"), "archive_id", max_ratio=4)


BOX = "concat(case p_partkey % 5 when 0 then '重要_' when 1 then 'x' when 2 then '提出資料_' when 3 then '20240115_' else '第3回_機密_' end, cast(p_partkey as string), case p_partkey % 3 when 0 then '.zip' when 1 then '.pdf' else '.7Z' end)"
ARCHIVES = f"(select p_partkey as archive_id, {BOX} as filename from part)"
# indicators stated by the parts the name is built from
NAME_HITS = """(case when k % 5 in (0, 4) then 1 else 0 end
  + case when k % 5 = 3 and k % 3 = 0 then 1 else 0 end
  + case when k % 5 = 4 and k % 3 <> 1 then 1 else 0 end + case when k % 5 = 2 and k % 3 <> 1 then 1 else 0 end)"""
SCORED = f"""
n as (select archive_id, count(*) filter (where encrypted) as n from (select entry_id % 400 + 1 as archive_id, encrypted from v_archive_entry) x group by 1),
s as (select f.archive_id, coalesce(n.n, 0) as encrypted_entries, {NAME_HITS.replace('k %', 'f.archive_id %')} as name_hits, f.archive_id % 3 <> 1 as is_container from {ARCHIVES} f left join n on n.archive_id = f.archive_id),
c as (select *, case when encrypted_entries > 0 then 0.8 * (1 - pow(0.8, 1.0 / encrypted_entries)) else 0.0 end + least(name_hits * 0.25, 0.5) + case when is_container then 0.05 else 0.0 end as confidence from s)
"""


def scores(spark, d):
    f = load(spark, d, "part").selectExpr("p_partkey as archive_id", f"{BOX} as filename")
    e = load(spark, d, "v_archive_entry").selectExpr("entry_id % 400 + 1 as archive_id", "encrypted")
    return T.ppap_score(f, e, "archive_id", "filename", threshold=0.55)


@query(
    "T15_ppap_score",
    f"with {SCORED} select archive_id, cast(encrypted_entries as bigint) as encrypted_entries, cast(name_hits as bigint) as name_hits, is_container, round(cast(confidence as double), 9) as confidence, confidence >= 0.55 as is_ppap from c",
)
def _(spark, d):
    return scores(spark, d).select("archive_id", "encrypted_entries", "name_hits", "is_container", F.round("confidence", 9).alias("confidence"), "is_ppap")


@query(
    "T16_ppap_disposition",
    f"""with {SCORED} select archive_id, case when confidence < 0.55 then 'passed_through' when archive_id % 2 = 0 then 'blocked' else 'sanitized_with_warning' end as disposition from c""",
)
def _(spark, d):
    s = scores(spark, d).withColumn("method", F.expr("case when archive_id % 2 = 0 then 'AES-256' else 'ZipCrypto' end"))
    return T.ppap_disposition(s, "warn_and_sanitize", "method").select("archive_id", "disposition")


@query(
    "T17_ppap_stats",
    f"""with {SCORED} select cast(count(*) as bigint) as files, cast(count(*) filter (where confidence >= 0.55) as bigint) as ppap_files, cast(0 as bigint) as blocked,
          cast(0 as bigint) as sanitized, cast(count(*) filter (where confidence >= 0.55) as bigint) as quarantined, cast(0 as bigint) as converted from c""",
)
def _(spark, d):
    return T.ppap_stats(T.ppap_disposition(scores(spark, d), "quarantine"))


@query(
    "T18_macro_allowlist",
    """with a as (select distinct sha256(c_mktsegment) as h from customer where c_mktsegment <> 'BUILDING')
       select c_custkey, sha256(c_mktsegment) as sha256, case when a.h is not null then 'allow' else 'block' end as macro_action from customer left join a on a.h = sha256(c_mktsegment)""",
)
def _(spark, d):
    c = load(spark, d, "customer")
    allowed = c.where("c_mktsegment <> 'BUILDING'").select(F.sha2("c_mktsegment", 256).alias("sha256"))
    return T.macro_allowlist(c, allowed, "c_mktsegment").select("c_custkey", "sha256", "macro_action")


@query(
    "T19_downgrade",
    """select entry_id, ends_with(entry_name, '.xlsm') or ends_with(entry_name, '.docm') as downgraded,
         case when ends_with(entry_name, '.xlsm') then replace(entry_name, '.xlsm', '.xlsx') when ends_with(entry_name, '.docm') then replace(entry_name, '.docm', '.docx') else entry_name end as safe_name from v_archive_entry""",
)
def _(spark, d):
    return T.downgrade(load(spark, d, "v_archive_entry"), "entry_name").select("entry_id", "downgraded", "safe_name")


PRESET = "nist_zta"


@query(
    "T24_apply_preset",
    f"""with f as (select file_id, {EXT} as ext, file_size, part_mod % 4 as depth, file_size as uncompressed_size, file_size // (1 + part_mod) as compressed_size from v_file)
        select file_id, array_to_string(list_sort(list_filter([case when ext = 'pdf' and file_size > 50 * 1048576 then 'pdf_too_large' end,
          case when ext in ('docx', 'xlsm') and file_size > 25 * 1048576 then 'office_too_large' end, case when ext = 'zip' and file_size > 100 * 1048576 then 'zip_too_large' end,
          case when depth > 1 then 'archive_too_deep' end, case when compressed_size > 0 and uncompressed_size // compressed_size > 3 then 'ratio_too_high' end], lambda x: x is not null)), ',') as violations from f""",
)
def _(spark, d):
    f = load(spark, d, "v_file").selectExpr("*", "part_mod % 4 as depth", "file_size as uncompressed_size", "file_size div (1 + part_mod) as compressed_size")
    return T.apply_preset(f, PRESET).select("file_id", F.array_join("violations", ",").alias("violations"))


GLOBS = [("*.pdf", "flatten"), ("*.docx;*.xls?", "strip_macros"), ("archive/*", "skip"), ("*.zip", "unpack")]


@query(
    "T25_match_policy",
    """select file_id, case when lower(filename) like '%.pdf' then 'flatten' when lower(filename) like '%.docx' or lower(filename) like '%.xls_' then 'strip_macros'
         when lower(filename) like 'archive/%' then 'skip' when lower(filename) like '%.zip' then 'unpack' else 'default' end as policy from v_file""",
)
def _(spark, d):
    return T.match_policy(load(spark, d, "v_file"), GLOBS, "filename", "default").select("file_id", "policy")


@query(
    "T26_retention_due",
    """with r as (select file_id, created_at, case when filename like 'archive/%' then 3650 when lower(filename) like '%.pdf' then 365 else 90 end as days,
           case when filename like 'archive/%' then 's3://cold' end as archive_to from v_file)
       select file_id, cast(days as bigint) as retention_days, archive_to, cast(created_at as date) + days <= date '1996-06-30' as due from r""",
)
def _(spark, d):
    out = T.retention_due(load(spark, d, "v_file"), [("archive/*", 3650, "s3://cold"), ("*.pdf", 365, None)], "filename", "created_at", "1996-06-30", 90)
    return out.select("file_id", "retention_days", "archive_to", "due")


@query("T31_dup_content", "select sha256(text) as sha256, cast(count(*) as bigint) as copies, min(doc_id) as first_key from documents group by 1 having count(*) > 1")
def _(spark, d):
    return T.dup_content(load(spark, d, "documents"), "doc_id", "text")
