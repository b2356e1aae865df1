"""User extensions and SQL functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidewall.functions.registry import Extensions
from tidewall.functions.sql import register_sql
from tidewall.operators.calendar import is_business_day
from tidewall.plans.catalog import query
from tidewall.plans.catalog.pii import JP_SCAN, lit, long_sql, mask_sql
from tidewall.plans.catalog.calendar import SOON, soon
from tidewall.plans.views import load
from tidewall.session import spread


@query(
    "E1_custom_detector",
    r"""with h as (select doc_id, regexp_extract_all(text, '[0-9]{5,}') as hits from documents) select doc_id, unnest(hits) as matched_text from h""",
)
def _(spark, d):
    ext = Extensions()

    def codes(texts: pd.Series) -> pd.Series:
        import re

        rx = re.compile(r"[0-9]{5,}")
        return texts.map(lambda t: [("code", m.group(), m.start(), len(m.group())) for m in rx.finditer(t or "")])

    ext.register_detector("codes", codes)
    return ext.detect(spread(load(spark, d, "documents")), "doc_id", "text", "codes").select("doc_id", "matched_text")


@query(
    "E2_custom_strategy",
    "select doc_id, scanner, cast(severity + 1 as bigint) as raised from v_scanner_result where severity > 0",
)
def _(spark, d):
    ext = Extensions()

    def raise_level(frames):
        for pdf in frames:
            hot = pdf[pdf["severity"] > 0]
            yield pd.DataFrame({"doc_id": hot["doc_id"], "scanner": hot["scanner"], "raised": (hot["severity"] + 1).astype("int64")})

    ext.register_strategy("raise", raise_level, "doc_id bigint, scanner string, raised bigint")
    return ext.apply_strategy(load(spark, d, "v_scanner_result").select("doc_id", "scanner", "severity"), "raise")


@query("E3_custom_formatter", "select concat('<', event_type, '> ', actor_id) as line from v_audit")
def _(spark, d):
    ext = Extensions()
    ext.register_formatter("angle", lambda df: F.concat(F.lit("<"), df["event_type"], F.lit("> "), df["actor_id"]))
    return ext.format(load(spark, d, "v_audit"), "angle")


@query(
    "E4_custom_calendar",
    f"with {SOON} select o_orderkey, isodow(d) <= 5 and strftime(d, '%m-%d') not in ('12-25', '01-06') as business_day from n",
)
def _(spark, d):
    ext = Extensions()
    days = soon(spark, d)
    off = days.where("date_format(d, 'MM-dd') in ('12-25', '01-06')").select(F.col("d").alias("holiday"), F.lit("closed").alias("holiday_name")).distinct()
    ext.register_calendar("own", off)
    return is_business_day(days, "d", ext.calendars["own"]).select("o_orderkey", "business_day")


@query(
    "E5_custom_type_detector",
    "select doc_id, case when left(text, 1) in ('T', 'A') then concat('starts-', left(text, 1)) else 'unknown' end as detected_ext from documents",
)
def _(spark, d):
    ext = Extensions()
    ext.register_type_detector("letter", lambda_detector)
    raw = load(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"), F.lit("").alias("filename"))
    return ext.detect_type(raw, "content", "filename", "letter").select("doc_id", "detected_ext")


def lambda_detector(contents: pd.Series) -> pd.Series:
    return contents.map(lambda c: f"starts-{chr(c[0])}" if c is not None and len(c) and chr(c[0]) in "TA" else None)


@query(
    "E5_registry_rows",
    "select doc_id, case when starts_with(text, 'The') then 'the' else 'unknown' end as detected_ext from documents",
)
def _(spark, d):
    ext = Extensions()
    ext.register_type_detector("rows", [("the", "546865", "")])
    raw = load(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"), F.lit("").alias("filename"))
    return ext.detect_type(raw, "content", "filename", "rows").select("doc_id", "detected_ext")


OCT = "list_transform(string_split(ip_address, '.'), lambda x: cast(x as bigint))"


@query(
    "E6_sql_functions",
    f"""select request_id, {mask_sql('role', lit('#'))} as masked, ({OCT})[1] * 16777216 + ({OCT})[2] * 65536 + ({OCT})[3] * 256 + ({OCT})[4] as n,
          starts_with(ip_address, '192.168.') as inside, cast(year(ts) - 2018 as bigint) as era_year from v_access_request""",
)
def _(spark, d):
    register_sql(spark)
    return spark.sql(
        "select request_id, mask_value(role, '#') as masked, ip_to_long(ip_address) as n, in_cidr(ip_address, '192.168.0.0/16') as inside,"
        " cast(era_year(to_date(ts)) as bigint) as era_year from {q}",
        q=load(spark, d, "v_access_request"),
    )


@query("E6_pii_matches", f"select doc_id, rule, matched_text, masked_text, \"offset\", length from ({long_sql(JP_SCAN)}) q")
def _(spark, d):
    register_sql(spark)
    return spark.sql(
        "select d.doc_id, m.rule, m.matched_text, m.masked_text, cast(m.offset as bigint) as offset, cast(m.length as bigint) as length from {d} d, lateral pii_matches(d.text) m",
        d=spread(load(spark, d, "documents").select("doc_id", "text")),
    )
