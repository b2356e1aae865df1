"""Active content, verdicts, mail zones, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewall.operators import threats as H
from tidewall.plans.catalog import query
from tidewall.plans.catalog.pii import lit
from tidewall.plans.views import load
from tidewall.rules import files as R
from tidewall.session import spread

# pages with one more threat of each class, by page number
ADD = """case page_id % 8 when 0 then '<svg onload="x()"><foreignObject><b onclick="y()">z</b></foreignObject></svg>'
  when 1 then '<a href="javascript:x">a</a>' when 2 then '<p style="width:expression(1)">s</p>' when 3 then '<set attributeName="x"/><b title=''plain''>t</b>'
  when 4 then '<animate begin="click" to="1"/><animate begin="2s"/>' when 5 then '<img src="https://x.example/a.png" onerror="e()"/>'
  when 6 then '<a xlink:href="HTTP://x.example">l</a><i data-x="data:text/javascript,1">i</i>' else '<handler>h</handler> onclick="text"' end"""
MIXED = f"concat(html, {ADD})"


def pages(spark, d):
    return spread(load(spark, d, "pages").select("page_id", "html")).withColumn("html", F.expr(MIXED))


def cut_sql(col: str) -> str:
    for n in ("script", "foreignobject", "handler"):
        col = rf"regexp_replace({col}, '<(?:[A-Za-z0-9_]+:)?{n}(?:\s[^<>]*?)?(?:/>|>.*?(?:</(?:[A-Za-z0-9_]+:)?{n}\s*>|\z))', '', 'gis')"
    return col


def count_sql(n: str) -> str:
    """Elements of a name, outside the other removed elements being irrelevant on these pages."""
    return rf"len(regexp_extract_all(lower(html), '<(?:[a-z0-9_]+:)?{n}[\s/>]'))"


HANDLERS = ", ".join(lit(h) for h in R.EVENT_HANDLERS)
ATTR = r"""[A-Za-z_][A-Za-z0-9_:.-]*\s*=\s*(?:"[^"]*"|''[^'']*'')"""
CLASS = f"""case when name in ({HANDLERS}) then 'event_handler' when contains(value, 'javascript:') then 'javascript_href'
  when contains(value, 'data:text/javascript') or contains(value, 'data:application/javascript') then 'data_uri_script' when contains(value, 'data:text/ecmascript') then 'event_handler'
  when name in ('href', 'xlink:href') and regexp_matches(value, '^https?://') then 'external_resource' when name = 'src' and regexp_matches(value, '^https?://') then 'event_handler'
  when name = 'style' and regexp_matches(value, 'expression\\(|-moz-binding') then 'css_expression' when name = 'style' and regexp_matches(value, 'url\\(javascript:|behavior\\(') then 'event_handler' end"""
TAGS = f"""
p as (select page_id, {MIXED} as html from pages),
c as (select page_id, {cut_sql('html')} as body from p),
t as (select page_id, i, tags[i] as tag from (select page_id, regexp_extract_all(body, '<[A-Za-z][^<>]*>') as tags from c) x, unnest(range(1, len(tags) + 1)) as u(i)),
n as (select *, lower(regexp_extract(tag, '^<(?:[A-Za-z0-9_]+:)?([A-Za-z0-9_.-]+)', 1)) as element from t),
gone as (select page_id, i, element from n where ends_with(tag, '/>') and (element = 'set' or (element in ('animate', 'animatetransform', 'animatemotion')
   and regexp_matches(tag, '(?i)\\sbegin\\s*=\\s*"[^"]*(click|load|mouseover|focus)')))),
a as (select page_id, i, element, unnest(regexp_extract_all(tag, '{ATTR}')) as attr from n where (page_id, i) not in (select page_id, i from gone)),
v as (select page_id, i, element, attr, lower(regexp_extract(attr, '^([^=\\s]+)', 1)) as name, lower(regexp_extract(attr, '(?s)=\\s*["''](.*)["'']$', 1)) as value from a),
th as (
  select page_id, 'script' as element, '' as attribute, 'script_element' as threat from p, unnest(range(0, {count_sql('script')})) as u(k)
  union all select page_id, 'foreignobject', '', 'foreign_object' from p, unnest(range(0, {count_sql('foreignobject')})) as u(k)
  union all select page_id, 'handler', '', 'script_element' from p, unnest(range(0, {count_sql('handler')})) as u(k)
  union all select page_id, element, '', case element when 'set' then 'set_element' else 'animation_with_script' end from gone
  union all select page_id, element, name, {CLASS} from v where {CLASS} is not null)
"""


@query("T9_scan_markup", f"with {TAGS} select page_id, element, attribute, threat from th")
def _(spark, d):
    return H.scan_markup(pages(spark, d), "page_id", "html")


@query(
    "T9_threat_counts",
    f"with {TAGS}, k as (select page_id, count(*) as n from th group by 1) select p.page_id, cast(coalesce(k.n, 0) as bigint) as threat_count, k.n is null as is_safe from p left join k on k.page_id = p.page_id",
)
def _(spark, d):
    return H.is_safe_markup(pages(spark, d), "page_id", "html")


@query(
    "T10_sanitize_markup",
    f"""with {TAGS}, bad as (select page_id, i, list(attr) as attrs from v where {CLASS} is not null group by 1, 2),
        tok as (select page_id, k, toks[k] as s, case when regexp_matches(toks[k], '^<[A-Za-z]') then sum(case when regexp_matches(toks[k], '^<[A-Za-z][^<>]*>$') then 1 else 0 end) over (partition by page_id order by k) end as i
          from (select page_id, regexp_extract_all(body, '(?s)<[A-Za-z/!?][^<>]*>|[^<]+|<') as toks from c) x, unnest(range(1, len(toks) + 1)) as u(k)),
        done as (select tok.page_id, tok.k, case when g.i is not null then '' when b.attrs is null then tok.s
            else list_reduce(list_prepend(tok.s, b.attrs), lambda x, y: replace(x, y, '')) end as s
          from tok left join gone g on g.page_id = tok.page_id and g.i = tok.i left join bad b on b.page_id = tok.page_id and b.i = tok.i)
        select page_id, md5(string_agg(s, '' order by k)) as clean_md5 from done group by 1""",
)
def _(spark, d):
    return H.sanitize_markup(pages(spark, d), "html").select("page_id", F.md5("clean_html").alias("clean_md5"))


# pages whose threats follow from how they are built: (markup, element, attribute, threat, what is left of it)
HOSTILE = (
    ('<a title=">" onclick="evil()">x</a>', "a", "onclick", "event_handler", '<a title=">" >x</a>'),
    ("<img onerror=alert(1)>", "img", "onerror", "event_handler", "<img >"),
    ('<a href="java&#115;cript:x">l</a>', "a", "href", "javascript_href", "<a >l</a>"),
    ("<script><script>a</script>evil()</script>", "script", "", "script_element", ""),
    ("<p title='a > b' class=plain>fine</p>", None, None, None, "<p title='a > b' class=plain>fine</p>"),
)
HOSTILE_VALUES = ", ".join(
    f"({i}, {', '.join('null' if v is None else lit(v) for v in row)})" for i, row in enumerate(HOSTILE)
)


def hostile(spark, d):
    table = F.array(*(F.lit(row[0]) for row in HOSTILE))
    page = F.concat(F.lit("<b>"), F.col("page_id").cast("string"), F.lit("</b>"), F.get(table, (F.col("page_id") % len(HOSTILE)).cast("int")), F.lit("<i>end</i>"))
    return spread(load(spark, d, "pages").select("page_id")).withColumn("html", page)


@query(
    "T9_hostile_markup",
    f"select page_id, element, attribute, threat from pages join (values {HOSTILE_VALUES}) as v(k, html, element, attribute, threat, clean) on page_id % {len(HOSTILE)} = k where threat is not null",
)
def _(spark, d):
    return H.scan_markup(hostile(spark, d), "page_id", "html")


@query(
    "T10_hostile_markup",
    f"select page_id, concat('<b>', cast(page_id as string), '</b>', clean, '<i>end</i>') as clean_html from pages join (values {HOSTILE_VALUES}) as v(k, html, element, attribute, threat, clean) on page_id % {len(HOSTILE)} = k",
)
def _(spark, d):
    return H.sanitize_markup(hostile(spark, d), "html").select("page_id", "clean_html")


# what is appended to a file: (token found, its text, the rest of what is appended)
TOKENS = (
    ("javascript", "/JS (app.alert(1)", ")"), ("open_action", "/OpenAction", ""), ("additional_actions", "/AA <<", " /O 1 0 R >>"),
    ("uri_action", "/URI (https://x.example)", ""), ("submit_form", "/S /SubmitForm", ""), ("rich_media", "/RichMedia", ""), ("embedded_file", "/EmbeddedFile", ""),
)
TOKEN_VALUES = ", ".join(f"({i}, {lit(n)}, {lit(t)}, {lit(r)})" for i, (n, t, r) in enumerate(TOKENS))


@query(
    "T11_scan_tokens",
    f"""with f as (select doc_id, token, found, concat(case when doc_id % 11 = 0 then 'PDF' else '%PDF-1.4' end, chr(10), text, ' ') as body, rest
            from documents join (values {TOKEN_VALUES}) as v(k, token, found, rest) on doc_id % {len(TOKENS)} = k),
        s as (select *, octet_length(encode(body)) + length(found) + length(rest) as size from f)
        select doc_id, case when size > 20000 or doc_id % 11 = 0 then 'not_scanned' else token end as token,
          cast(case when size > 20000 or doc_id % 11 = 0 then -1 else octet_length(encode(body)) end as bigint) as offset,
          case when size > 20000 then 'too_large' when doc_id % 11 = 0 then 'no_header' else found end as found from s""",
)
def _(spark, d):
    ends = F.array(*(F.lit(t + r) for _, t, r in TOKENS))
    head = F.when(F.col("doc_id") % 11 == 0, F.lit("PDF\n")).otherwise(F.lit("%PDF-1.4\n"))
    text = F.concat(head, F.col("text"), F.lit(" "), F.get(ends, (F.col("doc_id") % len(TOKENS)).cast("int")))
    raw = spread(load(spark, d, "documents")).select("doc_id", F.encode(text, "UTF-8").alias("content"))
    return H.scan_tokens(raw, "doc_id", max_bytes=20_000)


# T11_scan_tokens and its statement check the status rows; this one scans every text whole, under the default cap
@query(
    "T11_scan_whole",
    f"""select doc_id, token, cast(octet_length(encode(concat('%PDF-1.4', chr(10), text, ' '))) as bigint) as offset, found
        from documents join (values {TOKEN_VALUES}) as v(k, token, found, rest) on doc_id % {len(TOKENS)} = k""",
)
def _(spark, d):
    ends = F.array(*(F.lit(t + r) for _, t, r in TOKENS))
    text = F.concat(F.lit("%PDF-1.4\n"), F.col("text"), F.lit(" "), F.get(ends, (F.col("doc_id") % len(TOKENS)).cast("int")))
    raw = spread(load(spark, d, "documents")).select("doc_id", F.encode(text, "UTF-8").alias("content"))
    return H.scan_tokens(raw, "doc_id")


SCRIPTS = """case doc_id % 9 when 0 then ' =cmd|x' when 1 then ' =Exec(1)' when 2 then ' file://a' when 3 then ' JavaScript:1' when 4 then ' run PowerShell'
  when 5 then ' eval  (x)' when 6 then ' WScript.Shell cmd /C' when 7 then ' document.WRITE' else ' evaluate' end"""


@query(
    "T12_scan_scripts",
    "with t as (select doc_id, concat(text, " + SCRIPTS + ") as text from documents) "
    + " union all ".join(
        f"select doc_id, '{kind}' as kind, {lit(name)} as pattern from t where regexp_matches(text, {lit(rx)})" for kind, name, rx, _ in R.SCRIPT_PATTERNS
    ),
)
def _(spark, d):
    t = spread(load(spark, d, "documents").select("doc_id", "text")).withColumn("text", F.expr(f"concat(text, {SCRIPTS})"))
    return H.scan_scripts(t, "doc_id", "text")


def results(spark, d):
    return load(spark, d, "v_scanner_result")


@query(
    "T20_max_severity",
    """select doc_id, cast(max(severity) as bigint) as max_level, case max(severity) when 0 then 'none' when 2 then 'low' when 4 then 'high' when 5 then 'critical' end as max_severity from v_scanner_result group by 1""",
)
def _(spark, d):
    return H.max_severity(results(spark, d), "doc_id")


KIND = "case when doc_id % 3 = 0 then 'vba_macro' else 'script' end"


@query(
    "T21_cdr_decision",
    f"""with f as (select doc_id, max(severity) as m, bool_or({KIND} = 'vba_macro') as macro from v_scanner_result where severity > 0 group by 1)
        select d.doc_id, case when f.m is null then 'skip' when f.m >= 4 then 'block' when f.macro then 'delegate' else 'sanitize' end as decision from documents d left join f on f.doc_id = d.doc_id""",
)
def _(spark, d):
    return H.cdr_decision(load(spark, d, "documents"), results(spark, d).withColumn("kind", F.expr(KIND)), "doc_id")


@query(
    "T22_findings_report",
    f"""select scanner, {KIND} as kind, cast(count(*) as bigint) as findings, cast(count(distinct doc_id) as bigint) as documents from v_scanner_result where severity > 0 group by 1, 2""",
)
def _(spark, d):
    return H.findings_report(results(spark, d).where("severity > 0").withColumn("kind", F.expr(KIND)), ["scanner", "kind"], "doc_id")


VERDICT = {
    "any_infected": "case when inf > 0 then 'infected' when bad > 0 then {err} else 'clean' end",
    "consensus": "case when inf > 0 and cl = 0 then 'infected' when bad > 0 then {err} else 'clean' end",
    "first_responder": "coalesce(first_verdict, {err})",
    "aggregate_all": "case when inf > 0 then 'infected' when bad > 0 then 'error' else 'clean' end",
}


def verdict_sql(mode: str, fail_open: bool) -> str:
    v = VERDICT[mode].replace("{err}", "'clean'" if fail_open else "'error'")
    sev = "first_severity" if mode == "first_responder" else "worst"
    return f"""
with a as (select doc_id, count(*) filter (where verdict = 'infected') as inf, count(*) filter (where verdict = 'clean') as cl, count(*) filter (where verdict = 'error') as bad,
  max(severity) filter (where verdict = 'infected') as worst, arg_min(verdict, ord) filter (where verdict <> 'error') as first_verdict,
  arg_min(severity, ord) filter (where verdict <> 'error') as first_severity from v_scanner_result group by 1),
z as (select *, {v} as verdict from a)
select doc_id, verdict, cast(case when verdict = 'infected' then {sev} else 0 end as bigint) as severity from z"""


def _verdicts(mode: str, fail_open: bool):
    def run(spark, d):
        return H.combine_verdicts(results(spark, d), "doc_id", mode, fail_open)

    return run


for _mode in H.SCAN_MODES:
    query(f"T23_verdict_{_mode}", verdict_sql(_mode, False))(_verdicts(_mode, False))
query("T23_verdict_any_infected_open", verdict_sql("any_infected", True))(_verdicts("any_infected", True))


RULES = [("email", ("soc@corp.example", "it@corp.example"), ("high", "critical")), ("webhook", ("https://hook.example",), ()), ("sms", ("+4900",), ("critical",))]
LEVEL = "case event_type when 'error' then 'critical' when 'purchase' then 'high' when 'view' then 'low' else 'info' end"


@query(
    "T27_notify",
    f"""with e as (select event_id, {LEVEL} as severity from events),
        r as (select * from (values ('email', 'soc@corp.example', 'high'), ('email', 'soc@corp.example', 'critical'), ('email', 'it@corp.example', 'high'), ('email', 'it@corp.example', 'critical'),
          ('webhook', 'https://hook.example', '*'), ('sms', '+4900', 'critical')) as v(channel, recipient, level))
        select e.event_id, e.severity, r.channel, r.recipient from e join r on r.level = '*' or r.level = e.severity""",
)
def _(spark, d):
    return H.notify(load(spark, d, "events").withColumn("severity", F.expr(LEVEL)), RULES, "event_id")


@query(
    "T28_route_rules",
    """with r as (select c_custkey as rule_id, concat('src-', cast(c_nationkey as string), '/*') as source_pattern, [concat('idp-', cast(c_nationkey as string)), 'idp-1'] as ps,
           case c_custkey % 4 when 0 then '0/min' when 1 then concat(cast(c_custkey as string), '/min') when 2 then '5/hour' else 'fast' end as rl from customer),
       b as (select rule_id, string_agg(distinct p, ',' order by p) as missing from (select rule_id, unnest(ps) as p from r) x where p not in (select concat('idp-', cast(n_nationkey as string)) from nation where n_nationkey < 20) group by 1)
       select r.rule_id, source_pattern, cast(case r.rule_id % 4 when 0 then -1 when 1 then r.rule_id else 0 end as bigint) as rate_per_min,
         case when b.missing is not null then concat('missing provider ', b.missing) when r.rule_id % 4 >= 2 then 'bad rate limit' else '' end as problem from r left join b on b.rule_id = r.rule_id""",
)
def _(spark, d):
    r = load(spark, d, "customer").selectExpr(
        "c_custkey as rule_id", "concat('src-', cast(c_nationkey as string), '/*') as source_pattern",
        "array(concat('idp-', cast(c_nationkey as string)), 'idp-1') as allowed_providers",
        "case c_custkey % 4 when 0 then '0/min' when 1 then concat(cast(c_custkey as string), '/min') when 2 then '5/hour' else 'fast' end as rate_limit",
    )
    p = load(spark, d, "nation").where("n_nationkey < 20").selectExpr("concat('idp-', cast(n_nationkey as string)) as name")
    return H.route_rules(r, p)


@query(
    "T28_route_source",
    "select file_id, case when filename like 'inbox/%' then 'in' when lower(filename) like '%.pdf' then 'pdf' else 'none' end as route_rule from v_file",
)
def _(spark, d):
    return H.route_source(load(spark, d, "v_file"), [("in", "inbox/*"), ("pdf", "*.pdf")], "filename").select("file_id", "route_rule")


@query(
    "T29_mail_zone",
    """with a as (select conv_id, conv_id % 3 = 0 as inside, bool_or(turn % 2 = 0) as has_in, bool_or(turn % 2 = 1) as has_out from conversations group by 1, 2)
       select conv_id, case when inside and not has_out then 'internal_to_internal' when inside then 'internal_to_external' when has_in then 'external_to_internal' else 'external_to_external' end as zone from a""",
)
def _(spark, d):
    return H.mail_zone(load(spark, d, "v_mail"), "conv_id", "sender", "rcpt", ["@CORP.example"])


ACT = "case turn % 5 when 0 then 'clean' when 1 then 'sanitized' when 2 then 'blocked' when 3 then 'quarantined' else 'error' end"


@query(
    "T30_attachment_summary",
    f"""with z as (select conv_id, case when conv_id % 3 = 0 and bool_or(turn % 2 = 1) then 'strict' else 'standard' end as policy from conversations group by 1),
        r as (select z.policy, {ACT} as act from conversations c join z on z.conv_id = c.conv_id)
        select policy, cast(count(*) filter (where act = 'clean') as bigint) as clean, cast(count(*) filter (where act = 'sanitized') as bigint) as sanitized,
          cast(count(*) filter (where act = 'blocked') as bigint) as blocked, cast(count(*) filter (where act = 'quarantined') as bigint) as quarantined,
          cast(count(*) filter (where act = 'error') as bigint) as error, cast(count(*) as bigint) as attachments from r group by 1""",
)
def _(spark, d):
    mail = load(spark, d, "v_mail")
    zones = H.zone_policy(H.mail_zone(mail, "conv_id", "sender", "rcpt", ["corp.example"]), "standard", "strict")
    return H.attachment_summary(mail.join(zones, "conv_id").withColumn("action", F.expr(ACT)), ["policy"])
