"""Active content in markup and documents, scanner verdicts, mail zones and routing rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewall.functions.rows import computed_once, inline_rows
from tidewall.functions.text import gap_lengths, hit_offsets
from tidewall.rules import files as R

# a tag with its quoted values as units: a > inside them does not end it, a quote elsewhere is a plain character; the
# repeats are possessive, so a long tag needs no stack
_INSIDE = r"""(?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+"""
_TAG = rf"<[A-Za-z]{_INSIDE}>"
_TOKEN = rf"(?s)<[A-Za-z]{_INSIDE}>|</[^<>]*+>|<[!?][^<>]*+>|[^<]++|<"
_ATTR = r"""[A-Za-z_][A-Za-z0-9_:.-]*+\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>=`]++)"""
_SUSPECT = r"(?i)[\s\"'/]on[a-z]+\s*=|javascript|&#|&[a-z]+;|data:|https?://|style\s*=|<(?:[A-Za-z0-9_]+:)?(?:set|animate)"
THREAT = "array<struct<element:string,attribute:string,threat:string>>"


def _dangerous_events(text: Column) -> Column:
    """Opening, closing and self-closing tags of dangerous elements, in order, with the text after each.

    The pieces of the text between them are kept, so that the text can be put together again without what is nested.
    """
    names = "|".join(R.DANGEROUS_ELEMENTS)
    edge = rf"(?is)<(?:[A-Za-z0-9_]+:)?(?:{names})(?=[\s/>]){_INSIDE}>|</(?:[A-Za-z0-9_]+:)?(?:{names})\s*+>"
    return F.struct(F.regexp_extract_all(text, F.lit(edge), F.lit(0)).alias("tags"), F.split(text, edge, -1).alias("parts"))


def _walk_dangerous(events: Column) -> Column:
    """Which pieces lie outside dangerous elements, and the outermost elements found.

    Only tags of the element's own name count towards its depth; an element that is never closed runs to the end.
    """
    name = lambda t: F.lower(F.regexp_extract(t, r"^</?(?:[A-Za-z0-9_]+:)?([A-Za-z0-9_.-]+)", 1))

    def step(acc: Column, tag: Column) -> Column:
        closing, single = F.startswith(tag, F.lit("</")), F.endswith(tag, F.lit("/>"))
        outside = acc["depth"] == 0
        own = name(tag) == acc["name"]
        depth = (
            F.when(outside, F.when(closing | single, F.lit(0)).otherwise(F.lit(1)))
            .when(own & closing, acc["depth"] - 1)
            .when(own & ~single, acc["depth"] + 1)
            .otherwise(acc["depth"])
        )
        opens = outside & ~closing
        return F.struct(
            depth.alias("depth"),
            F.when(opens, name(tag)).otherwise(acc["name"]).alias("name"),
            F.when(opens, F.array_append(acc["found"], name(tag))).otherwise(acc["found"]).alias("found"),
            F.array_append(acc["outside"], depth == 0).alias("outside"),
        )

    start = F.struct(
        F.lit(0).alias("depth"), F.lit("").alias("name"), F.array().cast("array<string>").alias("found"), F.array(F.lit(True)).alias("outside")
    )
    return F.aggregate(events["tags"], start, step)


def _with_dangerous(df: DataFrame, html: str) -> DataFrame:
    """Adds ``__elements`` (names of dangerous elements) and ``__rest`` (the text without them)."""
    staged = df.withColumn("__events", computed_once(_dangerous_events(F.col(html))))
    staged = staged.withColumn("__walk", computed_once(F.when(F.size("__events.tags") > 0, _walk_dangerous(F.col("__events")))))
    kept = F.array_join(F.filter(F.col("__events.parts"), lambda p, i: F.get(F.col("__walk.outside"), i)), "")
    rest = F.when(F.col("__walk").isNull(), F.col(html)).otherwise(kept)
    names = F.coalesce(F.col("__walk.found"), F.array().cast("array<string>"))
    return staged.withColumn("__rest", computed_once(rest)).withColumn("__elements", names).drop("__events", "__walk")


def _tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"^<(?:[A-Za-z0-9_]+:)?([A-Za-z0-9_.-]+)", 1))


def _attr_name(attr: Column) -> Column:
    return F.lower(F.regexp_extract(attr, r"^([^=\s]+)", 1))


# --- fixed values: named entities that spell what a value test looks for ---
_NAMED = {"&colon;": ":", "&tab;": "", "&newline;": "", "&lpar;": "(", "&rpar;": ")", "&sol;": "/", "&quot;": '"', "&apos;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}
# --- end of fixed values ---


def _decoded(value: Column) -> Column:
    """Character references of a value read, and control characters and line breaks, which browsers pass over, left out."""
    code = lambda m: F.when(
        F.lower(F.substring(m, 3, 1)) == "x", F.conv(F.regexp_extract(m, r"([0-9A-Fa-f]+);?$", 1), 16, 10).cast("bigint")
    ).otherwise(F.regexp_extract(m, r"([0-9]+);?$", 1).cast("bigint"))
    char = lambda m: F.when(code(m).between(32, 126), F.chr(code(m))).when(code(m) < 32, F.lit("")).otherwise(m)
    refs = r"&#(?:[xX][0-9A-Fa-f]{1,7}+|[0-9]{1,8}+);?"
    text = F.split(value, refs, -1)
    found = F.regexp_extract_all(value, F.lit(refs), F.lit(0))
    read = F.array_join(F.zip_with(text, F.transform(found, char), lambda t, c: F.concat(t, F.coalesce(c, F.lit("")))), "")
    out = F.lower(F.when(F.contains(value, F.lit("&#")), read).otherwise(value))
    for name, char_ in _NAMED.items():
        out = F.replace(out, F.lit(name), F.lit(char_))
    return F.regexp_replace(out, r"[\x00-\x1F]++", "")


def _attr_value(attr: Column) -> Column:
    raw = F.regexp_extract(attr, r"""(?s)=\s*+(.*)$""", 1)
    quoted = F.startswith(raw, F.lit('"')) | F.startswith(raw, F.lit("'"))
    return _decoded(F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw))


def _attributes(tag: Column) -> Column:
    return F.regexp_extract_all(tag, F.lit(_ATTR), F.lit(0))


def _removed_tag(tag: Column) -> Column:
    """Self-closing tags that go as a whole: set, and animations started by an event."""
    name = _tag_name(tag)
    triggered = F.exists(
        _attributes(tag),
        lambda a: (_attr_name(a) == "begin") & _attr_value(a).rlike("|".join(R.ANIMATION_TRIGGERS)),
    )
    return F.endswith(tag, F.lit("/>")) & ((name == "set") | (name.isin(*R.ANIMATIONS) & triggered))


def _attr_threat(attr: Column) -> Column:
    """Threat class of an attribute, or null. Cases without a class of their own count as event handlers."""
    name, value = _attr_name(attr), _attr_value(attr)
    external = F.startswith(value, F.lit("http://")) | F.startswith(value, F.lit("https://"))

    def holds(words) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(value, F.lit(w))
        return out

    return (
        F.when(name.isin(*R.EVENT_HANDLERS), F.lit("event_handler"))
        .when(F.contains(value, F.lit("javascript:")), F.lit("javascript_href"))
        .when(holds(R.SCRIPT_DATA_TYPES[:2]), F.lit("data_uri_script"))
        .when(holds(R.SCRIPT_DATA_TYPES[2:]), F.lit("event_handler"))
        .when(name.isin("href", "xlink:href") & external, F.lit("external_resource"))
        .when((name == "src") & external, F.lit("event_handler"))
        .when((name == "style") & holds(R.STYLE_THREATS[:2]), F.lit("css_expression"))
        .when((name == "style") & holds(R.STYLE_THREATS[2:]), F.lit("event_handler"))
    )


def with_markup_threats(df: DataFrame, html: str, out: str = "threats") -> DataFrame:
    """Add the array of threats (element, attribute, threat) of a markup column.

    What sits inside a removed element is not reported on its own. Only tags that can hold a threat
    have their attributes parsed.
    """
    threat_of = F.create_map(*(F.lit(x) for pair in R.DANGEROUS_ELEMENTS.items() for x in pair))
    staged = _with_dangerous(df, html).withColumn(
        "__tags", F.filter(F.regexp_extract_all("__rest", F.lit(_TAG), F.lit(0)), lambda t: t.rlike(_SUSPECT))
    )
    elements = F.transform(
        "__elements", lambda n: F.struct(n.alias("element"), F.lit("").alias("attribute"), F.element_at(threat_of, n).alias("threat"))
    )

    def tag_threats(tag: Column) -> Column:
        name = _tag_name(tag)
        whole = F.array(
            F.struct(
                name.alias("element"),
                F.lit("").alias("attribute"),
                F.when(name == "set", F.lit("set_element")).otherwise(F.lit("animation_with_script")).alias("threat"),
            )
        )
        parts = F.filter(
            F.transform(
                _attributes(tag),
                lambda a: F.struct(name.alias("element"), _attr_name(a).alias("attribute"), _attr_threat(a).alias("threat")),
            ),
            lambda s: s["threat"].isNotNull(),
        )
        return F.when(_removed_tag(tag), whole).otherwise(parts)

    found = F.concat(elements, F.flatten(F.transform("__tags", tag_threats)))
    return staged.withColumn(out, computed_once(F.coalesce(found, F.array().cast(THREAT)))).drop("__elements", "__tags", "__rest")


def scan_markup(df: DataFrame, key: str, html: str) -> DataFrame:
    """One row per threat."""
    return inline_rows(with_markup_threats(df.select(key, html), html), [key], F.col("threats"), "threat")


def sanitize_markup(df: DataFrame, html: str, out: str = "clean_html") -> DataFrame:
    """Remove dangerous elements, triggered animations and dangerous attributes; text is untouched."""
    staged = _with_dangerous(df, html).withColumn("__tokens", computed_once(F.regexp_extract_all("__rest", F.lit(_TOKEN), F.lit(0))))

    def clean(token: Column) -> Column:
        bad = F.filter(_attributes(token), lambda a: _attr_threat(a).isNotNull())
        stripped = F.aggregate(bad, token, lambda acc, a: F.replace(acc, a, F.lit("")))
        return F.when(_removed_tag(token), F.lit("")).otherwise(stripped)

    cleaned = F.transform(
        "__tokens", lambda t: F.when(t.rlike(r"^<[A-Za-z]") & t.rlike(_SUSPECT), clean(t)).otherwise(t)
    )
    return staged.withColumn(out, F.array_join(cleaned, "")).drop("__tokens", "__rest", "__elements")


def is_safe_markup(df: DataFrame, key: str, html: str) -> DataFrame:
    """Threat count and safe flag per page."""
    return with_markup_threats(df.select(key, html), html).select(
        key, F.size("threats").cast("bigint").alias("threat_count"), (F.size("threats") == 0).alias("is_safe")
    )


def scan_tokens(
    files: DataFrame,
    key: str,
    content: str = "content",
    tokens: tuple[tuple[str, str], ...] = R.DOCUMENT_TOKENS,
    max_bytes: int = R.MAX_DOCUMENT_BYTES,
    header: str | None = "%PDF",
) -> DataFrame:
    """One row per active-content token of raw files: token, offset (in bytes) and text.

    Bytes are read as Latin-1, one character each, so offsets are byte offsets. A file over ``max_bytes``, without the
    header, or without content is not passed over: it gives one row with the token 'not_scanned', offset -1 and the reason.
    """
    size = F.octet_length(content)
    starts = F.startswith(F.decode(F.substring(content, 1, len(header or "")), "ISO-8859-1"), F.lit(header)) if header else F.lit(True)
    why = F.when(size.isNull(), F.lit("no_content")).when(size > max_bytes, F.lit("too_large")).when(~starts, F.lit("no_header"))
    unread = files.select(key, why.alias("found")).where(F.col("found").isNotNull())
    unread = unread.select(key, F.lit("not_scanned").alias("token"), F.lit(-1).cast("bigint").alias("offset"), "found")
    text = files.where(why.isNull()).select(key, F.decode(content, "ISO-8859-1").alias("__text"))
    hits = text.withColumns(
        {f"__h{i}": F.regexp_extract_all("__text", F.lit(rx), F.lit(0)) for i, (_, rx) in enumerate(tokens)}
    )
    gaps = hits.withColumns(
        {f"__g{i}": F.when(F.size(f"__h{i}") > 0, gap_lengths(F.col("__text"), rx)) for i, (_, rx) in enumerate(tokens)}
    )
    kind = "array<struct<token:string,offset:bigint,found:string>>"

    def named(name: str):
        return lambda h, o: F.struct(F.lit(name).alias("token"), o.cast("bigint").alias("offset"), h.alias("found"))

    arrays = [
        F.when(F.size(f"__h{i}") == 0, F.array().cast(kind)).otherwise(
            F.zip_with(f"__h{i}", hit_offsets(F.col(f"__h{i}"), F.col(f"__g{i}")), named(name))
        )
        for i, (name, _) in enumerate(tokens)
    ]
    return inline_rows(gaps, [key], F.concat(*arrays), "token").unionByName(unread)


def scan_scripts(df: DataFrame, key: str, text: str, patterns=R.SCRIPT_PATTERNS) -> DataFrame:
    """One row per document and script, DDE or protocol pattern it holds.

    A literal every hit contains is looked up first in the lower-cased text, which spares the regex
    on almost every row.
    """
    low = df.select(key, F.col(text).alias("__text"), F.lower(text).alias("__low"))
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    F.contains("__low", F.lit(literal)) & F.col("__text").rlike(rx),
                    F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("pattern")),
                )
                for kind, name, rx, literal in patterns
            ]
        )
    )
    return inline_rows(low, [key], found, "pattern")


# ---- findings and verdicts ----
def severity_level(col: Column) -> Column:
    pairs = [x for k, v in R.SEVERITY_LEVEL.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), col)


def severity_name(level: Column) -> Column:
    out = F.lit("none")
    for name, n in R.SEVERITY_LEVEL.items():
        out = F.when(level == n, F.lit(name)).otherwise(out)
    return out


def max_severity(findings: DataFrame, key: str, level: str = "severity") -> DataFrame:
    """Worst severity per document, as a number and a name."""
    return findings.groupBy(key).agg(F.max(level).cast("bigint").alias("max_level")).withColumn(
        "max_severity", severity_name(F.col("max_level"))
    )


def cdr_decision(docs: DataFrame, findings: DataFrame, key: str, default_action: str = "block", level: str = "severity", kind: str = "kind") -> DataFrame:
    """Skip without findings; block high and critical under a blocking policy; delegate macros; else sanitise."""
    agg = findings.where(F.col(level) > 0).groupBy(key).agg(
        F.max(level).alias("__max"), F.bool_or(F.col(kind) == "vba_macro").alias("__macro")
    )
    return docs.select(key).join(agg, key, "left").select(
        key,
        F.when(F.col("__max").isNull(), F.lit("skip"))
        .when(F.lit(default_action == "block") & (F.col("__max") >= 4), F.lit("block"))
        .when(F.coalesce("__macro", F.lit(False)), F.lit("delegate"))
        .otherwise(F.lit("sanitize"))
        .alias("decision"),
    )


def findings_report(findings: DataFrame, by: list[str], key: str) -> DataFrame:
    """Findings and documents per group. Each (group, document) pair is reduced first."""
    pairs = findings.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(*by).agg(F.sum("n").alias("findings"), F.count(F.lit(1)).alias("documents"))


SCAN_MODES = ("any_infected", "consensus", "first_responder", "aggregate_all")


def combine_verdicts(results: DataFrame, key: str, mode: str = "any_infected", fail_open: bool = False) -> DataFrame:
    """One verdict per document from several scanners (verdict clean|infected|error|timeout, severity, ord).

    ``any_infected``: one infected answer decides; failures are an error unless failing open.
    ``consensus``: infected only when every scanner that answered says so.
    ``first_responder``: the lowest ``ord`` with a real answer.
    ``aggregate_all``: the worst answer, infected over error over timeout over clean.
    Every mode is one partial aggregation.
    """
    if mode not in SCAN_MODES:
        raise ValueError(f"mode must be one of {SCAN_MODES}")
    v = F.col("verdict")
    failed = v.isin("error", "timeout")
    agg = results.groupBy(key).agg(
        F.count_if(v == "infected").alias("infected"),
        F.count_if(v == "clean").alias("clean"),
        F.count_if(failed).alias("failed"),
        F.count_if(v == "error").alias("errors"),
        F.max(F.when(v == "infected", F.col("severity"))).alias("worst"),
        F.min(F.when(~failed, F.struct("ord", "verdict", "severity"))).alias("first"),
    )
    err = F.lit("clean" if fail_open else "error")
    if mode == "any_infected":
        verdict = F.when(F.col("infected") > 0, F.lit("infected")).when(F.col("failed") > 0, err).otherwise(F.lit("clean"))
    elif mode == "consensus":
        verdict = (
            F.when((F.col("infected") > 0) & (F.col("clean") == 0), F.lit("infected"))
            .when(F.col("failed") > 0, err)
            .otherwise(F.lit("clean"))
        )
    elif mode == "first_responder":
        verdict = F.coalesce("first.verdict", err)
    else:
        verdict = (
            F.when(F.col("infected") > 0, F.lit("infected"))
            .when(F.col("errors") > 0, F.lit("error"))
            .when(F.col("failed") > 0, F.lit("timeout"))
            .otherwise(F.lit("clean"))
        )
    staged = agg.withColumn("verdict", verdict)
    worst = F.col("first.severity") if mode == "first_responder" else F.col("worst")
    return staged.select(
        key, "verdict", F.when(F.col("verdict") == "infected", worst).otherwise(F.lit(0)).cast("bigint").alias("severity")
    )


# ---- notification, routing, mail ----
def notify(events: DataFrame, rules: list[tuple[str, tuple[str, ...], tuple[str, ...]]], key: str, severity: str = "severity") -> DataFrame:
    """One row per event, channel and recipient. Rules: (channel, recipients, severities; none = all)."""
    sends = F.flatten(
        F.array(
            *[
                F.when(
                    F.lit(True) if not levels else F.coalesce(F.col(severity).isin(*levels), F.lit(False)),
                    F.array(
                        *[F.struct(F.lit(channel).alias("channel"), F.lit(r).alias("recipient")) for r in recipients]
                    ),
                ).otherwise(F.array().cast("array<struct<channel:string,recipient:string>>"))
                for channel, recipients, levels in rules
            ]
        )
    )
    return inline_rows(events, [key, F.col(severity).alias("severity")], sends, "channel")


def parse_rate(limit: Column) -> Column:
    """Requests per minute of 'N/min'; 0/min is unlimited (−1); anything else null."""
    n = F.nullif(F.regexp_extract(limit, r"^(\d+)/min$", 1), F.lit("")).try_cast("bigint")
    return F.when(n == 0, F.lit(-1).cast("bigint")).otherwise(n)


def route_rules(rules: DataFrame, providers: DataFrame) -> DataFrame:
    """Check routing rules: the providers they name must exist and the rate must parse.

    ``rules``: rule_id, source_pattern, allowed_providers, rate_limit. ``providers``: name.
    """
    dangling = (
        rules.select("rule_id", F.explode("allowed_providers").alias("name"))
        .join(providers.select("name"), "name", "left_anti")
        .groupBy("rule_id")
        .agg(F.array_sort(F.collect_set("name")).alias("missing"))
    )
    joined = rules.join(dangling, "rule_id", "left").withColumn("rate_per_min", parse_rate(F.col("rate_limit")))
    return joined.select(
        "rule_id",
        "source_pattern",
        F.coalesce("rate_per_min", F.lit(0).cast("bigint")).alias("rate_per_min"),
        F.when(F.col("missing").isNotNull(), F.concat(F.lit("missing provider "), F.array_join("missing", ",")))
        .when(F.col("rate_per_min").isNull(), F.lit("bad rate limit"))
        .otherwise(F.lit(""))
        .alias("problem"),
    )


def route_source(df: DataFrame, rules: list[tuple[str, str]], source: str, default: str = "none") -> DataFrame:
    """The first routing rule (id, source glob) that fits each row."""
    from tidewall.operators.files import glob_regex

    out = F.lit(default)
    for rule_id, glob in reversed(rules):
        out = F.when(F.coalesce(F.col(source).rlike(glob_regex(glob)), F.lit(False)), F.lit(rule_id)).otherwise(out)
    return df.withColumn("route_rule", out)


def _internal(address: Column, domains: list[str]) -> Column:
    out = F.lit(False)
    for d in domains:
        out = out | F.endswith(F.lower(address), F.lit(d.lower()))
    return F.coalesce(out, F.lit(False))


def mail_zone(pairs: DataFrame, key: str, sender: str, rcpt: str, domains: list[str]) -> DataFrame:
    """Zone of each message from rows of (sender, recipient): two flags per message, no address lists.

    Without internal domains everything is external.
    """
    agg = pairs.groupBy(key).agg(
        F.min(sender).alias("__sender"),
        F.bool_or(_internal(F.col(rcpt), domains)).alias("__in"),
        F.bool_or(~_internal(F.col(rcpt), domains)).alias("__out"),
    )
    inside = _internal(F.col("__sender"), domains)
    zone = (
        F.when(inside & ~F.col("__out"), F.lit("internal_to_internal"))
        .when(inside, F.lit("internal_to_external"))
        .when(F.col("__in"), F.lit("external_to_internal"))
        .otherwise(F.lit("external_to_external"))
    )
    return agg.select(key, (F.lit("external_to_external") if not domains else zone).alias("zone"))


def zone_policy(df: DataFrame, default: str, outbound: str | None = None, zone: str = "zone") -> DataFrame:
    """Outbound mail may have a policy of its own; every other zone uses the default."""
    return df.withColumn(
        "policy", F.when(F.col(zone) == "internal_to_external", F.lit(outbound or default)).otherwise(F.lit(default))
    )


def attachment_summary(results: DataFrame, by: list[str], action: str = "action") -> DataFrame:
    """Attachment counts per action: clean, sanitized, blocked, quarantined, error."""
    a = F.col(action)
    return results.groupBy(*by).agg(
        *[F.count_if(a == n).alias(n) for n in ("clean", "sanitized", "blocked", "quarantined", "error")],
        F.count(F.lit(1)).alias("attachments"),
    )
