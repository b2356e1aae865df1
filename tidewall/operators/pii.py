"""Personal data in free text.

Matches live in one array column beside the text, so scanning, scoring, classifying and redacting a
document is a chain of projections: no shuffle, no join back to the text. ``pii_scan`` is the long
form, one row per match.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewall.functions.patterns import bit_is_set, may_match
from tidewall.functions.rows import computed_once, inline_rows
from tidewall.functions.text import (
    after_window,
    before_window,
    hit_offsets,
    mask_value,
    overwrite_segments,
    redaction_segments,
)
from tidewall.rules.context import (
    CONFIDENCE_BOOST,
    CONFIDENCE_PENALTY,
    CONTEXT_WINDOW,
    GLOBAL,
    POSITIVE_THRESHOLD,
    Keyword,
)
from tidewall.rules.pii import ACTION_RANK, PII_TYPE_OF, TextRule, valid_rules

MATCH_TYPE = (
    "array<struct<offset:int,rule_ord:int,rule:string,action:string,pii_type:string,"
    "matched_text:string,masked_text:string,length:int>>"
)


_FACTS = "array<struct<rule:string,action:string,pii_type:string,mask_char:string>>"


def with_matches(
    df: DataFrame,
    text: str,
    rules: list[TextRule],
    out: str = "matches",
    type_map: dict[str, str] | None = None,
    gate: bool = True,
) -> DataFrame:
    """Add the array of matches of all rules, ordered by offset, then by rule order.

    A fast test first says which rules a text might match at all; ``gate=False`` leaves it out and
    stays in the JVM. One regex pass per such rule finds the hits, and only texts with hits are split
    a second time for the offsets. Offsets and lengths are in characters.
    """
    if len(valid_rules(rules)) != len(rules):
        raise ValueError("rule pack holds unusable rules; see valid_rules")
    types = PII_TYPE_OF if type_map is None else type_map
    keep = df.columns
    none = F.array().cast("array<string>")
    col = F.col(text)
    if not rules:
        return df.withColumn(out, F.array().cast(MATCH_TYPE))
    if gate:
        df = df.withColumn("__gate", may_match(col, [r.pattern for r in rules], df.sparkSession))
    hits = {}
    for i, r in enumerate(rules):
        found = F.regexp_extract_all(col, F.lit(r.pattern), F.lit(0))
        if gate:
            found = F.when(bit_is_set(F.col("__gate"), i), found).otherwise(none)
        elif r.needs:
            found = F.when(F.contains(col, F.lit(r.needs)), found).otherwise(none)
        hits[f"__hits{i}"] = F.coalesce(found, none)
    per_rule = F.array(
        *[
            F.when(
                F.size(f"__hits{i}") > 0,
                F.struct(
                    F.lit(i).alias("rule_ord"),
                    F.col(f"__hits{i}").alias("hits"),
                    F.split(col, r.pattern, -1).alias("parts"),
                ),
            )
            for i, r in enumerate(rules)
        ]
    )
    step = df.withColumns(hits).select(*keep, F.array_compact(per_rule).alias("__rules"))
    facts = [
        {"rule": r.name, "action": r.action, "pii_type": types.get(r.name, r.name), "mask_char": r.mask_char} for r in rules
    ]
    # a literal table of the rules' properties, folded to a constant when the query is planned
    table = F.from_json(F.lit(json.dumps(facts)), _FACTS)
    merged = F.flatten(F.transform("__rules", lambda r: _rule_matches(r, table)))
    return step.select(*keep, computed_once(F.array_sort(merged).cast(MATCH_TYPE)).alias(out))


def _rule_matches(rule: Column, table: Column) -> Column:
    """Match structs of one rule. The one-element array binds what each hit needs, computed once."""
    bound = F.array(
        F.struct(
            rule["hits"].alias("hits"),
            F.transform(rule["parts"], lambda p: F.length(p)).alias("gaps"),
            F.get(table, rule["rule_ord"]).alias("facts"),
        )
    )

    def build(b: Column) -> Column:
        return F.zip_with(
            b["hits"],
            hit_offsets(b["hits"], b["gaps"]),
            lambda hit, offset: F.struct(
                offset.alias("offset"),
                rule["rule_ord"].alias("rule_ord"),
                b["facts"]["rule"].alias("rule"),
                b["facts"]["action"].alias("action"),
                b["facts"]["pii_type"].alias("pii_type"),
                hit.alias("matched_text"),
                mask_value(hit, b["facts"]["mask_char"]).alias("masked_text"),
                F.length(hit).alias("length"),
            ),
        )

    return F.flatten(F.transform(bound, build))


def explode_matches(df: DataFrame, keys: list[str], matches: str = "matches") -> DataFrame:
    """One row per match, keyed by the given columns."""
    return inline_rows(df, keys, F.col(matches), "rule")


def pii_scan(df: DataFrame, keys: list[str], text: str, rules: list[TextRule], byte_offsets: bool = False) -> DataFrame:
    """One row per match: rule, action, matched and masked text, offset, length."""
    scanned = with_matches(df.select(*keys, text), text, rules)
    if not byte_offsets:
        return explode_matches(scanned, keys)
    with_bytes = F.transform(
        "matches", lambda m: m.withField("byte_offset", F.octet_length(F.substring(F.col(text), F.lit(1), m["offset"])))
    )
    return explode_matches(scanned.withColumn("matches", with_bytes), keys)


def redact_text(df: DataFrame, text: str, matches: str = "matches", out: str = "redacted_text") -> DataFrame:
    """Write the masked texts over the text; the length never changes."""
    staged = df.withColumn("__segments", redaction_segments(F.col(matches)))
    return staged.withColumn(out, overwrite_segments(F.col(text), F.col("__segments"))).drop("__segments")


def matches_by_document(matches: DataFrame, keys: list[str]) -> DataFrame:
    """A match table folded back to one array per document, for tables scanned elsewhere.

    A document is one cell of the text table, which bounds its matches.
    """
    return matches.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(F.struct("offset", "rule_ord", "rule", "action", "pii_type", "matched_text", "masked_text", "length"))
        ).alias("matches")
    )


def action_rank(col: Column) -> Column:
    out = F.lit(0)
    for name, rank in ACTION_RANK.items():
        out = F.when(col == name, F.lit(rank)).otherwise(out)
    return out


def action_name(rank: Column, default: str) -> Column:
    out = F.lit(default)
    for name, r in ACTION_RANK.items():
        out = F.when(rank == r, F.lit(name)).otherwise(out)
    return out


def doc_action(matches: Column, default: str = "alert_only") -> Column:
    """Strictest action of a document's matches: block, then mask, then alert; else the default."""
    rank = F.aggregate(matches, F.lit(0), lambda a, m: F.greatest(a, action_rank(m["action"])))
    return action_name(rank, default)


def doc_actions(docs: DataFrame, matches: DataFrame, key: str, default: str = "alert_only") -> DataFrame:
    """The same from a match table: partial maxima per document, then a left join to all documents."""
    ranks = matches.groupBy(key).agg(F.max(action_rank(F.col("action"))).alias("__rank"))
    return docs.join(ranks, key, "left").select(
        key, action_name(F.coalesce("__rank", F.lit(0)), default).alias("doc_action")
    )


def pii_types(matches: Column) -> Column:
    """Sorted set of PII types of a document's matches."""
    return F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["pii_type"])))


def pii_types_of(matches: DataFrame, key: str) -> DataFrame:
    """Type set per document from a match table; the set is bounded by the number of types."""
    return matches.groupBy(key).agg(F.array_sort(F.collect_set("pii_type")).alias("pii_types"))


def pii_summary(df: DataFrame, group: str, text: str, key: str, rules: list[TextRule]) -> DataFrame:
    """Hits and documents per group and rule, with group and grand totals (rule null = all rules).

    Each document first adds up its own hits per rule, inside its row, so the shuffle carries counts.
    """
    scanned = with_matches(df.select(group, key, text), text, rules)
    names = F.array(*[F.lit(r.name) for r in rules])
    per_doc = scanned.select(
        group,
        F.octet_length(text).cast("bigint").alias("bytes"),
        F.transform(
            names,
            lambda n: F.struct(
                n.alias("rule"), F.size(F.filter("matches", lambda m: m["rule"] == n)).cast("bigint").alias("hits")
            ),
        ).alias("counts"),
    )
    rows = inline_rows(per_doc, [group], F.col("counts"), "rule")
    by_rule = rows.where("hits > 0").rollup(group, "rule").agg(
        F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("doc_rules")
    )
    return by_rule


def scan_bytes(df: DataFrame, key: str, text: str, rules: list[TextRule], group: list[str] | None = None) -> DataFrame:
    """Per document: found flag, number of matches, bytes scanned and strictest action."""
    scanned = with_matches(df.select(key, *(group or []), text), text, rules)
    return scanned.select(
        key,
        *(group or []),
        (F.size("matches") > 0).alias("found"),
        F.size("matches").cast("bigint").alias("match_count"),
        F.octet_length(text).cast("bigint").alias("bytes_scanned"),
        doc_action(F.col("matches")).alias("doc_action"),
    )


def with_context(df: DataFrame, text: str, matches: str = "matches", size: int = CONTEXT_WINDOW) -> DataFrame:
    """Give every match its prefix and suffix window."""
    col = F.col(text)
    return df.withColumn(
        matches,
        F.transform(
            matches,
            lambda m: m.withField("prefix", before_window(col, m["offset"], size)).withField(
                "suffix", after_window(col, m["offset"], m["length"], size)
            ),
        ),
    )


def context_window(df: DataFrame, keys: list[str], text: str, rules: list[TextRule], size: int = CONTEXT_WINDOW) -> DataFrame:
    """Match table with prefix and suffix."""
    return explode_matches(with_context(with_matches(df.select(*keys, text), text, rules), text, size=size), keys)


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hit_sql(k: Keyword, m: str, case_sensitive: bool) -> str:
    """The test of one keyword against the prefix and suffix of ``m``, as SQL text.

    A keyword list makes a long expression; one parse of its text is far quicker than building it
    call by call.
    """
    word = _quote(k.keyword if case_sensitive else k.keyword.lower())
    before, after = f"contains({m}prefix, {word})", f"contains({m}suffix, {word})"
    test = {"before": before, "after": after}.get(k.position, f"({before} or {after})")
    scope = "" if k.pii_type == GLOBAL else f"{m}pii_type = {_quote(k.pii_type)} and "
    return f"coalesce({scope}{test}, false)"


def _ranked(keywords: list[Keyword], polarity: str) -> list[Keyword]:
    """Keywords of one side: those of a type, then the global ones."""
    own = [k for k in keywords if k.polarity == polarity]
    return [k for k in own if k.pii_type != GLOBAL] + [k for k in own if k.pii_type == GLOBAL]


def _found_sql(keywords: list[Keyword], polarity: str, m: str, case_sensitive: bool) -> str:
    """Array of (word, weight) of the keywords that hit."""
    parts = [
        f"case when {_hit_sql(k, m, case_sensitive)} then named_struct('word', "
        f"{_quote(('global:' if k.pii_type == GLOBAL else '') + k.keyword)}, 'weight', {float(k.weight)!r}D) end"
        for k in _ranked(keywords, polarity)
    ]
    if not parts:
        return "cast(array() as array<struct<word:string,weight:double>>)"
    return f"array_compact(array({', '.join(parts)}))"


def score_context(
    matches: DataFrame,
    keywords: list[Keyword],
    threshold: float = POSITIVE_THRESHOLD,
    case_sensitive: bool = False,
) -> DataFrame:
    """Score each match by the keywords around it.

    The score is (tanh(positive − anti − global anti) + 1) / 2. Keyword lists are small and known on
    the driver, so each becomes a literal test per row: no join, no fan-out.
    """
    low = matches
    if not case_sensitive:
        low = matches.withColumns({"__prefix": F.col("prefix"), "__suffix": F.col("suffix")}).withColumns(
            {"prefix": F.lower("prefix"), "suffix": F.lower("suffix")}
        )
    staged = low.withColumns(
        {
            "__pos": computed_once(F.expr(_found_sql(keywords, "positive", "", case_sensitive))),
            "__anti": computed_once(F.expr(_found_sql(keywords, "anti", "", case_sensitive))),
        }
    )
    if not case_sensitive:
        staged = staged.withColumns({"prefix": F.col("__prefix"), "suffix": F.col("__suffix")}).drop("__prefix", "__suffix")

    def total(col: str) -> Column:
        return F.aggregate(col, F.lit(0.0), lambda a, x: a + x["weight"])

    scored = staged.withColumn("score", (F.tanh(total("__pos") - total("__anti")) + 1) / 2)
    is_pii = F.col("score") >= threshold
    return scored.select(
        *matches.columns,
        "score",
        is_pii.alias("is_pii"),
        F.when(is_pii, F.least(F.col("score") + CONFIDENCE_BOOST, F.lit(1.0)))
        .otherwise(F.least(1 - F.col("score") + CONFIDENCE_PENALTY, F.lit(1.0)))
        .alias("confidence"),
        F.transform("__pos", lambda x: x["word"]).alias("positive_words"),
        F.transform("__anti", lambda x: x["word"]).alias("negative_words"),
    )


def context_reason(scored: DataFrame) -> DataFrame:
    """Add the sentence that explains the decision."""
    pos, neg = F.array_join("positive_words", ", "), F.array_join("negative_words", ", ")
    return scored.withColumn(
        "reason",
        F.when(
            F.col("is_pii") & (F.size("positive_words") > 0),
            F.concat(F.lit("Confirmed as PII: positive indicators ["), pos, F.lit("] outweigh negatives ["), neg, F.lit("]")),
        )
        .when(F.col("is_pii"), F.concat(F.lit("Confirmed as PII (default): no strong anti-signals ["), neg, F.lit("]")))
        .otherwise(
            F.concat(F.lit("Rejected as false positive: anti-signals ["), neg, F.lit("] outweigh positives ["), pos, F.lit("]"))
        ),
    )


def keep_confirmed(
    df: DataFrame, matches: str, keywords: list[Keyword], threshold: float = POSITIVE_THRESHOLD
) -> DataFrame:
    """In-row form of scoring: drop the matches whose context rejects them. Needs ``with_context``."""
    low = df.withColumn(
        matches,
        F.transform(
            matches,
            lambda m: m.withField("prefix", F.lower(m["prefix"])).withField("suffix", F.lower(m["suffix"])),
        ),
    )

    # weights are added in the order of score_context: positive, then anti, then global anti
    positive = [f"if({_hit_sql(k, 'm.', False)}, {float(k.weight)!r}D, 0D)" for k in _ranked(keywords, "positive")]
    anti = [f"if({_hit_sql(k, 'm.', False)}, {float(k.weight)!r}D, 0D)" for k in _ranked(keywords, "anti")]
    net = f"({' + '.join(['0D', *positive])}) - ({' + '.join(['0D', *anti])})"
    kept = F.expr(f"filter(`{matches}`, m -> (tanh({net}) + 1) / 2 >= {float(threshold)!r}D)")
    return low.withColumn(matches, computed_once(kept))


def confirm_matches(scored: DataFrame) -> DataFrame:
    return scored.where("is_pii")


def rejected_matches(scored: DataFrame) -> DataFrame:
    return scored.where(~F.coalesce(F.col("is_pii"), F.lit(False)))


def merge_rulesets(sources: list[list[Keyword]]) -> list[Keyword]:
    """Global words add up; the keywords of a type come from the last source that names the type."""
    last = {k.pii_type: i for i, src in enumerate(sources) for k in src if k.pii_type != GLOBAL}
    typed = [k for i, src in enumerate(sources) for k in src if k.pii_type != GLOBAL and last[k.pii_type] == i]
    return typed + [k for src in sources for k in src if k.pii_type == GLOBAL]


def merge_ruleset_frames(rules: DataFrame) -> DataFrame:
    """The same over a table of rule rows with ``source_ord``."""
    last = rules.where(F.col("pii_type") != GLOBAL).groupBy("pii_type").agg(F.max("source_ord").alias("source_ord"))
    typed = rules.join(last, ["pii_type", "source_ord"], "left_semi")
    return typed.unionByName(rules.where(F.col("pii_type") == GLOBAL))


def add_keyword(keywords: list[Keyword], keyword: Keyword) -> list[Keyword]:
    return [*keywords, keyword]


def remove_keyword(keywords: list[Keyword], pii_type: str, word: str) -> list[Keyword]:
    """Drop a positive keyword of a type."""
    return [
        k for k in keywords if not (k.pii_type == pii_type and k.polarity == "positive" and k.keyword == word)
    ]


def score_with_fallback(
    matches: DataFrame,
    external: DataFrame,
    on: list[str],
    keywords: list[Keyword],
    mode: str = "graceful",
) -> DataFrame:
    """Prefer an external verdict (``ext_is_pii``, ``ext_confidence``); fall back to the keywords.

    ``keyword_only`` ignores the external table. ``fail_fast`` raises inside the job on the first
    match without an external verdict.
    """
    if mode not in ("graceful", "keyword_only", "fail_fast"):
        raise ValueError("mode must be graceful, keyword_only or fail_fast")
    scored = score_context(matches, keywords)
    if mode == "keyword_only":
        return scored.withColumn("score_source", F.lit("keyword"))
    joined = scored.join(external.select(*on, "ext_is_pii", "ext_confidence"), on, "left")
    got = F.col("ext_is_pii").isNotNull()
    if mode == "fail_fast":
        joined = joined.withColumn(
            "is_pii",
            F.when(got, F.col("ext_is_pii")).otherwise(F.raise_error(F.lit("no external verdict")).cast("boolean")),
        )
    else:
        joined = joined.withColumn("is_pii", F.when(got, F.col("ext_is_pii")).otherwise(F.col("is_pii")))
    return joined.withColumns(
        {
            "confidence": F.when(got, F.col("ext_confidence")).otherwise(F.col("confidence")),
            "score_source": F.when(got, F.lit("external")).otherwise(F.lit("keyword")),
        }
    ).drop("ext_is_pii", "ext_confidence")


def pii_scan_blocks(
    blocks: DataFrame, keys: list[str], text: str, confidence: str, rules: list[TextRule], min_confidence: float = 0.5
) -> DataFrame:
    """Scan recognised text blocks, leaving out those read with too little confidence."""
    return pii_scan(blocks.where(F.col(confidence) >= min_confidence), keys, text, rules)


def size_guard(df: DataFrame, col: str, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(rows within the limit, rows over it). Null counts as empty."""
    over = F.coalesce(F.octet_length(col), F.lit(0)) > max_bytes
    return df.where(~over), df.where(over)
