"""Secrecy classification of documents by their set of PII types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewall.functions.rows import computed_once, inline_rows
from tidewall.rules.secrecy import Scheme, SecrecyRule, controls_frame, levels_frame

RESULT = "struct<level_id:string,reason:string,matched_rules:array<string>>"


def eval_condition(types: Column, rule: SecrecyRule) -> Column:
    """One rule as a boolean column over the type array. Null types count as none."""
    t = F.coalesce(types, F.array().cast("array<string>"))

    def has(name: str) -> Column:
        return F.array_contains(t, F.lit(name))

    parts = []
    if rule.only_empty:
        parts.append(F.size(t) == 0)
    if rule.present:
        hits = reduce(lambda a, b: a + b, [has(n).cast("int") for n in rule.present])
        parts.append(hits >= rule.min_count)
    if rule.all_of:
        parts += [has(n) for n in rule.all_of]
    if rule.any_of:
        parts.append(reduce(lambda a, b: a | b, [has(n) for n in rule.any_of]))
    if rule.exclude_all:
        parts += [~has(n) for n in rule.exclude_all]
    if rule.exclude_any:
        parts.append(~reduce(lambda a, b: a & b, [has(n) for n in rule.exclude_any]))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def eval_conditions(df: DataFrame, key: str, types: str, scheme: Scheme) -> DataFrame:
    """One row per document and matching rule. Rules are literal columns, so nothing is joined."""
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    eval_condition(F.col(types), r),
                    F.struct(F.lit(i).cast("bigint").alias("rule_ord"), F.lit(r.id).alias("rule_id"), F.lit(r.level).alias("level_id")),
                )
                for i, r in enumerate(scheme.rules)
            ]
        )
    )
    return inline_rows(df, [key], found, "rule_id")


def classify_secrecy(df: DataFrame, types: str, scheme: Scheme) -> DataFrame:
    """Add level, rank, reason and matched rules. Several matches resolve by the scheme's conflict mode."""
    rank = {lv.id: lv.rank for lv in scheme.levels}
    t = F.col(types)
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    eval_condition(t, r),
                    F.struct(
                        F.lit(rank[r.level]).alias("rank"),
                        F.lit(i).alias("ord"),
                        F.lit(r.id).alias("rule"),
                        F.lit(r.level).alias("level"),
                        F.lit(r.reason).alias("reason"),
                    ),
                )
                for i, r in enumerate(scheme.rules)
            ]
        )
    )
    staged = df.withColumn("__rules", computed_once(found))
    rules = F.col("__rules")
    if scheme.conflict == "highest":
        best = F.array_max(rules)
    elif scheme.conflict == "lowest":
        best = F.array_min(rules)
    else:
        best = F.get(rules, 0)
    staged = staged.withColumn("__best", best)
    none = F.size("__rules") == 0
    level = F.when(none, F.lit(scheme.fallback)).otherwise(F.col("__best.level"))
    reason = (
        F.when(none, F.lit(f"No rules matched; using fallback level: {scheme.fallback}"))
        .when(
            F.size("__rules") == 1,
            F.concat(F.lit("Rule '"), F.col("__best.rule"), F.lit("' matched: "), F.col("__best.reason")),
        )
        .otherwise(F.col("__best.reason"))
    )
    ranks = F.create_map(*[x for k, v in rank.items() for x in (F.lit(k), F.lit(v))])
    out = staged.withColumns(
        {"level_id": level, "reason": reason, "matched_rules": F.transform("__rules", lambda r: r["rule"])}
    )
    return out.withColumn("level_rank", F.coalesce(F.element_at(ranks, F.col("level_id")), F.lit(0)).cast("bigint")).drop(
        "__rules", "__best"
    )


def level_info(df: DataFrame, scheme: Scheme, level: str = "level_id") -> DataFrame:
    """Display name, rank, colour and retention of each row's level; unknown levels keep their id."""
    info = F.broadcast(levels_frame(df.sparkSession, scheme)).withColumnRenamed("level_id", "__id")
    keep = [c for c in df.columns if c not in ("display_name", "level_rank", "color", "retention_years")]
    return df.select(*keep).join(info, F.col(level) == F.col("__id"), "left").select(
        *keep,
        F.coalesce("display_name", level).alias("display_name"),
        F.coalesce("level_rank", F.lit(0).cast("bigint")).alias("level_rank"),
        F.coalesce("color", F.lit(scheme.unknown_color)).alias("color"),
        F.coalesce("retention_years", F.lit(1).cast("bigint")).alias("retention_years"),
    )


def required_controls(df: DataFrame, key: str, scheme: Scheme, mandatory: bool = False, level: str = "level_id") -> DataFrame:
    """One row per document and control of its level."""
    controls = controls_frame(df.sparkSession, scheme)
    if mandatory:
        controls = controls.where("mandatory")
    return df.select(key, F.col(level).alias("level_id")).join(F.broadcast(controls), "level_id")


def secrecy_report(df: DataFrame, source: str, lang: str, level: str = "level_id") -> DataFrame:
    """Document counts by source, language and level, with every subtotal (cube)."""
    counts = df.groupBy(source, lang, level).count()
    return counts.cube(source, lang, level).agg(
        F.sum("count").alias("docs"), F.grouping_id().cast("bigint").alias("grouping_id")
    )
