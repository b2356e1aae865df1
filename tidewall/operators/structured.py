"""Personal data in tables, JSON and XML, found by field name."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewall.functions.rows import inline_rows
from tidewall.functions.text import mask_value
from tidewall.rules.fields import (
    FIELD_ACTION_RANK,
    MIN_CONFIDENCE,
    TEXT_TO_FIELD_ACTION,
    FieldMapping,
    name_regex,
)


def field_type(name: Column, mappings: list[FieldMapping], by_confidence: bool = True) -> Column:
    """The best mapping of a field name as a struct, or null.

    Highest confidence wins and the first on ties. The mappings go into one CASE, best first, so a
    row stops at its first hit.
    """
    ranked = list(enumerate(mappings))
    if by_confidence:
        ranked.sort(key=lambda p: (-p[1].confidence, p[0]))
    out = None
    for _, m in ranked:
        hit = F.struct(
            F.lit(m.pii_type).alias("pii_type"),
            F.lit(float(m.confidence)).alias("confidence"),
            F.lit(m.action).alias("action"),
        )
        test = name.rlike(name_regex(m.pattern))
        out = F.when(test, hit) if out is None else out.when(test, hit)
    return out


def classify_fields(names: DataFrame, mappings: list[FieldMapping], name: str = "field") -> DataFrame:
    """Type, confidence and action of each field name; unmatched names get 'unknown' and 0."""
    staged = names.withColumn("__f", field_type(F.col(name), mappings))
    return staged.select(
        *names.columns,
        F.coalesce("__f.pii_type", F.lit("unknown")).alias("pii_type"),
        F.coalesce("__f.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("__f.action", F.lit("log_only")).alias("action"),
        F.col("__f").isNotNull().alias("matched"),
    )


def match_columns(columns: list[str], mappings: list[FieldMapping], min_confidence: float = MIN_CONFIDENCE) -> dict[str, FieldMapping]:
    """The same decision for column names, which are metadata known before any row is read."""
    out = {}
    for c in columns:
        best = None
        for m in mappings:
            if re.search(name_regex(m.pattern), c) and (best is None or m.confidence > best.confidence):
                best = m
        if best is not None and best.confidence >= min_confidence:
            out[c] = best
    return out


def scan_table(df: DataFrame, key: str, mappings: list[FieldMapping], min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Long form of the non-empty cells of all personal columns. Other columns are never read."""
    found = match_columns([c for c in df.columns if c != key], mappings, min_confidence)
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("field"),
                F.col(c).cast("string").alias("value"),
                F.lit(m.pii_type).alias("pii_type"),
                F.lit(float(m.confidence)).alias("confidence"),
                F.lit(m.action).alias("action"),
            )
            for c, m in found.items()
        ]
    )
    if not found:
        cells = F.array().cast("array<struct<field:string,value:string,pii_type:string,confidence:double,action:string>>")
    return inline_rows(df, [key], cells, "field").where(F.length(F.trim("value")) > 0)


def apply_action(value: Column, action: Column) -> Column:
    return (
        F.when(action == "mask", mask_value(value))
        .when(action == "redact", F.lit("[REDACTED]"))
        .otherwise(value)
    )


def masked_cells(scan: DataFrame) -> DataFrame:
    return scan.withColumn("masked_value", apply_action(F.col("value"), F.col("action")))


def mask_table(df: DataFrame, mappings: list[FieldMapping], min_confidence: float = MIN_CONFIDENCE, keep: list[str] | None = None) -> DataFrame:
    """The table with its personal columns masked, redacted or passed through. ``keep`` is untouched."""
    found = match_columns([c for c in df.columns if c not in (keep or [])], mappings, min_confidence)
    return df.select(
        *[
            apply_action(F.col(c).cast("string"), F.lit(found[c].action)).alias(c) if c in found else F.col(c)
            for c in df.columns
        ]
    )


def field_action_rank(col: Column) -> Column:
    out = F.lit(0)
    for name, rank in FIELD_ACTION_RANK.items():
        out = F.when(col == name, F.lit(rank)).otherwise(out)
    return out


def table_action(scan: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Strictest action of a scan: redact, mask, alert, log."""
    agg = scan.groupBy(*(by or [])).agg(F.max(field_action_rank(F.col("action"))).alias("__rank"))
    name = F.lit("log_only")
    for n, r in FIELD_ACTION_RANK.items():
        name = F.when(F.col("__rank") == r, F.lit(n)).otherwise(name)
    return agg.select(*(by or []), name.alias("table_action"))


def to_field_action(action: Column) -> Column:
    pairs = [x for k, v in TEXT_TO_FIELD_ACTION.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), action), F.lit("log_only"))


def field_report(scan: DataFrame, approximate: bool = False) -> DataFrame:
    """Cells and distinct values per field.

    The exact count first reduces each (field, value) pair, so one popular field is spread over its
    values and not sent to one task.
    """
    by = ["field", "pii_type", "action"]
    if approximate:
        return scan.groupBy(*by).agg(
            F.count(F.lit(1)).alias("cells"), F.approx_count_distinct("value").alias("distinct_values")
        )
    pairs = scan.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(*by).agg(F.sum("n").alias("cells"), F.count(F.lit(1)).alias("distinct_values"))


def _walked(df: DataFrame, key: str, col: str, leaves: Callable, mappings: list[FieldMapping], min_confidence: float) -> DataFrame:
    """One scan that walks each document inside the tasks; ``leaves(text)`` gives (status or None, [(path, field, value)])."""
    key_type = df.schema[key].dataType.simpleString()

    def walk(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for k, text in zip(pdf[key], pdf[col], strict=True):
                if text is None:
                    continue
                status, found = leaves(text)
                rows += [(k, path, field, value, "found") for path, field, value in found]
                if status:
                    rows.append((k, None, None, None, status))
            yield pd.DataFrame(rows, columns=[key, "path", "field", "value", "status"])

    rows = df.select(key, col).mapInPandas(walk, f"`{key}` {key_type}, path string, field string, value string, status string")
    typed = rows.withColumn("__f", field_type(F.col("field"), mappings))
    personal = (F.col("__f.confidence") >= min_confidence) & (F.length(F.trim("value")) > 0)
    return typed.where((F.col("status") != "found") | personal).select(
        key, "path", "field", "value", "__f.pii_type", "__f.confidence", "__f.action", "status"
    )


def scan_json(
    df: DataFrame,
    key: str,
    col: str,
    mappings: list[FieldMapping],
    depth: int = 10,
    arrays: bool = True,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """Personal string values directly under an object key, with their path, and a status.

    The root lies at depth 0 and containers down to ``depth`` are read. A document that is no JSON gives one row of status
    'malformed', one with deeper containers a row of status 'depth_exceeded' beside what was found above.
    """
    from tidewall.functions.markup import json_leaves

    return _walked(df, key, col, lambda text: json_leaves(text, depth, arrays), mappings, min_confidence)


def scan_xml(
    df: DataFrame,
    key: str,
    col: str,
    mappings: list[FieldMapping],
    max_depth: int = 100,
    min_confidence: float = MIN_CONFIDENCE,
    attributes: str = "all",
) -> DataFrame:
    """Personal element texts and attributes with their path, and a status.

    The element names are not known in advance, so a pull parser walks each document inside the
    tasks, one Arrow batch at a time. ``attributes="empty_elements"`` looks at attributes of
    self-closing elements only. A document that is no well-formed XML gives a row of status 'malformed', one with
    elements below ``max_depth`` a row of status 'depth_exceeded', beside what was found before.
    """
    if attributes not in ("all", "empty_elements"):
        raise ValueError("attributes must be all or empty_elements")
    from tidewall.functions.markup import xml_leaves

    return _walked(df, key, col, lambda text: xml_leaves(text, max_depth, attributes == "empty_elements"), mappings, min_confidence)
