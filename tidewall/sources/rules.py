"""Rule sets from YAML or JSON files. A file that does not fit is an error, never a partial load."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from tidewall.rules.context import GLOBAL, Keyword
from tidewall.rules.fields import FIELD_ACTION_RANK, FieldMapping
from tidewall.rules.secrecy import Level, Scheme, SecrecyRule, secrecy_scheme

KINDS = ("keywords", "fields", "secrecy", "policy")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text, from any file system Spark can read."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path}: expected one file")
    return rows[0][0]


def parse(text: str) -> dict:
    """YAML, or JSON where no YAML reader is installed."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(f"not YAML: {e}") from e


def load_rules(spark: SparkSession, path: str, kind: str):
    """Keywords, field mappings, a secrecy scheme or policy rules from one file."""
    makers = {"keywords": _keywords, "fields": _fields, "secrecy": _secrecy, "policy": _policy}
    if kind not in makers:
        raise ValueError(f"kind must be one of {KINDS}")
    doc = parse(read_text(spark, path))
    if not isinstance(doc, dict):
        raise ValueError(f"{path}: expected a mapping at the top")
    try:
        return makers[kind](doc)
    except (KeyError, TypeError, AttributeError) as e:
        raise ValueError(f"{path}: bad {kind} file: {e!r}") from e


def _keywords(doc: dict) -> list[Keyword]:
    def word(pii_type: str, polarity: str, k: dict) -> Keyword:
        position = k.get("position", "either")
        if position not in ("before", "after", "either", "before_or_after"):
            raise ValueError(f"position {position}")
        return Keyword(pii_type, polarity, k["keyword"], float(k["weight"]), position)

    out = [
        word(t, polarity, k)
        for t, sides in doc.get("pii_types", {}).items()
        for polarity in ("positive", "anti")
        for k in sides.get(polarity) or []
    ]
    return out + [word(GLOBAL, "anti", k) for k in doc.get("global_anti_keywords") or []]


def _fields(doc: dict) -> list[FieldMapping]:
    out = []
    for m in doc["field_mappings"]:
        action = m.get("action", "log_only")
        if action not in FIELD_ACTION_RANK:
            raise ValueError(f"action {action}")
        out.append(FieldMapping(m["field_pattern"], m["pii_type"], float(m["confidence"]), action))
    return out


def _secrecy(doc: dict) -> Scheme:
    levels = [
        Level(
            i, lv.get("display_name", i), int(lv["rank"]), lv.get("color", "#6B7280"), int(lv.get("retention_years", 1)),
            tuple((c["id"], c["name"], bool(c.get("required", False)), c.get("spec", "")) for c in lv.get("required_controls") or []),
        )
        for i, lv in doc["levels"].items()
    ]
    rules = []
    for r in doc["classification_rules"]:
        c = r["condition"]
        empty = set(c) == {"pii_types_present"} and not c["pii_types_present"]
        rules.append(
            SecrecyRule(
                r["id"], r["result"]["level"], r["result"].get("reason", ""),
                present=tuple(c.get("pii_types_present") or ()),
                min_count=int(c.get("min_count", 0)),
                all_of=tuple(c.get("require_all_of") or ()),
                any_of=tuple(c.get("require_any_of") or ()),
                exclude_all=tuple(c.get("exclude_all_of") or ()),
                exclude_any=tuple(c.get("exclude_any_of") or ()),
                only_empty=empty,
            )
        )
    fb = doc.get("fallback", {})
    return secrecy_scheme(levels, rules, fb.get("unknown_default", "medium"), fb.get("conflict_resolution", "highest"))


def _policy(doc: dict) -> list:
    from tidewall.operators.policy import Condition, Obligation, PolicyRule, rule_problems

    rules = []
    for r in doc["rules"]:
        duty = r.get("obligation")
        rules.append(
            PolicyRule(
                r["id"],
                r["effect"],
                tuple(Condition(c["attr"], c["op"], c["value"]) for c in r.get("conditions") or []),
                int(r.get("priority", 0)),
                bool(r.get("enabled", True)),
                Obligation(duty["kind"], int(duty.get("approvers", 0)), tuple(duty.get("notify") or ())) if duty else None,
            )
        )
    problems = rule_problems(rules)
    if problems:
        raise ValueError("; ".join(problems))
    return rules
