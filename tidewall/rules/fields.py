"""Field-name mappings for structured data."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

FIELD_ACTION_RANK = {"log_only": 1, "alert_only": 2, "mask": 3, "redact": 4}
TEXT_TO_FIELD_ACTION = {"block": "redact", "mask": "mask", "alert_only": "alert_only"}
MIN_CONFIDENCE = 0.3


@dataclass(frozen=True)
class FieldMapping:
    pattern: str
    pii_type: str
    confidence: float
    action: str = "log_only"


# --- fixed values: default field mappings ---
MAPPINGS = (
    FieldMapping("full_name", "full_name", 0.99, "mask"),
    FieldMapping("first_name", "given_name", 0.97, "mask"),
    FieldMapping("last_name", "family_name", 0.97, "mask"),
    FieldMapping("(?i)^name$", "full_name", 0.60, "alert_only"),
    FieldMapping("national_id", "national_id", 0.95, "mask"),
    FieldMapping("ssn", "national_id", 0.95, "mask"),
    FieldMapping("passport_no", "passport", 0.95, "mask"),
    FieldMapping("email", "email", 0.98, "mask"),
    FieldMapping("phone", "phone", 0.92, "mask"),
    FieldMapping("tel", "phone", 0.90, "mask"),
    FieldMapping("fax", "fax", 0.88, "alert_only"),
    FieldMapping("mobile", "phone_mobile", 0.92, "mask"),
    FieldMapping("address", "address", 0.90, "mask"),
    FieldMapping("postcode", "postal_code", 0.92, "alert_only"),
    FieldMapping("zip", "postal_code", 0.88, "alert_only"),
    FieldMapping("card_number", "credit_card", 0.98, "mask"),
    FieldMapping("ccv", "credit_card_cvv", 0.95, "redact"),
    FieldMapping("expiry_date", "credit_card_expiry", 0.92, "mask"),
    FieldMapping("*_id", "generic_id", 0.45, "alert_only"),
    FieldMapping("*_no", "generic_number", 0.40, "log_only"),
    FieldMapping("*_key", "generic_key", 0.35, "log_only"),
)
# --- end of fixed values ---


def default_mappings() -> list[FieldMapping]:
    return list(MAPPINGS)


def name_regex(pattern: str) -> str:
    """A mapping pattern as a regex for ``rlike``: wildcards, (?i) expressions, or a literal name."""
    if pattern.startswith("(?i"):
        return pattern
    if "*" in pattern:
        head, tail = pattern.startswith("*"), pattern.endswith("*")
        body = re.escape(pattern.strip("*"))
        if not (head or tail):
            return "(?!)"
        return ("" if head else "^") + body + ("" if tail else "$")
    return "(?i)^" + re.escape(pattern) + "$"


def add_mapping(mappings: list[FieldMapping], mapping: FieldMapping) -> list[FieldMapping]:
    return [*mappings, mapping]


def remove_mapping(mappings: list[FieldMapping], pattern: str) -> list[FieldMapping]:
    return [m for m in mappings if m.pattern != pattern]


def mappings_frame(spark: SparkSession, mappings: list[FieldMapping]) -> DataFrame:
    return spark.createDataFrame(
        [(i, m.pattern, name_regex(m.pattern), m.pii_type, float(m.confidence), m.action) for i, m in enumerate(mappings)],
        "ord bigint, pattern string, regex string, pii_type string, confidence double, action string",
    )
