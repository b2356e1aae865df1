"""Text rule packs.

Patterns use ASCII digit classes and no look-around, so Java regex, RE2 and Rust agree on them.
``needs`` is a literal every hit must contain; texts without it skip the regex.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.functions.patterns import regex_error

ACTION_RANK = {"alert_only": 1, "mask": 2, "block": 3}

# --- fixed values: patterns, actions, mask characters and regions of the rule packs ---
IPV4 = (
    r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}"
    r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
)


@dataclass(frozen=True)
class TextRule:
    name: str
    pattern: str
    action: str = "mask"
    mask_char: str = "*"
    regions: tuple[str, ...] = ("global",)
    needs: str | None = None


JP_RULES = (
    TextRule("my_number", r"\b\d{12}\b", "mask", "*", ("JP",)),
    TextRule("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "alert_only", "*", ("JP",), "@"),
    TextRule("ip_address_v4", IPV4, "alert_only", "X", ("JP",), "."),
    TextRule("credit_card", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "mask", "X", ("JP",)),
    TextRule(
        "phone_jp",
        r"(?:(?:\+81\s*|0)\d{1,4}[\s-]?\d{1,4}[\s-]?\d{4})|(?:0\d{9,10})",
        "alert_only", "*", ("JP",),
    ),
    TextRule("postal_code_jp", r"\b\d{3}-\d{4}\b", "alert_only", "*", ("JP",), "-"),
    TextRule("drivers_license", r"\b\d{10,12}\b", "mask", "#", ("JP",)),
)

INTL_RULES = (
    TextRule("pii_credit_card_visa_mc", r"\b4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}\b", "mask"),
    TextRule("pii_credit_card_amex", r"\b3[47][0-9]{13}\b", "mask"),
    TextRule("pii_credit_card_unionpay", r"\b62[0-9]{14,17}\b", "mask", "*", ("CN", "global")),
    TextRule("pii_iban", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{4,30}\b", "mask", "*", ("EU", "global")),
    TextRule("pii_passport_generic", r"\b[A-Z][0-9]{5,8}\b", "alert_only"),
    TextRule("pii_email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "alert_only", needs="@"),
    TextRule("pii_ipv4_address", IPV4, "alert_only", needs="."),
)

KR_RULES = (TextRule("korean_rrn", r"\d{6}[-]?\d{7}", "mask", "*", ("KR",)),)

# rule name -> PII type; names not listed keep their own name
PII_TYPE_OF = {
    "my_number": "national_id",
    "korean_rrn": "national_id",
    "pii_passport_generic": "national_id",
    "credit_card": "credit_card",
    "pii_credit_card_visa_mc": "credit_card",
    "pii_credit_card_amex": "credit_card",
    "pii_credit_card_unionpay": "credit_card",
    "email": "email",
    "pii_email": "email",
    "phone_jp": "phone",
}
# --- end of fixed values ---

RULE_SCHEMA = "name string, pattern string, action string, mask_char string, regions array<string>, ord bigint"


def rules_jp() -> list[TextRule]:
    """The seven default Japanese rules."""
    return list(JP_RULES)


def rules_intl(region: str | None = None) -> list[TextRule]:
    """The seven international rules, all or those of one region."""
    return [r for r in INTL_RULES if region is None or region in r.regions]


def rules_kr() -> list[TextRule]:
    """The resident registration number plug-in rule."""
    return list(KR_RULES)


def pattern_error(pattern: str) -> str | None:
    """Why a pattern is refused, or None. Checked before planning: a bad regex fails a Spark job."""
    return regex_error(pattern)


def valid_rules(rules: list[TextRule]) -> list[TextRule]:
    """The rules whose pattern, action and mask character are usable."""
    return [
        r for r in rules
        if pattern_error(r.pattern) is None and r.action in ACTION_RANK and len(r.mask_char) == 1
    ]


def add_rule(rules: list[TextRule], rule: TextRule) -> list[TextRule]:
    """Append a rule; an unusable one is an error."""
    if not valid_rules([rule]):
        raise ValueError(f"rule {rule.name!r}: {pattern_error(rule.pattern) or 'bad action or mask character'}")
    return [*rules, rule]


def with_action(rules: list[TextRule], action: str) -> list[TextRule]:
    return [replace(r, action=action) for r in rules]


def rules_frame(spark: SparkSession, rules: list[TextRule]) -> DataFrame:
    """The pack as a table, in rule order."""
    return spark.createDataFrame(
        [(r.name, r.pattern, r.action, r.mask_char, list(r.regions), i) for i, r in enumerate(rules)],
        RULE_SCHEMA,
    )


def rules_from_frame(df: DataFrame) -> list[TextRule]:
    """A rule table back as a pack (rule-sized tables only)."""
    from tidewall.session import collect_rules

    rows = sorted(collect_rules(df), key=lambda r: r["ord"])
    return [
        TextRule(r["name"], r["pattern"], r["action"], r["mask_char"], tuple(r["regions"] or ("global",)))
        for r in rows
    ]


def rules_for_region(df: DataFrame, region: str) -> DataFrame:
    """Rows of a rule table that apply to a region."""
    return df.where(F.array_contains("regions", region))
