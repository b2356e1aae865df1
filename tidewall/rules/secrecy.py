"""Secrecy levels, controls and classification rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Level:
    id: str
    display_name: str
    rank: int
    color: str
    retention_years: int
    controls: tuple[tuple[str, str, bool, str], ...] = ()


@dataclass(frozen=True)
class SecrecyRule:
    """All given parts must hold. ``only_empty`` matches documents without any type."""

    id: str
    level: str
    reason: str
    present: tuple[str, ...] = ()
    min_count: int = 0
    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    exclude_all: tuple[str, ...] = ()
    exclude_any: tuple[str, ...] = ()
    only_empty: bool = False


@dataclass(frozen=True)
class Scheme:
    levels: tuple[Level, ...]
    rules: tuple[SecrecyRule, ...]
    fallback: str = "medium"
    conflict: str = "highest"
    unknown_color: str = field(default="#6B7280")


# --- fixed values: the generic four-tier scheme ---
LEVELS = (
    Level("critical", "Critical", 4, "#DC2626", 7, (
        ("enc_at_rest", "Encryption at Rest", True, "AES-256+"),
        ("enc_transit", "Encryption in Transit", True, "TLS 1.2+"),
        ("mfa", "Multi-Factor Authentication", True, ""),
        ("audit_full", "Full Audit Logging", True, ""),
    )),
    Level("high", "High", 3, "#EA580C", 5, (
        ("enc_at_rest", "Encryption at Rest", True, "AES-256+"),
        ("audit_access", "Access Audit Log", True, ""),
    )),
    Level("medium", "Medium", 2, "#D97706", 3, (
        ("access_control", "Access Control", True, ""),
        ("handling_label", "Handling Label", False, ""),
    )),
    Level("low", "Low", 1, "#65A30D", 1, (("basic_auth", "Basic Authentication", True, ""),)),
    Level("public", "Public", 0, "#3B82F6", 1),
)

RULES = (
    SecrecyRule("rule_national_id_critical", "critical", "Contains national identity identifier",
                present=("national_id",), min_count=1),
    SecrecyRule("rule_credit_card_critical", "critical", "Contains payment card information",
                present=("credit_card",), min_count=1),
    SecrecyRule("rule_full_identity_critical", "critical", "Contains complete identity set",
                all_of=("full_name", "address", "phone")),
    SecrecyRule("rule_identity_high", "high", "Contains identifiable personal information",
                any_of=("full_name", "address", "phone"), exclude_all=("national_id", "credit_card")),
    SecrecyRule("rule_contact_medium", "medium", "Contains contact information only",
                any_of=("email", "phone"), exclude_all=("full_name", "address", "national_id")),
    SecrecyRule("rule_internal_low", "low", "Contains internal identifiers only",
                any_of=("employee_id", "department"),
                exclude_all=("national_id", "full_name", "phone", "email")),
    SecrecyRule("rule_public", "public", "No personal information detected", only_empty=True),
)
# --- end of fixed values ---

CONFLICT_MODES = ("highest", "lowest", "first")


def secrecy_scheme(levels=LEVELS, rules=RULES, fallback="medium", conflict="highest") -> Scheme:
    """Build and check a scheme: known levels only, known conflict mode, unique rule ids."""
    ids = {lv.id for lv in levels}
    unknown = {r.level for r in rules} - ids
    if unknown:
        raise ValueError(f"rules name unknown levels: {sorted(unknown)}")
    if conflict not in CONFLICT_MODES:
        raise ValueError(f"conflict resolution must be one of {CONFLICT_MODES}")
    if len({r.id for r in rules}) != len(rules):
        raise ValueError("rule ids must be unique")
    return Scheme(tuple(levels), tuple(rules), fallback, conflict)


def levels_frame(spark: SparkSession, scheme: Scheme) -> DataFrame:
    return spark.createDataFrame(
        [(lv.id, lv.display_name, lv.rank, lv.color, lv.retention_years) for lv in scheme.levels],
        "level_id string, display_name string, level_rank bigint, color string, retention_years bigint",
    )


def controls_frame(spark: SparkSession, scheme: Scheme) -> DataFrame:
    return spark.createDataFrame(
        [(lv.id, *c) for lv in scheme.levels for c in lv.controls],
        "level_id string, control_id string, control_name string, mandatory boolean, spec string",
    )
