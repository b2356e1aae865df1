"""Keyword rules for context scoring: (pii_type, polarity, keyword, weight, position)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: thresholds and keyword lists ---
CONTEXT_WINDOW = 100
POSITIVE_THRESHOLD = 0.7
CONFIDENCE_BOOST = 0.15
CONFIDENCE_PENALTY = 0.20

GLOBAL_ANTI = (
    ("invoice", 0.70, "either"),
    ("no.", 0.65, "before"),
    ("case", 0.60, "either"),
    ("serial", 0.70, "after"),
    ("id:", 0.50, "before"),
    ("code", 0.55, "after"),
    ("ref", 0.55, "before"),
    ("sample", 0.50, "before"),
    ("example", 0.60, "either"),
    ("test", 0.45, "either"),
)

TYPE_KEYWORDS = {
    "national_id": {
        "positive": (
            ("national id", 0.90, "before"), ("ssn", 0.90, "before"), ("social security", 0.88, "before"),
            ("passport", 0.92, "before"), ("身份证", 0.93, "before"), ("身份證", 0.93, "before"),
            ("身份证号", 0.95, "before"),
        ),
        "anti": (("reference", 0.60, "either"), ("sample", 0.55, "before")),
    },
    "credit_card": {
        "positive": (
            ("credit card", 0.95, "before"), ("card number", 0.92, "before_or_after"), ("cvv", 0.90, "after"),
            ("expiry", 0.85, "after"), ("カード番号", 0.95, "before"), ("卡号", 0.95, "before"),
        ),
        "anti": (("member", 0.55, "either"), ("token", 0.60, "after")),
    },
    "email": {
        "positive": (
            ("email", 0.98, "before"), ("e-mail", 0.90, "before"), ("メール", 0.80, "before"),
            ("邮箱", 0.95, "before"), ("邮件", 0.92, "before"),
        ),
        "anti": (),
    },
    "phone": {
        "positive": (
            ("phone", 0.85, "before"), ("tel", 0.90, "before"), ("fax", 0.88, "before"), ("電話", 0.87, "before"),
            ("携帯", 0.85, "before"), ("手机", 0.90, "before"), ("电话", 0.90, "before"),
        ),
        "anti": (("postal", 0.65, "before"),),
    },
    "full_name": {
        "positive": (
            ("name", 0.65, "before"), ("氏名", 0.99, "before"), ("姓名", 0.99, "before"), ("名前", 0.97, "before"),
        ),
        "anti": (),
    },
    "address": {
        "positive": (
            ("address", 0.88, "before"), ("住所", 0.92, "before"), ("addr", 0.75, "before"), ("地址", 0.92, "before"),
        ),
        "anti": (),
    },
}
# --- end of fixed values ---

KEYWORD_SCHEMA = "source_ord bigint, ord bigint, pii_type string, polarity string, keyword string, weight double, position string"
GLOBAL = "*"


@dataclass(frozen=True)
class Keyword:
    pii_type: str
    polarity: str
    keyword: str
    weight: float
    position: str = "either"


def default_keywords() -> list[Keyword]:
    """The universal keyword set: per-type rules, then the global anti words."""
    out = [
        Keyword(t, polarity, kw, w, pos)
        for t, sides in TYPE_KEYWORDS.items()
        for polarity in ("positive", "anti")
        for kw, w, pos in sides[polarity]
    ]
    return out + [Keyword(GLOBAL, "anti", kw, w, pos) for kw, w, pos in GLOBAL_ANTI]


def keywords_frame(spark: SparkSession, keywords: list[Keyword], source_ord: int = 0) -> DataFrame:
    return spark.createDataFrame(
        [
            (source_ord, i, k.pii_type, k.polarity, k.keyword, float(k.weight), k.position)
            for i, k in enumerate(keywords)
        ],
        KEYWORD_SCHEMA,
    )


def keywords_from_frame(df: DataFrame) -> list[Keyword]:
    from tidewall.session import collect_rules

    rows = sorted(collect_rules(df), key=lambda r: (r["source_ord"], r["ord"]))
    return [Keyword(r["pii_type"], r["polarity"], r["keyword"], r["weight"], r["position"]) for r in rows]
