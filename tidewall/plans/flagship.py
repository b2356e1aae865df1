"""Which documents hold confirmed personal data, how secret are they, and how do they read redacted?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewall.operators.pii import (
    doc_action,
    keep_confirmed,
    pii_types,
    redact_text,
    with_context,
    with_matches,
)
from tidewall.operators.secrecy import classify_secrecy
from tidewall.rules.context import default_keywords
from tidewall.rules.pii import rules_intl, rules_jp
from tidewall.rules.secrecy import secrecy_scheme
from tidewall.session import spread


def protect_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Scan, keep what the context does not speak against, classify and redact.

    One pass over the documents: every step is a projection on the same row, nothing is shuffled
    and the text is read once. A threshold of 0.5 keeps a match unless anti words outweigh the
    positive ones; 0.7 is the stricter setting of the context score.
    """
    words = default_keywords()
    scanned = with_matches(spread(docs.select(key, text)), text, rules_jp() + rules_intl())
    kept = keep_confirmed(with_context(scanned, text), "matches", words, threshold)
    typed = kept.withColumn("pii_types", pii_types(F.col("matches")))
    redacted = redact_text(classify_secrecy(typed, "pii_types", secrecy_scheme()), text)
    return redacted.select(
        key,
        F.size("matches").cast("bigint").alias("confirmed"),
        F.array_join("pii_types", ",").alias("pii_types"),
        doc_action(F.col("matches")).alias("doc_action"),
        "level_id",
        "level_rank",
        "redacted_text",
    )
