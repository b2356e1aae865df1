"""Functions callable from SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewall.functions.patterns import ascii_classes
from tidewall.operators.calendar import ERAS
from tidewall.rules.pii import TextRule, rules_jp


def _matches_udtf(rules: list[TextRule]):
    """A table function over one text. Compiled here once per Python worker, not per row."""
    specs = [(r.name, ascii_classes(r.pattern), r.mask_char) for r in rules]

    class PiiMatches:
        def __init__(self):
            import re

            self.rules = [(name, re.compile(p), mask) for name, p, mask in specs]

        def eval(self, text: str):
            if text is None:
                return
            for name, rx, mask in self.rules:
                for m in rx.finditer(text):
                    hit = m.group()
                    hidden = mask * len(hit) if len(hit) <= 2 else hit[0] + mask * (len(hit) - 2) + hit[-1]
                    yield name, hit, hidden, m.start(), len(hit)

    schema = StructType.fromDDL("rule string, matched_text string, masked_text string, offset int, length int")
    return F.udtf(PiiMatches, returnType=schema)


def register_sql(spark: SparkSession, rules: list[TextRule] | None = None) -> None:
    """Register mask_value, ip_to_long, in_cidr, era_year and the table function pii_matches.

    The scalar ones are SQL functions, which Spark inlines into the calling plan.
    """
    spark.sql(
        """
        create or replace temporary function mask_value(value string, mask_char string) returns string
        return case when length(value) <= 2 then repeat(mask_char, length(value))
                    else concat(left(value, 1), repeat(mask_char, length(value) - 2), right(value, 1)) end
        """
    )
    spark.sql(
        r"""
        create or replace temporary function ip_to_long(ip string) returns bigint
        return case when ip rlike '^([0-9]{1,3}\\.){3}[0-9]{1,3}$'
                     and forall(split(ip, '\\.'), o -> cast(o as int) <= 255)
                    then aggregate(split(ip, '\\.'), 0L, (a, o) -> a * 256 + cast(o as bigint)) end
        """
    )
    spark.sql(
        """
        create or replace temporary function in_cidr(ip string, cidr string) returns boolean
        return coalesce(
          shiftright(ip_to_long(ip), 32 - cast(substring_index(cidr, '/', -1) as int))
          = shiftright(ip_to_long(substring_index(cidr, '/', 1)), 32 - cast(substring_index(cidr, '/', -1) as int)), false)
        """
    )
    cases = " ".join(
        f"when day between date'{a}' and date'{b or '9999-12-31'}' then year(day) - {y - 1}" for _, _, _, a, b, y in ERAS
    )
    spark.sql(f"create or replace temporary function era_year(day date) returns int return case {cases} end")
    spark.udtf.register("pii_matches", _matches_udtf(rules if rules is not None else rules_jp()))
