"""User extensions: detectors, threat strategies, log formats, calendars, type detectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOUND = "array<struct<pii_type:string,matched_text:string,offset:int,length:int>>"


@dataclass
class Extensions:
    """Named extensions. A name may be taken once per kind."""

    detectors: dict[str, Callable] = field(default_factory=dict)
    strategies: dict[str, tuple[Callable, str]] = field(default_factory=dict)
    formatters: dict[str, Callable] = field(default_factory=dict)
    calendars: dict[str, DataFrame] = field(default_factory=dict)
    type_detectors: dict[str, object] = field(default_factory=dict)

    @staticmethod
    def _add(table: dict, name: str, value) -> None:
        if name in table:
            raise ValueError(f"{name} is already registered")
        table[name] = value

    def register_detector(self, name: str, fn: Callable[[pd.Series], pd.Series]) -> None:
        """``fn`` maps a batch of texts to lists of (pii_type, matched_text, offset, length)."""
        self._add(self.detectors, name, F.pandas_udf(fn, FOUND))

    def detect(self, df: DataFrame, key: str, text: str, name: str) -> DataFrame:
        return df.select(key, F.inline(self.detectors[name](F.col(text)))).withColumn("detector", F.lit(name))

    def register_strategy(self, name: str, fn: Callable, schema: str) -> None:
        """``fn`` maps an iterator of pandas frames of findings to frames of ``schema``."""
        self._add(self.strategies, name, (fn, schema))

    def apply_strategy(self, findings: DataFrame, name: str) -> DataFrame:
        fn, schema = self.strategies[name]
        return findings.mapInPandas(fn, schema)

    def register_formatter(self, name: str, fn: Callable[[DataFrame], Column]) -> None:
        """``fn`` maps an audit frame to the column of its log lines."""
        self._add(self.formatters, name, fn)

    def format(self, df: DataFrame, name: str, out: str = "line") -> DataFrame:
        return df.select(self.formatters[name](df).alias(out))

    def register_calendar(self, name: str, holidays: DataFrame) -> None:
        """A holiday table with the columns holiday and holiday_name."""
        if not {"holiday", "holiday_name"} <= set(holidays.columns):
            raise ValueError("a calendar needs the columns holiday and holiday_name")
        self._add(self.calendars, name, holidays)

    def register_type_detector(self, name: str, rows_or_fn) -> None:
        """Registry rows (extension, signature in hex, handler), or a function of a batch of contents."""
        value = F.pandas_udf(rows_or_fn, "string") if callable(rows_or_fn) else list(rows_or_fn)
        self._add(self.type_detectors, name, value)

    def detect_type(self, df: DataFrame, content: str, filename: str, name: str) -> DataFrame:
        from tidewall.operators.files import detect_type

        found = self.type_detectors[name]
        if isinstance(found, list):
            return detect_type(df, content, filename, extra=found)
        return df.withColumn("detected_ext", F.coalesce(found(F.col(content)), F.lit("unknown")))
