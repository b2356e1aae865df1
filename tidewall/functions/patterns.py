"""Regex patterns across engines, and a fast test for texts that cannot match."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_BUDGET = 512 * 1024 * 1024
_LARGEST_TEXT = 16 * 1024 * 1024
ALL = -1


def ascii_classes(pattern: str) -> str:
    """The pattern with \\d and \\s written out as the ASCII characters Java means by them."""
    short = {"d": "0-9", "s": r" \t\n\x0b\f\r"}
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and pattern[i + 1] in short:
            chars = short[pattern[i + 1]]
            out.append(chars if in_class else f"[{chars}]")
            i += 2
            continue
        if ch == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        in_class = ch == "[" or (in_class and ch != "]")
        out.append(ch)
        i += 1
    return "".join(out)


_CLASS_CHARS = {"d": "0-9", "s": r" \t\n\x0b\f\r", "w": "A-Za-z0-9_"}
_COUNT = re.compile(r"\{\d{1,3}(?:,(?:\d{1,3})?)?\}")


def _class_end(body: str, start: int) -> int | None:
    """End of a plain character class that starts at ``start``; None for unions, intersections and odd brackets."""
    i = start + 1
    if body[i : i + 1] == "^":
        i += 1
    if body[i : i + 1] in ("]", ""):
        return None
    while i < len(body):
        if body[i] == "\\":
            if i + 1 >= len(body) or (body[i + 1].isalnum() and body[i + 1] not in _CLASS_CHARS):
                return None
            i += 2
        elif body[i] == "]":
            return i + 1
        elif body[i] == "[" or body[i : i + 2] == "&&":
            return None
        else:
            i += 1
    return None


def _loose_pattern(pattern: str) -> str | None:
    """The pattern for RE2, token by token; None at the first thing the engines might read differently."""
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    body = pattern[len(flags) :]
    out, i, repeatable = [flags], 0, False
    while i < len(body):
        ch, nxt = body[i], body[i + 1 : i + 2]
        if ch == "\\":
            if nxt == "b":  # a word edge: left out, unless something repeats it
                if body[i + 2 : i + 3] in ("*", "+", "?", "{"):
                    return None
                i += 2
                continue
            if nxt in _CLASS_CHARS:
                out.append(f"[{_CLASS_CHARS[nxt]}]")
            elif not nxt or nxt.isalnum() or ord(nxt) > 126:
                return None
            else:
                out.append(ch + nxt)
            i, repeatable = i + 2, True
        elif ch == "[":
            end = _class_end(body, i)
            if end is None or (flags and nxt == "^"):  # the engines fold case differently
                return None
            out.append(ascii_classes(body[i:end]).replace(r"\w", _CLASS_CHARS["w"]))
            i, repeatable = end, True
        elif ch == "(":
            if nxt == "?" and body[i : i + 3] != "(?:":
                return None
            step = 3 if nxt == "?" else 1
            out.append(body[i : i + step])
            i, repeatable = i + step, False
        elif ch in "*+?{":
            count = _COUNT.match(body, i) if ch == "{" else None
            if not repeatable or (ch == "{" and count is None):
                return None
            end = count.end() if count else i + 1
            if body[end : end + 1] == "+":  # possessive
                return None
            end += body[end : end + 1] == "?"
            out.append(body[i:end])
            i, repeatable = end, False
        elif ch in "$^]}":
            return None
        else:
            out.append(ch)
            i, repeatable = i + 1, ch != "|"
        if ch == "|":
            repeatable = False
    return "".join(out)


def gate_pattern(pattern: str) -> str | None:
    """An RE2 pattern that matches wherever the Java pattern does, or None when there is no sure one.

    Word edges differ between the engines, so they are dropped, which only lets more texts through.
    Anything else the engines might read differently (anchors, class unions and intersections, letter escapes,
    look-around, possessive and repeated repeats) gives None.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    loose = _loose_pattern(pattern)
    if loose is None:
        return None
    try:
        pc.match_substring_regex(pa.array([""]), loose)
    except pa.ArrowInvalid:
        return None
    return loose


def arrow_text_limit(spark: SparkSession) -> int:
    """Largest text in bytes worth sending to Python, so that a batch fits a worker."""
    try:
        by_size = spark.conf.get(_ARROW_BYTES).rstrip("b")
    except Exception:  # releases without the setting
        by_size = ""
    if by_size.isdigit() and int(by_size) <= _BATCH_BUDGET:
        return _LARGEST_TEXT
    rows = int(spark.conf.get(_ARROW_ROWS, "10000"))
    return min(_LARGEST_TEXT, _BATCH_BUDGET // rows) if rows > 0 else 0


def may_match(text: Column, patterns: list[str], spark: SparkSession) -> Column:
    """A bit per pattern: whether the text might match it. Unset bits are certain.

    RE2 reads an Arrow batch several times faster than the JVM regex reads the same rows, and most
    texts match nothing; what remains goes to the exact JVM pattern. Texts too long for a batch and
    patterns without a sure RE2 form keep their bit set.
    """
    gates = [gate_pattern(p) for p in patterns]
    open_bits = sum(1 << i for i, g in enumerate(gates) if g is None)
    if len(patterns) > 62 or all(g is None for g in gates):
        return F.lit(ALL).cast("bigint")

    def bits(batch):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        found = np.full(len(batch), open_bits, dtype="int64")
        for i, g in enumerate(gates):
            if g is not None:
                hit = pc.fill_null(pc.match_substring_regex(batch, g), False)
                found |= hit.to_numpy(zero_copy_only=False).astype("int64") << i
        return pa.array(found)

    short = F.octet_length(text) <= arrow_text_limit(spark)
    return F.when(short, F.arrow_udf(bits, T.LongType())(F.when(short, text))).otherwise(F.lit(ALL).cast("bigint"))


def bit_is_set(bits: Column, i: int) -> Column:
    return bits.bitwiseAND(F.lit(1 << i).cast("bigint")) != 0


EMPTY_MATCH = "pattern matches the empty string"


def regex_error(pattern: str) -> str | None:
    """Why a pattern is refused, or None: no regex, or one that matches the empty string.

    With a running session the engine that will run it is asked, Java's; it takes ``(?<name>...)`` and class
    intersections and refuses ``(?P<name>...)``. Without one Python's must do.
    """
    from pyspark import SparkContext
    from pyspark.errors import IllegalArgumentException

    context = SparkContext._active_spark_context
    try:
        if context is None:
            empty = re.compile(pattern).match("") is not None
        else:
            empty = context._jvm.java.util.regex.Pattern.compile(pattern).matcher("").lookingAt()
    except (re.error, IllegalArgumentException) as e:
        return str(e).splitlines()[0]
    return EMPTY_MATCH if empty else None
