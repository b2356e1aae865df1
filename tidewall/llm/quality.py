"""Line-first cleaning with DataFrame functions only.

Every line is judged on its own, failed lines go, and a document is rejected when it breaks a rule on
the whole text or loses too much of it with its lines. One projection chain: no join, no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewall.functions.rows import computed_once

# --- fixed values: word separators, symbols, and phrases of boilerplate lines ---
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
NOT_SYMBOLS = r"[^#*$%&|<>]+"
SENTENCE_MARKS = r"[^.,;:!?…。、！？]+"
HEAVY_MARKS = r"[^|#*<>{}=~^\\_!?»«•→]+"
BOILERPLATE = (
    "all rights reserved", "licensed under", "privacy policy", "terms of use", "cookies", "javascript", "lorem ipsum",
)
# --- end of fixed values ---


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the verdict.

    ``chars_per_mark``: a line of more characters than this needs a sentence mark for every so many.
    ``heavy_per_word``: marks of menus, tables and shouting that a line may hold per word.
    ``short_words``: a line of fewer words that ends in no sentence mark is navigation.
    ``max_loss``: share of the word characters that a document may lose with its lines.
    """

    chars_per_mark: int = 700
    heavy_per_word: float = 0.4
    short_words: int = 3
    max_loss: float = 0.5
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _count_of(text: Column, others: str) -> Column:
    return F.char_length(F.regexp_replace(text, others, ""))


def _has_phrase(text: Column) -> Column:
    return F.lower(text).rlike("|".join(BOILERPLATE))


def line_verdict(line: Column, rules: LineRules = LineRules(), phrases: Column | None = None, heavy: Column | None = None) -> Column:
    """Why a line fails: 'boilerplate', 'navigation' or 'punctuation'; null for a line that stays.

    Lines without a word stay: they carry nothing to lose. ``phrases`` and ``heavy`` may say that the whole
    text holds no boilerplate phrase or heavy mark, which spares its lines that test.
    """
    phrases = F.lit(True) if phrases is None else phrases
    heavy = F.lit(True) if heavy is None else heavy
    words = F.size(_words(line))
    gap, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    few = line.rlike(rf"^{gap}*+{word}++(?:{gap}++{word}++){{0,{max(rules.short_words - 2, 0)}}}+{gap}*+$")
    ends = line.rlike(r"[.,;:!?…。！？][\"'»”’)\]]*+[\x20\x09-\x0D]*+$")
    size, most = F.char_length(line), rules.chars_per_mark
    return (
        F.when(~line.rlike(NOT_SPACE), F.lit(None))
        .when(phrases & _has_phrase(line), F.lit("boilerplate"))
        .when(heavy & (_count_of(line, HEAVY_MARKS) > rules.heavy_per_word * words), F.lit("navigation"))
        .when(few & ~ends, F.lit("navigation"))
        .when((size > most) & (_count_of(line, SENTENCE_MARKS) * most < size), F.lit("punctuation"))
    )


def _repeat_words(df: DataFrame, size: int) -> DataFrame:
    """Adds ``_repeat``: words inside windows of ``size`` words that the text holds twice or more.

    Windows are compared by 64-bit hashes of the hashes of their words. Only texts with a repeated
    window sort anything; the words covered are the union of the windows' positions.
    """
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    df = df.withColumn("_wh", computed_once(hashes))
    n = F.size("_wh")
    df = df.withColumn("_h", F.col("_wh"))
    reach = 1  # words that a hash covers; two hashes, overlapping at the last step, make a wider one
    while reach < size:
        step = min(reach, size - reach)
        df = df.withColumn("_h", computed_once(F.zip_with("_h", F.slice("_h", step + 1, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))))
        reach += step
    df = df.withColumn("_h", computed_once(F.slice("_h", 1, F.greatest(n - (size - 1), F.lit(0)))))
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    at = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_at", computed_once(F.when(twice, at)))
    last = F.size("_at") - 1
    h_at = lambda j: F.get("_at", j)["h"]
    same = lambda j: ((j > 0) & (h_at(j) == h_at(j - 1))) | ((j < last) & (h_at(j) == h_at(j + 1)))
    starts = F.filter(
        F.transform(F.sequence(F.lit(0), last), lambda j: F.when(same(j), F.get("_at", j)["i"])),
        lambda p: p.isNotNull(),
    )
    df = df.withColumn("_starts", computed_once(F.when(F.col("_at").isNotNull(), F.sort_array(starts))))
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(-size).alias("p"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("p"), (a["n"] + F.least(p - a["p"], F.lit(size))).alias("n")),
        lambda a: a["n"],
    )
    return df.withColumn("_repeat", F.coalesce(covered, F.lit(0)).cast("long")).drop("_wh", "_h", "_at", "_starts")


def clean_lines(df: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """All rows and columns of ``df`` plus the counts, the cleaned text and the verdict.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_boilerplate, n_navigation,
    n_punctuation (lines failed by each rule), clean_text, base_failed, kept. A column of ``df`` with one of these
    names, or starting with ``_lf_``, is replaced. A null text counts as a text of no words and
    its clean_text is null. Repeated rows are judged each by itself; an empty table gives no row.
    """
    keep = [c for c in df.columns if c not in ADDED]
    row = df.select(F.struct(*keep).alias("_row"), F.col(text).alias("_text"))
    row = row.withColumn("_words", computed_once(F.coalesce(_words(F.col("_text")), F.array().cast("array<string>"))))
    row = _repeat_words(row, rules.window)
    row = row.select(
        "_row", "_text", "_repeat",
        F.size("_words").cast("long").alias("_n"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("_chars"),
        F.coalesce(_count_of(F.col("_text"), NOT_SYMBOLS), F.lit(0)).cast("long").alias("_symbols"),
        computed_once(F.split("_text", "\n")).alias("_lines"),
    )
    any_phrase = F.lit(False)
    for phrase in BOILERPLATE:
        any_phrase = any_phrase | F.col("_lower").contains(phrase)
    row = row.withColumn("_lower", computed_once(F.lower("_text"))).withColumn("_phrase", computed_once(any_phrase)).drop("_lower")
    row = row.withColumn("_heavy", computed_once(F.col("_text").rlike(HEAVY_MARKS.replace("[^", "[").rstrip("+"))))
    verdict = lambda x: F.coalesce(line_verdict(x, rules, F.col("_phrase"), F.col("_heavy")), F.lit(""))
    row = row.withColumn("_why", computed_once(F.transform("_lines", verdict)))
    full = F.filter("_lines", lambda x: x.rlike(NOT_SPACE))
    row = row.withColumn("_full", computed_once(full))
    row = row.withColumn("_any", computed_once(F.exists("_why", lambda x: x != "")))
    stays = F.array_join(F.filter("_lines", lambda x, i: F.get("_why", i) == ""), "\n")
    row = row.withColumn("_clean", computed_once(F.when(F.col("_any"), stays).otherwise(F.col("_text"))))
    left = F.when(F.col("_any"), F.char_length(F.regexp_replace("_clean", SPACES, ""))).otherwise(F.col("_chars"))
    base = (F.col("_n") < rules.min_words) | (100 * F.col("_repeat") > rules.max_repeat_percent * F.col("_n"))
    lost = F.coalesce(F.col("_chars") - left > rules.max_loss * F.col("_chars"), F.lit(False))
    count = lambda why: F.coalesce(F.size(F.filter("_why", lambda x: x == why)), F.lit(0)).cast("long")
    return row.select(
        "_row.*",
        F.col("_n").alias("n_words"),
        F.col("_chars").alias("word_chars"),
        F.col("_symbols").alias("n_symbols"),
        F.when(F.col("_text").isNull(), F.lit(0)).otherwise(F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        F.col("_repeat").alias("n_repeat_words"),
        F.when(F.col("_text").isNull(), F.lit(0)).otherwise(F.size("_full")).cast("long").alias("n_lines"),
        *(F.when(F.col("_text").isNull(), F.lit(0)).otherwise(count(w)).cast("long").alias(f"n_{w}") for w in ("boilerplate", "navigation", "punctuation")),
        F.col("_clean").alias("clean_text"),
        base.alias("base_failed"),
        (~base & ~lost).alias("kept"),
    )


ADDED = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_boilerplate",
    "n_navigation", "n_punctuation", "clean_text", "base_failed", "kept",
)
