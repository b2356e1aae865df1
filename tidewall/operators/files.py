"""File types, encodings, entropy, archives and compliance limits."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewall.rules import files as R

HEADER_BYTES = 262


def extension(name: Column) -> Column:
    """Lower-case extension after the last dot, or null when there is none."""
    return F.nullif(F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)), F.lit(""))


def mime_of_extension(ext: Column) -> Column:
    pairs = [x for k, v in R.MIME_TYPES.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(ext)), F.concat(F.lit("application/x-"), ext))


def mime_of(name: Column) -> Column:
    """MIME type of a filename; null without an extension."""
    return mime_of_extension(extension(name))


def registry_frame(spark: SparkSession, extra: list[tuple[str, str, str]] | None = None) -> DataFrame:
    rows = [*R.SIGNATURES, *(extra or [])]
    return spark.createDataFrame(
        [(i, e, h, s) for i, (e, h, s) in enumerate(rows)], "ord bigint, extension string, magic_hex string, handler string"
    )


def detect_type(
    df: DataFrame, content: str, name: str, extra: list[tuple[str, str, str]] | None = None, prefer_extension: bool = False
) -> DataFrame:
    """Type by signature (confidence 1), else by a known extension (0.3), else unknown (0).

    The first registry entry wins, so every ZIP-based file reads as the first ZIP-based type.
    ``prefer_extension`` picks, among entries of the same signature, the one named by the file.
    Signatures are compared on the first 262 bytes as literal columns; nothing is joined.
    """
    registry = [*R.SIGNATURES, *(extra or [])]
    head = F.hex(F.substring(F.col(content).cast("binary"), 1, HEADER_BYTES))
    staged = df.withColumns({"__head": head, "__ext": extension(F.col(name))})
    signed = [(e.lower(), h) for e, h, _ in registry if h]
    groups: dict[str, list[str]] = {}
    for e, h in signed:
        groups.setdefault(h, []).append(e)
    by_magic = None
    for h, exts in groups.items():
        pick = F.lit(exts[0])
        if prefer_extension and len(exts) > 1:
            pick = F.when(F.col("__ext").isin(exts), F.col("__ext")).otherwise(pick)
        value = F.struct(pick.alias("extension"), F.lit(h).alias("magic_hex"))
        test = F.startswith("__head", F.lit(h))
        by_magic = F.when(test, value) if by_magic is None else by_magic.when(test, value)
    known = sorted({e.lower() for e, _, _ in registry})
    staged = staged.withColumn("__magic", by_magic)
    named = F.col("__ext").isin(known)
    ext = F.when(F.col("__magic").isNotNull(), F.col("__magic.extension")).when(named, F.col("__ext")).otherwise(F.lit("unknown"))
    return staged.withColumns(
        {
            "detected_ext": ext,
            "confidence": F.when(F.col("__magic").isNotNull(), F.lit(1.0)).when(named, F.lit(0.3)).otherwise(F.lit(0.0)),
            "magic_hex": F.coalesce("__magic.magic_hex", F.lit("")),
        }
    ).withColumn(
        "detected_mime",
        F.when(F.col("detected_ext") == "unknown", F.lit("application/octet-stream")).otherwise(mime_of_extension(F.col("detected_ext"))),
    ).drop("__head", "__ext", "__magic")


def detect_by_extension(df: DataFrame, name: str, declared: str | None = None) -> DataFrame:
    """Type by the declared extension, else by the filename: confidence 0.5, or unknown with 0."""
    known = sorted({e for e, _, _ in R.SIGNATURES})
    ext = extension(F.col(name))
    if declared:
        ext = F.coalesce(F.nullif(F.lower(declared), F.lit("")), ext)
    hit = F.coalesce(ext.isin(known), F.lit(False))
    return df.withColumns(
        {
            "named_ext": F.when(hit, ext).otherwise(F.lit("unknown")),
            "named_mime": F.when(hit, mime_of_extension(ext)).otherwise(F.lit("application/octet-stream")),
            "named_confidence": F.when(hit, F.lit(0.5)).otherwise(F.lit(0.0)),
        }
    )


def type_mismatch(df: DataFrame, content: str, name: str) -> DataFrame:
    """Signature type beside name type, and whether a certain signature contradicts the name."""
    both = detect_by_extension(detect_type(df, content, name), name)
    return both.withColumn(
        "mismatch",
        (F.col("confidence") == 1.0) & (F.col("named_ext") != "unknown") & (F.col("detected_mime") != F.col("named_mime")),
    )


def best_detection(dets: DataFrame, key: str) -> DataFrame:
    """Per file the detection of highest confidence, the first detector on ties."""
    return dets.groupBy(key).agg(
        F.max_by(F.struct("detector", "detected_ext"), F.struct(F.col("confidence"), -F.col("ord"))).alias("b"),
        F.max("confidence").alias("confidence"),
    ).select(key, "b.detector", "b.detected_ext", "confidence")


# ---- bytes ----
def _between(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


SJIS_LEAD, SJIS_TRAIL = _between((0x81, 0x9F), (0xE0, 0xEF)), _between((0x40, 0x7E), (0x80, 0xFC))
EUC_LEAD, EUC_TRAIL = _between((0xA1, 0xDF), (0xF0, 0xFE)), _between((0xA1, 0xFE))
# declared name -> name of the encoding, and Python's codec that reads it
DECLARED = {
    label: known
    for known, labels in {
        ("UTF-8", "utf-8"): "utf-8 utf8 unicode-1-1-utf-8",
        ("UTF-16LE", "utf-16-le"): "utf-16 utf-16le unicode ucs-2",
        ("UTF-16BE", "utf-16-be"): "utf-16be",
        ("Shift_JIS", "cp932"): "shift_jis shift-jis sjis x-sjis ms_kanji windows-31j ms932 csshiftjis",
        ("EUC-JP", "euc_jp"): "euc-jp x-euc-jp cseucpkdfmtjapanese",
        ("ISO-2022-JP", "iso2022_jp"): "iso-2022-jp csiso2022jp",
        ("windows-1252", "latin-1"): "windows-1252 cp1252 x-cp1252 iso-8859-1 iso8859-1 latin1 l1 ascii us-ascii",
        ("GBK", "gbk"): "gbk gb2312 gb_2312-80 chinese x-gbk",
        ("Big5", "big5hkscs"): "big5 big5-hkscs x-x-big5 cn-big5",
        ("EUC-KR", "cp949"): "euc-kr korean ks_c_5601-1987 windows-949",
    }.items()
    for label in labels.split()
}


def _japanese_scores(data: bytes) -> tuple[float, float]:
    """Lead bytes of Shift_JIS and EUC-JP with a valid byte after them, counted from left to right.

    A lead takes the next byte with it. The byte before a run of possible leads is none, so a run begins with a lead and every
    other byte of it is one: where a pair begins follows from the place in the run, and the text is a few array passes.
    """
    raw = np.frombuffer(data, np.uint8)
    could = SJIS_LEAD[raw] | EUC_LEAD[raw]
    at = np.arange(len(raw))
    begins = could & ~np.r_[False, could[:-1]]
    leads = np.flatnonzero(could & ((at - np.maximum.accumulate(np.where(begins, at, 0))) % 2 == 0))
    follows = np.r_[raw, 0][leads + 1]
    last = leads + 1 == len(raw)
    scores = []
    for lead, trail in ((SJIS_LEAD, SJIS_TRAIL), (EUC_LEAD, EUC_TRAIL)):
        own = lead[raw[leads]]
        scores.append(float((own & (trail[follows] | last)).sum()))
    return scores[0], scores[1]


@F.pandas_udf(T.StringType())
def _declared_encoding(data: pd.Series, declared: pd.Series) -> pd.Series:
    """The declared encoding, if it is a known one and the bytes are text of it."""
    out: list[str | None] = []
    for d, label in zip(data, declared, strict=True):
        name, codec = DECLARED.get((label or "").strip().lower(), (None, None))
        if d is None or name is None:
            out.append(None)
            continue
        try:
            bytes(d).decode(codec)
            out.append(name)
        except UnicodeDecodeError:
            out.append(None)
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StructType([T.StructField("name", T.StringType()), T.StructField("confidence", T.DoubleType())]))
def _japanese_encoding(data: pd.Series) -> pd.DataFrame:
    rows = []
    for d in data:
        name, confidence = None, None
        if d is not None and len(d) >= 4:
            s, e = _japanese_scores(bytes(d))
            if max(s, e) > 0.6 and s != e:
                name = "Shift_JIS" if s > e else "EUC-JP"
                confidence = min(max(s, e) / (s + e), 0.9)
        rows.append((name, confidence))
    return pd.DataFrame(rows, columns=["name", "confidence"])


def detect_encoding(df: DataFrame, col: str, fallback: str = "UTF-8", declared: str | None = None) -> DataFrame:
    """Encoding and confidence of binary text.

    In this order: byte order mark; the encoding named in column ``declared``, if the bytes are text of it; ISO-2022-JP escape; valid
    UTF-8; the byte-pair score; the fallback. A declared name that is null, empty, unknown or wrong is passed over. Only rows with a declared name and
    rows that nothing else decides go to Python. Null content has the fallback at confidence 0.3.
    """
    data = F.col(col)
    head = F.hex(F.substring(data, 1, 3))
    latin = F.decode(data, "ISO-8859-1")
    escape = F.contains(latin, F.lit("\x1b$B")) | F.contains(latin, F.lit("\x1b$@"))
    mark = (
        F.when(head == "EFBBBF", F.lit("UTF-8"))
        .when(F.startswith(head, F.lit("FEFF")), F.lit("UTF-16BE"))
        .when(F.startswith(head, F.lit("FFFE")), F.lit("UTF-16LE"))
    )
    found = F.when(escape, F.lit("ISO-2022-JP")).when(F.is_valid_utf8(data), F.lit("UTF-8"))
    staged = df.withColumn("__mark", mark).withColumn("__said", F.lit(None).cast("string"))
    if declared is not None:
        asked = F.col("__mark").isNull() & (F.length(F.trim(F.col(declared))) > 0)
        staged = staged.withColumn("__said", _declared_encoding(F.when(asked, data), F.col(declared)))
    staged = staged.withColumn("__certain", F.coalesce("__mark", "__said")).withColumn("__sure", F.coalesce("__certain", found))
    staged = staged.withColumn("__guess", _japanese_encoding(F.when(F.col("__sure").isNull(), F.col(col))))
    return staged.withColumns(
        {
            "encoding": F.coalesce("__sure", "__guess.name", F.lit(fallback)),
            "encoding_confidence": F.when(F.col("__certain").isNull() & (F.col("__sure") == "ISO-2022-JP"), F.lit(0.95))
            .when(F.col("__sure").isNotNull(), F.lit(1.0))
            .otherwise(F.coalesce("__guess.confidence", F.lit(0.3))),
            "is_unicode": F.coalesce("__sure", "__guess.name", F.lit(fallback)).startswith("UTF"),
        }
    ).drop("__sure", "__guess", "__mark", "__said", "__certain")


def _shannon(data) -> float:
    n = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    p = n[n > 0] / len(data)
    return float(-(p * np.log2(p)).sum()) + 0.0


@F.pandas_udf(T.DoubleType())
def _entropy(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for data in batches:
        yield data.map(lambda d: None if d is None else (0.0 if len(d) == 0 else _shannon(d)))


def entropy(df: DataFrame, col: str, out: str = "entropy") -> DataFrame:
    """Shannon entropy of the bytes of each row, in bits. The histogram stays inside the row."""
    return df.withColumn(out, _entropy(F.col(col).cast("binary")))


def _window_entropies(data, win: int, most: int = 4096) -> np.ndarray:
    """Entropy of every window of ``win`` bytes, half a window apart.

    One histogram per half window serves all windows, each of which is two of them in a row (and one byte, if ``win`` is odd). ``most``
    windows are worked on at once.
    """
    raw, step = np.frombuffer(data, np.uint8), win // 2
    n = (len(raw) - win) // step + 1
    out = np.empty(n)
    for lo in range(0, n, most):
        hi = min(lo + most, n)
        part = raw[lo * step : (hi + 1) * step]
        block = np.repeat(np.arange(hi - lo + 1), step)
        half = np.bincount(block * 256 + part, minlength=(hi - lo + 1) * 256).reshape(-1, 256)
        counts = half[:-1] + half[1:]
        if win % 2:
            counts[np.arange(hi - lo), raw[np.arange(lo, hi) * step + win - 1]] += 1
        p = counts / win
        out[lo:hi] = -(p * np.log2(np.where(counts, p, 1.0))).sum(axis=1)
    return out


def entropy_anomaly(df: DataFrame, key: str, col: str, win: int = 1024) -> DataFrame:
    """Content whose half-overlapping windows stray from its overall entropy.

    A window strays when it is off by more than 15 %. Flagged when over 30 % of len/(win/2) stray and
    the largest deviation exceeds 0.3. Content under two windows is not judged.
    """

    @F.pandas_udf("struct<entropy:double,suspicious:bigint,windows:bigint,max_deviation:double>")
    def judge(data: pd.Series) -> pd.DataFrame:
        rows = []
        for d in data:
            if d is None or len(d) < win * 2:
                rows.append((None, 0, 0, 0.0))
                continue
            whole = _shannon(d)
            off = np.abs(_window_entropies(d, win) - whole)
            rows.append((whole, int((off / whole > 0.15).sum()) if whole > 0 else 0, len(d) // (win // 2), float(off.max())))
        return pd.DataFrame(rows, columns=["entropy", "suspicious", "windows", "max_deviation"]).astype(
            {"suspicious": "int64", "windows": "int64"}
        )

    judged = df.select(key, judge(F.col(col).cast("binary")).alias("j")).select(key, "j.*")
    ratio = F.when(F.col("windows") > 0, F.col("suspicious") / F.col("windows")).otherwise(F.lit(0.0))
    flagged = (ratio > 0.30) & (F.col("max_deviation") > 0.3)
    return judged.withColumns(
        {
            "anomaly": flagged,
            "confidence": F.when(flagged, F.least(F.lit(0.30) + F.least(ratio, F.lit(0.60)), F.lit(0.75))).otherwise(F.lit(0.0)),
        }
    )


def recommend(findings: DataFrame, key: str, block: float = 0.85, safe: float = 0.10) -> DataFrame:
    """Recommendation per file from the confidences of its findings."""
    c = F.col("confidence")
    agg = findings.groupBy(key).agg(F.max(c).alias("__max"), F.count_if((c >= 0.40) & (c < 0.70)).alias("__moderate"))
    return agg.select(
        key,
        F.when(F.col("__max") >= block, F.lit("block"))
        .when((F.col("__max") >= 0.70) | (F.col("__moderate") >= 3), F.lit("re_encode"))
        .when(F.col("__max") >= safe, F.lit("investigate"))
        .otherwise(F.lit("safe"))
        .alias("recommendation"),
    )


# ---- archives ----
def scan_parts(entries: DataFrame, name: str, content_type: str | None = None) -> DataFrame:
    """Archive parts that can carry macros, controls or embedded objects, with the reason."""
    low = F.lower(name)
    reason = F.lit(None).cast("string")
    if content_type:
        for ct in reversed(R.DANGEROUS_CONTENT_TYPES):
            reason = F.when(F.contains(F.lower(content_type), F.lit(ct.lower())), F.lit(f"type:{ct}")).otherwise(reason)
    for part in reversed(R.DANGEROUS_PARTS):
        reason = F.when(F.contains(low, F.lit(part.lower())), F.lit(f"part:{part}")).otherwise(reason)
    return entries.withColumn("reason", reason).where(F.col("reason").isNotNull())


def check_entries(
    entries: DataFrame,
    name: str = "entry_name",
    max_depth: int = R.ARCHIVE_MAX_DEPTH,
    max_entry_bytes: int = R.ARCHIVE_MAX_ENTRY_BYTES,
    allowed: tuple[str, ...] = R.ALLOWED_ENTRY_EXTENSIONS,
) -> DataFrame:
    """All violations of each archive entry, as a sorted array and a flag."""
    n = F.col(name)
    ext = F.coalesce(extension(n), F.lit(""))
    tests = [
        (F.contains(n, F.lit("..")) | F.startswith(n, F.lit("/")) | F.startswith(n, F.lit("\\")), "path_traversal"),
        (F.col("depth") >= max_depth, "too_deep"),
        (F.col("uncompressed_size") > max_entry_bytes, "too_large"),
        (ext.isin(*R.BLOCKED_EXECUTABLES), "executable"),
        (~ext.isin(*allowed), "extension_not_allowed"),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(v)) for t, v in tests]))
    return entries.withColumn("violations", F.array_sort(found)).withColumn("entry_ok", F.size("violations") == 0)


def check_archives(
    entries: DataFrame, key: str, max_ratio: int = R.ARCHIVE_MAX_RATIO, max_total: int = R.ARCHIVE_MAX_TOTAL_BYTES
) -> DataFrame:
    """Totals, integer expansion ratio and bomb flags per archive, from partial sums."""
    sums = entries.groupBy(key).agg(
        F.sum("uncompressed_size").alias("total_uncompressed"), F.sum("compressed_size").alias("total_compressed")
    )
    ratio = F.when(F.col("total_compressed") > 0, F.expr("total_uncompressed div greatest(total_compressed, 1)")).otherwise(F.lit(0))
    return sums.withColumn("ratio", ratio.cast("bigint")).withColumns(
        {"is_bomb": F.col("ratio") > max_ratio, "over_total": F.col("total_uncompressed") > max_total}
    )


def ppap_score(files: DataFrame, entries: DataFrame, key: str, name: str, threshold: float = R.PPAP_THRESHOLD) -> DataFrame:
    """Confidence that a file is a password-protected archive sent ahead of its password.

    0.8·(1 − 0.8^(1/n)) for n encrypted entries, plus 0.25 per name pattern up to 0.5, plus 0.05 for
    the container extension. The first term falls as n grows; that is the published formula.
    """
    locked = entries.groupBy(key).agg(F.count_if("encrypted").alias("encrypted_entries"))
    joined = files.join(locked, key, "left").withColumn("encrypted_entries", F.coalesce("encrypted_entries", F.lit(0).cast("bigint")))
    hits = sum((F.col(name).rlike(p).cast("int") for p in R.PPAP_NAME_PATTERNS), F.lit(0))
    box = F.coalesce(extension(F.col(name)).isin(*R.PPAP_CONTAINERS), F.lit(False))
    n = F.col("encrypted_entries")
    locked_part = F.when(n > 0, F.lit(0.8) * (1 - F.pow(F.lit(0.8), 1.0 / F.greatest(n, F.lit(1))))).otherwise(F.lit(0.0))
    total = locked_part + F.least(hits * 0.25, F.lit(0.5)) + F.when(box, F.lit(0.05)).otherwise(F.lit(0.0))
    scored = joined.withColumns({"name_hits": hits.cast("bigint"), "is_container": box, "confidence": F.least(total, F.lit(1.0))})
    return scored.withColumn("is_ppap", F.col("confidence") >= threshold)


def ppap_disposition(scores: DataFrame, policy: str = "warn_and_sanitize", method: str | None = None) -> DataFrame:
    """What happens to each file under a policy.

    Warning and sanitising handles only the weak cipher; a stronger one is blocked. ``method`` names
    the column with the encryption method.
    """
    fixed = {"block": "blocked", "quarantine": "quarantined", "convert_to_secure": "converted_to_secure"}
    if policy in fixed:
        act = F.lit(fixed[policy])
    elif policy == "warn_and_sanitize":
        act = F.lit("sanitized_with_warning")
        if method:
            strong = F.col(method).isNotNull() & (F.col(method) != "ZipCrypto")
            act = F.when(strong, F.lit("blocked")).otherwise(act)
    else:
        raise ValueError("policy must be block, warn_and_sanitize, quarantine or convert_to_secure")
    return scores.withColumn("disposition", F.when(F.col("is_ppap"), act).otherwise(F.lit("passed_through")))


def ppap_stats(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if("is_ppap").alias("ppap_files"),
        F.count_if(F.col("disposition") == "blocked").alias("blocked"),
        F.count_if(F.col("disposition") == "sanitized_with_warning").alias("sanitized"),
        F.count_if(F.col("disposition") == "quarantined").alias("quarantined"),
        F.count_if(F.col("disposition") == "converted_to_secure").alias("converted"),
    )


def macro_allowlist(parts: DataFrame, hashes: DataFrame, content: str, default: str = "block") -> DataFrame:
    """Allow macro parts whose SHA-256 is listed (``sha256``); the rest get the default action."""
    hashed = parts.withColumn("sha256", F.sha2(content, 256))
    listed = hashes.select("sha256").distinct().withColumn("__ok", F.lit(True))
    return hashed.join(listed, "sha256", "left").withColumn(
        "macro_action", F.when(F.col("__ok"), F.lit("allow")).otherwise(F.lit(default))
    ).drop("__ok")


def downgrade(df: DataFrame, name: str, rules: dict[str, str] | None = None) -> DataFrame:
    """Safer target extension and name of macro-enabled formats; others stay."""
    table = R.DOWNGRADES if rules is None else rules
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    target = F.element_at(F.create_map(*pairs), extension(F.col(name)))
    return df.withColumns(
        {
            "downgraded": target.isNotNull(),
            "safe_name": F.when(target.isNotNull(), F.concat(F.regexp_replace(F.col(name), r"\.[^.]+$", "."), target)).otherwise(F.col(name)),
        }
    )


def dup_content(df: DataFrame, key: str, content: str) -> DataFrame:
    """Hashes held by more than one row: copies, first key.

    Only hashes are shuffled and partial counts absorb a hash held by a third of all rows.
    """
    return (
        df.select(key, F.sha2(content, 256).alias("sha256"))
        .groupBy("sha256")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_key"))
        .where("copies > 1")
    )


# ---- presets and filename rules ----
def presets_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(p) for p in R.PRESETS], R.PRESET_SCHEMA)


def apply_preset(files: DataFrame, preset: str, name: str = "filename", size: str = "file_size") -> DataFrame:
    """Limits of a preset and the violations of each file (size by kind, archive depth and ratio)."""
    found = [p for p in R.PRESETS if p[0] == preset]
    if not found:
        raise ValueError(f"unknown preset {preset}")
    _, _, _, _, depth, ratio, pdf, office, zipped, *_ = found[0]
    mb = 1024 * 1024
    ext = F.coalesce(extension(F.col(name)), F.lit(""))
    cols = set(files.columns)
    tests = [
        ((ext == "pdf") & (F.col(size) > pdf * mb), "pdf_too_large"),
        (ext.isin("doc", "docx", "xls", "xlsx", "ppt", "pptx", "docm", "xlsm", "pptm") & (F.col(size) > office * mb), "office_too_large"),
        ((ext == "zip") & (F.col(size) > zipped * mb), "zip_too_large"),
    ]
    if "depth" in cols:
        tests.append((F.col("depth") > depth, "archive_too_deep"))
    if {"uncompressed_size", "compressed_size"} <= cols:
        tests.append(
            ((F.col("compressed_size") > 0) & (F.expr("uncompressed_size div greatest(compressed_size, 1)") > ratio), "ratio_too_high")
        )
    found_v = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(v)) for t, v in tests]))
    return files.withColumns({"preset": F.lit(preset), "violations": F.array_sort(found_v)})


def glob_regex(pattern: str) -> str:
    """A ;-separated list of globs (* and ?) as one anchored, case-insensitive regex."""
    parts = []
    for p in pattern.split(";"):
        p = p.strip()
        if p:
            parts.append("".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in p))
    return "(?is)^(?:" + "|".join(parts) + ")$" if parts else "(?!)"


def match_policy(files: DataFrame, rules: list[tuple[str, str]], name: str, default: str, out: str = "policy") -> DataFrame:
    """Policy of the first rule (globs, policy) that fits the name, else the default."""
    col = F.lit(default)
    for globs, policy in reversed(rules):
        col = F.when(F.coalesce(F.col(name).rlike(glob_regex(globs)), F.lit(False)), F.lit(policy)).otherwise(col)
    return files.withColumn(out, col)


def retention_due(
    files: DataFrame, rules: list[tuple[str, int, str | None]], name: str, created: str, now: str, default_days: int
) -> DataFrame:
    """Retention days, archive target and due flag by the first matching path rule (globs, days, target)."""
    days, target = F.lit(default_days), F.lit(None).cast("string")
    for globs, d, to in reversed(rules):
        fits = F.coalesce(F.col(name).rlike(glob_regex(globs)), F.lit(False))
        days = F.when(fits, F.lit(d)).otherwise(days)
        target = F.when(fits, F.lit(to).cast("string")).otherwise(target)
    return files.withColumns({"retention_days": days.cast("bigint"), "archive_to": target}).withColumn(
        "due", F.date_add(F.to_date(created), F.col("retention_days").cast("int")) <= F.lit(now).cast("date")
    )

