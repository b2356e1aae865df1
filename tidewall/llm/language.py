"""Language of web pages by Bayesian fusion of evidence.

The log posterior of a language is the sum of four terms: the likelihood of the text under byte-gram models; the
likelihood of the language that the markup declares, estimated from how often declarations agree with texts; that
of the address suffix; and the prior of the host, smoothed towards its domain and that towards all pages. The host
counts come from one grouped aggregation over all pages, and a page's own share is taken out of its prior.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewall.llm import arrays as A
from tidewall.session import cut_lineage

SAMPLE = 1_000  # labelled texts per language to fit the text model on
BUCKETS = 1 << 16
SMOOTH = 0.5  # added to every count of the text model
PER_GRAM = 0.1  # neighbouring grams overlap; each counts for a part of one
DECLARED_SMOOTH = 5.0
SUFFIX_TRUST = 0.8
DOMAIN_WEIGHT, HOST_WEIGHT = 20.0, 10.0  # pages that the level above counts for

# --- fixed values: country suffixes and the languages they speak for ---
SUFFIX_LANGUAGE = {
    "at": "de", "de": "de", "li": "de", "ar": "es", "cl": "es", "co": "es", "es": "es", "mx": "es", "pe": "es", "uy": "es",
    "fr": "fr", "sn": "fr", "au": "en", "ie": "en", "nz": "en", "uk": "en", "us": "en", "br": "pt", "pt": "pt", "it": "it",
    "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "kr": "ko", "cn": "zh", "tw": "zh", "tr": "tr", "gr": "el", "se": "sv",
}
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
# --- end of fixed values ---

HIDDEN = re.compile(r"<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>|<!--.*?-->", re.S | re.I)
TAG = re.compile(r"<[^>]*>")
OPENING = re.compile(r"<html\b[^>]*", re.I)
DECLARED = re.compile(r"\slang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
META = re.compile(r"<meta\b[^>]*", re.I)
CONTENT_LANGUAGE = re.compile(r"http-equiv\s*=\s*[\"']?content-language", re.I)
CONTENT = re.compile(r"(?=content\s*=\s*[\"']?([A-Za-z]{2,3}))", re.I)
LETTERS = np.full(256, 32, np.uint8)
LETTERS[np.r_[97:123, 128:256]] = np.r_[97:123, 128:256]
LETTERS[65:91] = np.arange(97, 123)


def visible_text(page: str) -> str:
    """The text of a page: scripts, styles, comments and tags out, entities read."""
    text = TAG.sub(" ", HIDDEN.sub(" ", page))
    return html_entities.unescape(text) if "&" in text else text


def declared_language(page: str) -> str | None:
    """The language that the markup declares, anywhere in the page: of the first html tag with one, else of a content-language meta tag.

    Every tag is read once, up to its end.
    """
    for tag in OPENING.finditer(page):
        if m := DECLARED.search(tag[0]):
            return m[1].lower()
    for tag in META.finditer(page):
        if m := CONTENT_LANGUAGE.search(tag[0]):
            if found := CONTENT.findall(tag[0], m.end()):
                return found[-1].lower()
    return None


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the four-byte grams of each text over its letters, and where each text's grams start."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    low = LETTERS[data]
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)  # one blank between words
    edges = offsets[(offsets < len(data))]
    keep[edges] = True
    kept = low[keep].astype(np.uint32)
    where = np.r_[0, np.cumsum(keep)][offsets]
    n = len(kept) - 3
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = kept[:n] | (kept[1 : n + 1] << 8) | (kept[2 : n + 2] << 16) | (kept[3 : n + 3] << 24)
    bucket = ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
    inside = np.ones(n, bool)
    for back in (1, 2, 3):  # grams that would cross into the next text
        at = where[1:-1] - back
        inside[at[(at >= 0) & (at < n)]] = False
    starts = np.r_[0, np.cumsum(inside)][np.minimum(where, n)]
    return bucket[inside], starts


def fit_text_model(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = SAMPLE, key: str = "doc_id") -> dict[str, np.ndarray]:
    """Log probability of every bucket by language, from at most ``per_language`` labelled texts of each.

    The sample is the rows whose keys have the smallest hashes. Rows with a null text or language are left out.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key)).alias("_h"))
    few = rows.withColumn("_r", F.row_number().over(W.partitionBy("lang").orderBy("_h"))).where(F.col("_r") <= per_language).select("lang", "text")

    def count(pdf):
        import pandas as pd

        total = np.zeros(BUCKETS, np.int64)
        data, offsets = A.text_buffers(pa.array(pdf["text"], pa.string()))
        for lo, hi in A.chunks(offsets):
            bucket, _ = grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            total += np.bincount(bucket, minlength=BUCKETS)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "counts": [total.tobytes()]})

    found = few.groupBy("lang").applyInPandas(count, "lang string, counts binary").collect()  # one row per language
    out = {}
    for r in sorted(found, key=lambda r: r["lang"]):
        n = np.frombuffer(r["counts"], np.int64) + SMOOTH
        out[r["lang"]] = np.log(n / n.sum()).astype(np.float32)
    return out


def _reader(model, per_gram: float):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                pages = part.column("_html").to_pylist()
                data, offsets = A.text_buffers(pa.array([visible_text(p) if p else "" for p in pages], pa.string()))
                bucket, starts = grams(data, offsets)
                total = np.zeros((len(bucket) + 1, table.shape[1]))
                np.cumsum(table[bucket], axis=0, out=total[1:])
                scores = (total[starts[1:]] - total[starts[:-1]]) * per_gram
                declared = [declared_language(p) if p else None for p in pages]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(declared, pa.string()), pa.array(np.diff(starts)), pa.array(list(scores), pa.list_(pa.float64()))],
                    names=["page_id", "url", "declared", "n_grams", "_text"],
                )

    return read


def host_of(url: Column) -> Column:
    """Lower-case host of an address without port and user; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(F.length(host) > 0, host)


def domain_of(host: Column) -> Column:
    """The last two labels of a host, three where the last but one is a general one of a country."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    general = (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, -2).isin(*SECOND_LEVEL)
    return F.when(n <= 2, host).otherwise(F.array_join(F.slice(labels, n - F.when(general & (n > 2), 2).otherwise(1), F.lit(3)), "."))


def _softmax(logs: Column) -> Column:
    """Probabilities of an array of log weights."""
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def _plus(*parts: Column) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = F.zip_with(out, p, lambda a, b: a + b)
    return out


def _numbers(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def identify(pages: DataFrame, model: dict[str, np.ndarray], page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Language of every page: page_id, lang, confidence, text_lang, declared, host, n_grams.

    A null or empty page has no text evidence, a page without a declaration or with one in a language not modelled no markup evidence,
    an address that cannot be read no suffix and no host; with no evidence at all the prior of all pages decides.
    Equal posteriors go to the first language by name. Repeated rows are pages of their own; other columns are
    left out. An empty table gives no row.
    """
    langs = sorted(model)
    k = len(langs)
    spark = pages.sparkSession
    table = spark.sparkContext.broadcast(np.stack([model[x] for x in langs], axis=1))  # buckets x languages
    slim = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("_html"))
    read = slim.mapInArrow(_reader(table, PER_GRAM), "page_id long, url string, declared string, n_grams long, _text array<double>")
    host = host_of(F.col("url"))
    read = cut_lineage(read.withColumn("host", host).withColumn("_domain", domain_of(F.col("host"))).drop("url"))

    best = lambda p: F.get(F.array(*(F.lit(x) for x in langs)), (F.array_position(p, F.array_max(p)) - 1).cast("int"))
    at = F.when(F.col("declared").isin(*langs), F.col("declared"))
    text_lang = F.when(F.col("n_grams") > 0, best(F.col("_text")))
    known = read.withColumn("_declared", at).withColumn("text_lang", text_lang)
    seen = {(r["_declared"], r["text_lang"]): r["count"] for r in known.where("_declared is not null and text_lang is not null").groupBy("_declared", "text_lang").count().collect()}
    markup = F.lit(None)
    for d in langs:  # how likely a page in each language declares d
        row = []
        for true in langs:
            of = sum(seen.get((x, true), 0) for x in langs)
            row.append(np.log((seen.get((d, true), 0) + DECLARED_SMOOTH / k) / (of + DECLARED_SMOOTH)))
        markup = F.when(F.col("_declared") == d, _numbers(row)).otherwise(markup)
    none = _numbers([0.0] * k)
    suffix = F.lit(None)
    last = F.element_at(F.split("host", r"\."), -1)
    for lang in langs:
        ends = [s for s, x in SUFFIX_LANGUAGE.items() if x == lang]
        if ends:
            row = [np.log(SUFFIX_TRUST if x == lang else (1 - SUFFIX_TRUST) / max(k - 1, 1)) for x in langs]
            suffix = F.when(last.isin(*ends), _numbers(row)).otherwise(suffix)
    evidence = known.withColumn("_ev", _plus(F.col("_text"), F.coalesce(markup, none), F.coalesce(suffix, none)))
    evidence = evidence.withColumn("_post", _softmax(F.col("_ev")))

    sums = [F.sum(F.get("_post", i)).alias(f"_s{i}") for i in range(k)]
    hosts = cut_lineage(evidence.where(F.col("host").isNotNull()).groupBy("host", "_domain").agg(*sums))
    total = evidence.agg(*sums).first()
    everywhere = np.array([total[f"_s{i}"] or 0.0 for i in range(k)]) + 1.0
    everywhere /= everywhere.sum()
    domains = hosts.groupBy("_domain").agg(F.array(*(F.sum(f"_s{i}") for i in range(k))).alias("_in_domain"))
    counts = hosts.select("host", "_domain", F.array(*(F.col(f"_s{i}") for i in range(k))).alias("_in_host")).join(domains, "_domain")
    counts = cut_lineage(counts.select("host", "_in_host", "_in_domain"))
    joined = evidence.join(counts, "host", "left")
    less = lambda c: F.transform(F.zip_with(F.col(c), F.col("_post"), lambda n, own: n - own), lambda x: F.greatest(x, F.lit(0.0)))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    joined = joined.withColumn("_d", less("_in_domain")).withColumn("_h", less("_in_host"))
    joined = joined.withColumn("_pd", F.zip_with("_d", _numbers(everywhere), lambda n, p: n + DOMAIN_WEIGHT * p))
    joined = joined.withColumn("_pd", F.transform("_pd", lambda x: x / (add(F.col("_d")) + DOMAIN_WEIGHT)))
    joined = joined.withColumn("_ph", F.zip_with("_h", F.col("_pd"), lambda n, p: n + HOST_WEIGHT * p))
    joined = joined.withColumn("_ph", F.transform("_ph", lambda x: F.log(x / (add(F.col("_h")) + HOST_WEIGHT))))
    final = _softmax(_plus(F.col("_ev"), F.coalesce(F.col("_ph"), _numbers(np.log(everywhere)))))
    out = joined.withColumn("_final", final)
    return out.select("page_id", best(F.col("_final")).alias("lang"), F.array_max("_final").alias("confidence"), "text_lang", "declared", "host", "n_grams")
