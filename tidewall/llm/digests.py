"""Fingerprints of documents that change little when a text changes little, by quartiles of bucket counts.

Every three neighbouring bytes of a text are hashed to one of ``BUCKETS`` buckets. A bucket's two bits say in which quarter of
the text's own bucket counts it lies; a byte for the length and two half bytes for the quartiles go in front. The difference of two
digests is the sum of the steps between their parts, bounded by what two digests that have nothing in common differ by;
likeness is one less the bounded difference as a share of the bound.

To compare every document with the next one, the texts cross the network once, in ranges of their order. A range is walked as
it arrives; only its first and its last text wait for the ranges beside it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from tidewall.llm import arrays as A
from tidewall.llm.store import kept

BUCKETS = 256
FACTOR = np.uint32(2654435761)
SHIFT = np.uint32(32 - (BUCKETS - 1).bit_length())
BOUND = BUCKETS * 5 // 4  # what two independent digests differ by: |a - b| of two even quarters is 1.25 on average
CHUNK = 4_000_000  # bytes of text whose triplets are counted at once
HEAD = 4  # hex digits before the buckets
DONE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
WALKED = f"{DONE}, _kind int, _range int, _text string"
FINISHED, LAST, FIRST = 0, 1, 2


def bucket_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many byte triplets of each text fall in each bucket; a triplet never reaches into the next text."""
    n = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((n, BUCKETS), np.int64)
    wide = data.astype(np.uint32)
    bucket = ((((wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]) * FACTOR) >> SHIFT).astype(np.int64)
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n) * BUCKETS, size)[:-2]
    crosses = np.zeros(len(data), bool)
    ends = offsets[1:]
    for back in (1, 2):
        at = ends - back
        crosses[at[at >= 0]] = True  # of shorter texts these are bytes of the text before, whose last two cross as well or hold none
    cell = (owner + bucket)[~crosses[:-2]]
    return np.bincount(cell, minlength=n * BUCKETS).reshape(n, BUCKETS)


def digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of small numbers per text: length, two quartile shares, then the quarter of every bucket.

    The length counts quarters of octaves. A bucket is in quarter 0 if its count is at most the first quartile, and so on.
    """
    counts = bucket_counts(data, offsets)
    low, mid, high = (np.partition(counts, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1], axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]).T
    out = np.empty((len(counts), 3 + BUCKETS), np.uint8)
    size = np.diff(offsets) + 1
    octave = np.frexp(size.astype(np.float64))[1].astype(np.int64)
    out[:, 0] = 4 * octave + (((size << 2) >> (octave - 1)) & 3)
    out[:, 1], out[:, 2] = 16 * low // (high + 1), 16 * mid // (high + 1)
    out[:, 3:] = (counts > low[:, None]).astype(np.uint8) + (counts > mid[:, None]) + (counts > high[:, None])
    return out


def as_text(digest: np.ndarray) -> list[str]:
    """Digests as hex strings."""
    four = digest[:, 3:].reshape(len(digest), BUCKETS // 4, 4)
    packed = (four << np.array([6, 4, 2, 0], np.uint8)).sum(axis=2, dtype=np.uint8)
    head = np.stack([digest[:, 0], (digest[:, 1] << 4) | digest[:, 2]], axis=1)
    return [row.tobytes().hex() for row in np.concatenate([head, packed], axis=1)]


def from_text(digest: list[str]) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex("".join(digest)), np.uint8).reshape(len(digest), HEAD // 2 + BUCKETS // 4)
    quarters = (raw[:, 2:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3
    return np.concatenate([raw[:, :1], raw[:, 1:2] >> 4, raw[:, 1:2] & 15, quarters.reshape(len(raw), BUCKETS)], axis=1)


def likeness_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, 0 for such as differ by the bound or more."""
    apart = np.abs(a.astype(np.int16) - b).sum(axis=1, dtype=np.int64)
    return 1.0 - np.minimum(apart, BOUND) / float(BOUND)


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two fingerprint columns; null where one of them is null."""
    both = a.notna() & b.notna()
    out = pd.Series(np.nan, index=a.index).astype("Float64")
    out[~both] = pd.NA
    if both.any():
        out[both] = likeness_of(from_text(a[both].tolist()), from_text(b[both].tolist()))
    return out


def _digests_of(texts: list[str]) -> np.ndarray:
    data, offsets = A.text_buffers(pa.array(texts, pa.large_string()))
    return digests(data, offsets)


@F.pandas_udf(T.StringType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        column = pa.array(texts.tolist(), pa.large_string())
        data, offsets = A.text_buffers(column)
        found: list[str] = []
        for lo, hi in A.chunks(offsets, CHUNK):
            found += as_text(digests(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
        yield pd.Series(found, index=texts.index, dtype=object)


def fingerprint(text) -> F.Column:
    """Fingerprint of a text column; a null text is an empty one."""
    return _fingerprints(F.coalesce(text, F.lit("")))


def edited(text: str, following: str) -> str:
    """The text whose last half, rounded down, gives way to as much of the beginning of another, or to all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _finished(ids: list, texts: list[str], own: np.ndarray, after: np.ndarray, following: list[str]) -> list:
    """Columns of texts whose next text is known. own, after: digests of the texts and of the next ones."""
    new = [edited(t, n) for t, n in zip(texts, following, strict=True)]
    changed = _digests_of(new)
    return [
        pa.array(ids, pa.int64()), pa.array(map(len, texts), pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()), pa.array(as_text(own), pa.string()), pa.array(as_text(changed), pa.string()),
        pa.array(likeness_of(own, changed)), pa.array(likeness_of(own, after)),
    ]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range in its order. Of its first and last text the text goes on, for the ranges beside."""
    at = TaskContext.get().partitionId()
    first = held = None

    def rows(columns: list, kind: int, texts: list) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([*columns, pa.array([kind] * n, pa.int32()), pa.array([at] * n, pa.int32()), pa.array(texts, pa.string())], names=_names(WALKED))

    def edge(row: tuple, kind: int) -> pa.RecordBatch:
        columns = [pa.array([row[0]], pa.int64()), *(pa.array([None], t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))]
        return rows(columns, kind, [row[1]])

    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        data, offsets = A.text_buffers(texts)
        for lo, hi in A.chunks(offsets, CHUNK):
            own = digests(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            part_ids, part = ids[lo:hi], texts.slice(lo, hi - lo).to_pylist()
            first = first or (part_ids[0], part[0])
            if held:
                part_ids, part, own = [held[0], *part_ids], [held[1], *part], np.concatenate([held[2], own])
            if len(part) > 1:
                done = _finished(part_ids[:-1], part[:-1], own[:-1], own[1:], part[1:])
                yield rows(done, FINISHED, [None] * (len(part) - 1))
            held = (part_ids[-1], part[-1], own[-1:])
    if held:
        yield edge(first, FIRST)
        yield edge(held, LAST)


def _bridge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, following = (batch.column(c).to_pylist() for c in ("doc_id", "text", "following"))
        if ids:
            yield pa.RecordBatch.from_arrays(_finished(ids, texts, _digests_of(texts), _digests_of(following), following), names=_names(DONE))


def compare_with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The order is the key (nulls first), then a hash of the text; the first row follows the last, and the only row follows itself. Null
    texts are empty; repeated rows and keys are rows of their own, also where they fill many ranges. Columns of ``df`` other
    than key and text are not read. An empty table gives no row.
    """
    named = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = named.withColumn("_h", F.xxhash64("text")).withColumn("_tie", F.monotonically_increasing_id())
    order = ["doc_id", "_h", "_tie"]
    ranged = named.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    walked = kept(ranged.mapInArrow(_walk, WALKED), "walked")
    finished = walked.where(F.col("_kind") == FINISHED).select(*_names(DONE))
    # one row per range: the range that comes next, or the first one after the last
    ranges = walked.where(F.col("_kind") == FIRST).select("_range")
    nearby = W.orderBy("_range")
    after = ranges.select("_range", F.coalesce(F.lead("_range").over(nearby), F.first("_range").over(nearby)).alias("_after"))
    last = walked.where(F.col("_kind") == LAST).select("_range", "doc_id", F.col("_text").alias("text"))
    first = walked.where(F.col("_kind") == FIRST).select(F.col("_range").alias("_after"), F.col("_text").alias("following"))
    edges = last.join(after, "_range").join(first, "_after").select("doc_id", "text", "following")
    return finished.unionByName(edges.mapInArrow(_bridge, DONE))
