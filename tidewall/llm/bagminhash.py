"""Near-duplicates of multisets of word shingles by BagMinHash.

A shingle that occurs w times has weight w. Every shingle owns Poisson processes over the range of weights, laid out in
blocks [0, 1), [1, 2), [2, 4), [4, 8), ... with as many points per unit of time as the block is long; a point
carries a place in its block and a register, and it counts for a text whose weight lies above that place. The
first point of each register is the signature: two texts agree in a register with the probability of
their weighted Jaccard similarity. Points are drawn in the order of time, and only until every register has one.

Texts are banded by their signatures. In every bucket the text that meets most others is compared with the rest, by the
overlap of their multisets, which links most copies to their source; texts that are linked are not compared again.
Of what is apart after that, every pair of a bucket is judged by an exact bound inside the join: shingles are dealt to ``CLASSES``
classes, and two texts have no more in common than, class by class, the smaller of their two numbers. Only pairs that the bound
lets through are rows, and those are compared. No bucket is cut short, and none is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewall.llm import arrays as A
from tidewall.llm.components import components
from tidewall.llm.store import kept, new_folder, written

U = np.uint64
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
HOT = 256  # comparisons with one text that share a task
HEADS = (1,)  # texts of a bucket that the others are compared with, round by round, before all that can be similar are
CLASSES = 1024  # of shingles; numbers of a class are told apart up to 2
GOLD = U(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, and where each text's start. A text of fewer words is one shingle."""
    starts, ends, first = A.words(data, offsets)
    hashes = A.word_hashes(data, starts, ends)
    n_words = np.diff(first)
    count = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64))
    at = np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    stop = np.minimum(at + size, np.repeat(first[1:], count))
    return A.run_hashes(hashes, at, stop, A.WORDS), np.r_[0, np.cumsum(count)]


def bags(hashes: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text number, hash, weight."""
    text = np.repeat(np.arange(len(where) - 1), np.diff(where))
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], hashes[first], np.diff(np.r_[first, len(hashes)])


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((A.mix(x) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_texts: int, registers: int) -> np.ndarray:
    """The point that comes first in every register of every text, as a number; texts without shingles get zeros."""
    blocks = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1  # how many blocks start below the weight
    item = np.repeat(np.arange(len(shingle)), blocks)
    block = np.arange(len(item)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    length = np.where(block == 0, 1.0, 2.0 ** (block - 1))
    begin = np.where(block == 0, 0.0, length)
    seed = A.mix(shingle[item] + (block.astype(np.uint64) + U(1)) * GOLD)
    rate = np.bincount(text, weight, n_texts)
    first = np.full(n_texts * registers, np.inf)
    point = np.zeros(n_texts * registers, np.uint64)
    until = registers * (np.log(registers) + 4.0) / np.maximum(rate, 1.0)
    since = np.zeros(n_texts)
    time = np.zeros(len(item))  # of the last point drawn
    drawn = np.zeros(len(item), np.uint64)
    pending = np.full(len(item), -1.0)  # a point drawn beyond the horizon, kept for the next
    active = np.arange(len(item))
    while len(active):
        owner = text[item[active]]
        fresh = pending[active] < 0
        draw = active[fresh]
        x = seed[draw] + (drawn[draw] * U(3) + U(1)) * GOLD
        time[draw] -= np.log(_uniform(x)) / length[draw]
        drawn[draw] += U(1)
        inside = time[active] <= until[owner]
        pending[active] = np.where(inside, -1.0, 1.0)
        active = active[inside]
        if len(active):
            key = seed[active] + ((drawn[active] - U(1)) * U(3) + U(2)) * GOLD
            place = begin[active] + _uniform(key) * length[active]
            pick = place < weight[item[active]]
            hit, key = active[pick], A.mix(key[pick] + GOLD)
            slot = text[item[hit]] * registers + (key % U(registers)).astype(np.int64)
            np.minimum.at(first, slot, time[hit])
            won = time[hit] <= first[slot]
            point[slot[won]] = A.mix(key[won] ^ U(0xA5A5A5A5A5A5A5A5))
            continue
        open_ = np.isinf(first.reshape(n_texts, registers)).any(axis=1) & (rate > 0)
        since, until = until.copy(), np.where(open_, 2 * until, until)
        active = np.flatnonzero(open_[text[item]]) if open_.any() else active
    return point.reshape(n_texts, registers)


def band_keys(points: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band."""
    out = np.empty((len(points), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(points), U(b + 1), np.uint64)
        for r in range(rows):
            key = A.mix(key * GOLD + points[:, b * rows + r])
        out[:, b] = key
    return out


def _signer(bands: int, rows: int, size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = A.text_buffers(batch.column("_text"))
            for lo, hi in A.chunks(offsets, 1_000_000):
                hashes, where = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                points = signatures(*bags(hashes, where), hi - lo, bands * rows)
                keys = band_keys(points, bands, rows).view(np.int64)
                keys = [k if n else None for k, n in zip(keys, np.diff(where).tolist(), strict=True)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("_md5"), part.column("_doc"), pa.array(keys, pa.list_(pa.int64()))], names=["_md5", "_doc", "_bands"])

    return sign


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags, given as sorted hashes and weights."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    either = int(a[1].sum() + b[1].sum()) - both
    return both / either if either else 0.0


def _bag(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = A.text_buffers(pa.array([text], pa.string()))
    return bags(*shingles(data, offsets, size))[1:]


def _comparer(size: int, similarity: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bag = None, None
        for batch in batches:
            found = []
            for pivot, node, text in zip(batch.column("pivot").to_pylist(), batch.column("node").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                if pivot == node:
                    own, bag = pivot, _bag(text, size)
                elif own == pivot:
                    s = overlap(bag, _bag(text, size))
                    if s >= similarity:
                        found.append((pivot, node, s))
                else:
                    raise RuntimeError("a pair's first text is missing")
            if found:
                a, b, s = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], names=["a", "b", "similarity"])

    return compare


def _sketcher(size: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Size of each text's bag; bits of the classes that hold at least one and at least two of its shingles; how many lie beyond two."""
        for batch in batches:
            data, offsets = A.text_buffers(batch.column("_text"))
            for lo, hi in A.chunks(offsets):
                text, shingle, weight = bags(*shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size))
                nth = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
                unit = A.mix(np.repeat(shingle, weight) + nth.astype(np.uint64) * GOLD) % U(CLASSES)
                cell, number = np.unique(np.repeat(text, weight) * CLASSES + unit.astype(np.int64), return_counts=True)
                owner, place = cell // CLASSES, cell % CLASSES
                bits = np.zeros((hi - lo, 2 * CLASSES // 64), np.uint64)
                for level in (1, 2):
                    held = number >= level
                    at = (level - 1) * (CLASSES // 64) + place[held] // 64
                    np.bitwise_or.at(bits, (owner[held], at), U(1) << (place[held] % 64).astype(np.uint64))
                beyond = np.bincount(owner, np.maximum(number - 2, 0), hi - lo).astype(np.int64)
                total = np.bincount(text, weight, hi - lo).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(lo, hi - lo), pa.array(total), pa.array(list(bits.view(np.int64)), pa.list_(pa.int64())), pa.array(beyond)],
                    names=["node", "_size", "_bits", "_beyond"],
                )

    return sketch


def _most_common() -> str:
    """An upper bound of the shingles that two sketches a and b share."""
    both = " + ".join(f"bit_count(a._bits[{i}] & b._bits[{i}])" for i in range(2 * CLASSES // 64))
    return f"({both} + least(a._beyond, b._beyond))"


def _compared(pairs: DataFrame, store: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (pivot, node) whose texts are similar. A pivot of many pairs is sent to several tasks, one per ``HOT`` pairs."""
    hot = kept(pairs.groupBy("pivot").agg(F.count("*").alias("_n")).where(F.col("_n") > HOT))
    salted = pairs.join(hot, "pivot", "left").select(
        "pivot", "node", F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("_n") / HOT)), F.lit(0)).cast("int").alias("_salt")
    )
    salted = kept(salted)
    members = salted.join(store, "node").select("pivot", "_salt", "node", "_text")
    heads = salted.select("pivot", "_salt").distinct().join(store.withColumnRenamed("node", "pivot"), "pivot")
    heads = heads.select("pivot", "_salt", F.col("pivot").alias("node"), "_text")
    rows = members.unionByName(heads).withColumn("_later", F.col("pivot") != F.col("node"))
    dealt = rows.repartition("pivot", "_salt").sortWithinPartitions("pivot", "_salt", "_later")
    return dealt.select("pivot", "node", "_text").mapInArrow(_comparer(size, similarity), "a long, b long, similarity double")


class _Grown:
    """Rows of the rounds of a loop: each round writes its own folder, and all of them are read together."""

    def __init__(self, df: DataFrame, kind: str):
        self.spark, self.schema, self.kind, self.folders = df.sparkSession, df.schema, kind, []

    def add(self, df: DataFrame) -> DataFrame:
        self.folders.append(new_folder(self.spark, self.kind))
        df.write.parquet(self.folders[-1])
        return self.spark.read.schema(self.schema).parquet(self.folders[-1])

    def rows(self) -> DataFrame:
        if not self.folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*self.folders)


def _joined(roots: DataFrame | None, found: DataFrame) -> DataFrame:
    """node, root of every linked node after another round of links. Only the links between different roots are new work."""
    if roots is None:
        return kept(components(found))
    ends = found.join(roots.select(F.col("node").alias("a"), F.col("root").alias("_ra")), "a", "left")
    ends = ends.join(roots.select(F.col("node").alias("b"), F.col("root").alias("_rb")), "b", "left")
    moved = kept(components(ends.select(F.coalesce("_ra", "a").alias("a"), F.coalesce("_rb", "b").alias("b"))))
    new = moved.select(F.col("node").alias("_old"), F.col("root").alias("_new"))
    before = roots.join(new, F.col("root") == F.col("_old"), "left").select("node", F.coalesce("_new", "root").alias("root"))
    return kept(before.unionByName(moved.join(roots, "node", "left_anti").select("node", "root")))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Classes of near-duplicates: (texts, links).

    ``texts``: _md5 (of the text), _doc (smallest key of its rows), class_id (smallest key in its class), root (the
    class's number), one row per distinct text.
    ``links``: a, b, similarity between representatives (numbers of texts), those that were needed to join classes.
    A null text is an empty text; texts without a word are alike only if they are equal. Keys may be null (a class of null keys
    has a null class_id) or repeat. Two texts of similarity s share a band with probability 1 - (1 - s^rows)^bands.
    """
    named = df.select(F.col(key).cast("long").alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    hashed = named.withColumn("_md5", F.md5("_text"))
    signed = hashed.mapInArrow(_signer(bands, rows, size), "_md5 string, _doc long, _bands array<long>")
    one = signed.groupBy("_md5").agg(F.min("_doc").alias("_doc"), F.first("_bands").alias("_bands"))
    texts = kept(kept(one).withColumn("node", F.monotonically_increasing_id()))  # numbered once, then read as they are

    every = texts.select("node", F.explode("_bands").alias("_bucket"))
    shared = kept(every.groupBy("_bucket").agg(F.count("*").alias("_n")).where("_n > 1"))
    met = kept(every.join(shared, "_bucket"))
    wanted = met.select("node").distinct().join(texts.select("node", "_md5", "_doc"), "node")
    have = hashed.select(F.col("_md5"), F.col("_doc"), "_text")
    same = (have["_md5"] == wanted["_md5"]) & have["_doc"].eqNullSafe(wanted["_doc"])
    store = written(have.join(wanted, same).select("node", "_text").dropDuplicates(["node"]), "texts")
    sketches = kept(store.mapInArrow(_sketcher(size), "node long, _size long, _bits array<long>, _beyond long"))
    # texts that meet many others come first: the source of a group of copies is closer to them than they are to each other
    order = met.groupBy("node").agg((-F.sum("_n")).alias("_w")).join(sketches.select("node", "_size"), "node")
    buckets = kept(met.select("_bucket", "node").join(kept(order), "node"))

    tested = _Grown(df.sparkSession.createDataFrame([], "pivot long, node long"), "tested")
    links = _Grown(df.sparkSession.createDataFrame([], "a long, b long, similarity double"), "links")
    roots = None
    for heads_each in (*HEADS, None):
        seen = buckets.withColumn("root", F.col("node")) if roots is None else buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = seen.groupBy("_bucket").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo != _hi")
        open_ = kept(seen.join(kept(apart.select("_bucket")), "_bucket"))
        if open_.isEmpty():
            break
        if heads_each:
            # the first texts of every bucket; Spark keeps no more of a bucket than these before it moves rows
            first = W.partitionBy("_bucket").orderBy("_w", "node")
            heads = kept(open_.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= heads_each).drop("_r"))
            rows, possible = open_, f"least(a._size, b._size) >= {similarity} * greatest(a._size, b._size) - 1e-6"
        else:
            heads = rows = open_.join(sketches.drop("_size"), "node")
            possible = f"{_most_common()} * {1 + similarity} >= {similarity} * (a._size + b._size) - 1e-6"
        after = "a._bucket = b._bucket and b.root != a.root and (b._w > a._w or (b._w = a._w and b.node > a.node))"
        pairs = heads.alias("a").join(rows.alias("b"), F.expr(f"{after} and {possible}"))
        pairs = pairs.select(F.col("a.node").alias("pivot"), F.col("b.node").alias("node")).distinct()
        if tested.folders:
            pairs = pairs.join(tested.rows(), ["pivot", "node"], "left_anti")
        pairs = tested.add(pairs)
        if not pairs.isEmpty():
            found = links.add(_compared(pairs, store, size, similarity))
            if not found.isEmpty():
                roots = _joined(roots, found)
        if heads_each:
            used = heads.select("_bucket", F.col("node"))
            buckets = kept(open_.drop("root").join(used, ["_bucket", "node"], "left_anti"))
    if roots is None:
        roots = df.sparkSession.createDataFrame([], "node long, root long")
    rooted = texts.join(roots, "node", "left").select("_md5", "_doc", F.coalesce("root", "node").alias("root"))
    smallest = kept(rooted.groupBy("root").agg(F.min("_doc").alias("class_id")))
    return rooted.join(smallest, "root").select("_md5", "_doc", "class_id", "root"), links.rows()


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """key and class_id of every row of ``df``; other columns are left out. See ``near_duplicates``."""
    texts, _ = near_duplicates(df, key, text, **how)
    rows = df.select(F.col(key), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_md5"))
    return rows.join(kept(texts).select("_md5", "class_id"), "_md5").select(key, "class_id")


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each class: that of the smallest key (of a null key, if all are null), with the columns of ``df``.

    Of rows with the same key and text any one stays; they are equal but for other columns.
    """
    texts, _ = near_duplicates(df, key, text, **how)
    heads = texts.where(F.col("_doc").eqNullSafe(F.col("class_id")))
    # two texts of one class may share their smallest key, if keys repeat: one of them stays
    heads = heads.groupBy("root").agg(F.min(F.struct(F.col("_md5").alias("m"), F.col("class_id").alias("k"))).alias("_h"))
    heads = kept(heads.select(F.col("_h.m").alias("_head_md5"), F.col("_h.k").alias("_head")))
    named = df.select(F.struct(*df.columns).alias("_row"), F.col(key).cast("long").alias("_doc"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_md5"))
    first = named.join(heads, (F.col("_md5") == F.col("_head_md5")) & F.col("_doc").eqNullSafe(F.col("_head")))
    return first.dropDuplicates(["_md5", "_doc"]).select("_row.*")
