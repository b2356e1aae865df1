"""What filters remove alone, together and in every order, over a sparse document-term matrix.

1. Blocks. A task turns the texts of a block into a small matrix in compressed rows: the block's own words, and for each row the
   words it holds and how often. Both are written as many rows of bounded size: shards of the matrix, and stretches of the words.
2. Dictionary. The distinct words of all blocks meet sorted, which numbers them for the whole table, and the numbers of a block's
   words pass a task just ahead of its shards, one after the other; a text is never moved, and no task holds a block as a whole.
3. Row sums are the words of a document, nonzero entries its different words. With the other flags they make a mask per
   document, and everything that is asked of orders of filters follows from the number of documents of each mask.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewall.llm import arrays as A
from tidewall.llm.store import kept, written

BLOCK = 16_000_000  # bytes of text whose words share a dictionary before there is a global one
SHARD = 1_000_000  # bytes of text in a shard
STRETCH = 16_384  # words in a row
HELD = 500_000  # numbers of words that are handed out together
GROUP = 16_000_000  # bytes of rows that are written, and so read again, together
ROW = "doc_id: bigint, part: string, text_id: string, n_upper: int, n_chars: int, n_symbols: int"
MATRIX = f"docs array<struct<{ROW}>>, row_start array<int>, col array<int>, times array<int>"
BLOCKS = f"block long, shard long, {MATRIX}, first int, word array<binary>"
SHARDS = f"block long, docs array<struct<{ROW}>>, row_start array<int>, col array<long>, times array<int>"
COUNTS = f"{ROW.replace(':', '')}, n_words long, n_distinct long"

# --- fixed values: the limits of the filters A to D ---
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_UPPER_PERCENT = 5
SYMBOLS = "#$%&*|"
# --- end of fixed values ---

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS.encode())] = True


def _listed(values: pa.Array) -> pa.Array:
    """All values as the one list of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marked bytes of every text."""
    return np.diff(np.r_[0, np.cumsum(marks, dtype=np.int64)][offsets])


def _shard(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Documents, row_start, col and times of the texts, and the words that col counts from 0."""
    n = len(offsets) - 1
    starts, ends, first = A.words(data, offsets)
    length = ends - starts
    inside = data[~A.IS_SPACE[data]]
    at = np.r_[0, np.cumsum(length)].astype(np.int64)
    tokens = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(inside)])
    coded = tokens.dictionary_encode()
    n_words = max(len(coded.dictionary), 1)
    cell = np.repeat(np.arange(n), np.diff(first)) * n_words + coded.indices.to_numpy(zero_copy_only=False)
    cell, times = np.unique(cell, return_counts=True)
    # copies, since a slice would keep the whole batch until the block is full
    own = batch.select(["doc_id", "part", "text_id"]).take(pa.array(np.arange(n)))
    docs = pa.StructArray.from_arrays(
        [
            *own.columns,
            pa.array(_per_text((data >= 65) & (data <= 90), offsets), pa.int32()),
            pa.array(_per_text((data & 0xC0) != 0x80, offsets), pa.int32()),
            pa.array(_per_text(IS_SYMBOL[data], offsets), pa.int32()),
        ],
        ["doc_id", "part", "text_id", "n_upper", "n_chars", "n_symbols"],
    )
    row_start = np.searchsorted(cell, np.arange(n + 1) * n_words).astype(np.int32)
    return docs, row_start, (cell % n_words).astype(np.int32), times.astype(np.int32), coded.dictionary


def _rows_of_block(number: int, shards: list) -> Iterator[pa.RecordBatch]:
    """The shards of a block with the numbers of its words, and its words in stretches; ``number``: of the first shard and of the block."""
    names = ["block", "shard", "docs", "row_start", "col", "times", "first", "word"]
    block = pa.array([number], pa.int64())
    coded = pa.concat_arrays([x[-1] for x in shards]).dictionary_encode()
    of_block, lo = coded.indices.to_numpy(zero_copy_only=False), 0
    for i, (docs, row_start, col, times, own) in enumerate(shards):
        col = of_block[lo : lo + len(own)][col]
        lo += len(own)
        lists = [_listed(docs), _listed(pa.array(row_start)), _listed(pa.array(col, pa.int32())), _listed(pa.array(times))]
        none = [pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.binary()))]
        yield pa.RecordBatch.from_arrays([block, pa.array([number + i], pa.int64()), *lists, *none], names=names)
    word, whole = coded.dictionary, pa.list_(pa.int32())
    for first in range(0, len(word), STRETCH):
        none = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(docs.type)), *(pa.nulls(1, whole) for _ in range(3))]
        some = [pa.array([first], pa.int32()), _listed(word.slice(first, STRETCH).cast(pa.binary()))]
        yield pa.RecordBatch.from_arrays([block, *none, *some], names=names)


def _blocks(most: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, shards = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            data, offsets = A.text_buffers(batch.column("text"))
            for lo, hi in A.chunks(offsets, min(most, SHARD)):
                n = int(offsets[hi] - offsets[lo])
                if shards and size + n > most:
                    yield from _rows_of_block(number, shards)
                    number, size, shards = number + len(shards), 0, []
                shards.append(_shard(batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
                size += n
        if shards:
            yield from _rows_of_block(number, shards)

    return encode


def _by_block(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    block, at, ids = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(block, kind="stable")
    which, start = np.unique(block[order], return_index=True)
    start = pa.array(np.r_[start, len(order)], pa.int32())
    lists = [pa.ListArray.from_arrays(start, pa.array(x[order])) for x in (at, ids)]
    return pa.RecordBatch.from_arrays([pa.array(which), *lists], names=["block", "at", "id"])


def _number_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of sorted words, handed out as lists to the blocks that hold them."""
    number, last, held, n = (TaskContext.get().partitionId() << 33) - 1, None, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        word = batch.column("word")
        new = np.r_[word[0].as_py() != last, pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False)]
        ids = number + np.cumsum(new)
        number, last = int(ids[-1]), word[len(word) - 1].as_py()
        held.append((batch.column("block").to_numpy().copy(), batch.column("at").to_numpy().copy(), ids))
        n += len(ids)
        if n >= HELD:
            yield _by_block(held)
            held, n = [], 0
    if held:
        yield _by_block(held)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards with the global numbers of their words in place of the block's own. Of a block, the numbers come first."""
    block, held, number = None, [], None
    for batch in batches:
        of, is_shard = batch.column("block").to_numpy(), batch.column("shard").is_valid().to_numpy(zero_copy_only=False)
        # runs of numbers of a block, and single shards
        edges = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | is_shard[1:] | is_shard[:-1], True])
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if of[lo] != block:
                block, held, number = of[lo], [], None
            row = batch.slice(lo, hi - lo)
            if not is_shard[lo]:
                held.append([row.column(c).flatten().to_numpy(zero_copy_only=False).copy() for c in ("at", "id")])
                continue
            if number is None:
                number = np.empty(sum(len(at) for at, _ in held), np.int64)
                for at, ids in held:
                    number[at] = ids
                held = []
            new = pa.array(number[row.column("col").flatten().to_numpy(zero_copy_only=False)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [row.column("shard"), row.column("docs"), row.column("row_start"), _listed(new), row.column("times")],
                names=["block", "docs", "row_start", "col", "times"],
            )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _row_counts(_numbered(batches))


def _row_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row sums and nonzero entries of every row of the shards."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            docs = row.column("docs").flatten()
            start = row.column("row_start").flatten().to_numpy()
            total = np.r_[0, np.cumsum(row.column("times").flatten().to_numpy(), dtype=np.int64)]
            # a word is one column of a row, so entries of a row have different numbers
            yield pa.RecordBatch.from_arrays(
                [*docs.flatten(), pa.array(np.diff(total[start])), pa.array(np.diff(start).astype(np.int64))],
                names=[*(f.name for f in docs.type), "n_words", "n_distinct"],
            )


def _matrix(df: DataFrame, key: str, text: str, part: str | None, block: int) -> tuple[DataFrame, DataFrame]:
    """Shards, each block's behind the numbers of its words (at, id), and the dictionary."""
    own = F.coalesce(F.col(text), F.lit(""))
    named = df.select(
        F.col(key).cast("long").alias("doc_id"), (F.coalesce(F.col(part).cast("string"), F.lit("")) if part else F.lit("")).alias("part"),
        F.sha2(own, 256).alias("text_id"), own.alias("text"),
    )
    blocks = written(named.mapInArrow(_blocks(block), BLOCKS), "blocks", GROUP)
    listed = blocks.where("word is not null").select("block", "first", F.posexplode("word").alias("i", "word"))
    words = listed.select("block", (F.col("first") + F.col("i")).alias("at"), "word")
    ids = words.repartition("word").sortWithinPartitions("word").mapInArrow(_number_words, "block long, at array<int>, id array<long>")
    numbers = kept(ids, "numbers")
    shards = blocks.where("shard is not null").drop("first", "word")
    met = numbers.unionByName(shards, allowMissingColumns=True).repartition("block")
    numbered = met.sortWithinPartitions("block", F.col("shard").asc_nulls_first())
    each = F.explode(F.arrays_zip("at", "id"))
    placed = numbers.select("block", each.alias("x")).select("block", "x.at", "x.id")
    return numbered, placed.join(words, ["block", "at"]).select("word", "id").distinct()


def document_terms(df: DataFrame, key: str = "doc_id", text: str = "text", part: str | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The document-term matrix of all texts: (shards, dictionary).

    ``shards``: block, docs (key, part, SHA-256 of the text and counts of characters, one entry per row of the shard),
    row_start, col (numbers of words), times: compressed rows. ``dictionary``: word (UTF-8), id.
    Words are runs without ASCII white space, case kept. A null text is empty; empty texts are rows without entries. Repeated rows are
    rows of their own, null and repeated keys stay. A shard holds 1 MB of text and ``block`` bytes at most, or one longer text; its number
    is its own. Other columns of ``df`` are not read, so none can clash. An empty table gives no shard and no word.
    """
    numbered, dictionary = _matrix(df, key, text, part, block)
    return numbered.mapInArrow(_numbered, SHARDS), dictionary


def row_counts(shards: DataFrame) -> DataFrame:
    """doc_id, part, text_id, n_upper, n_chars, n_symbols, n_words and n_distinct of every row of the matrix."""
    return shards.mapInArrow(_row_counts, COUNTS)


def repeats_of_earlier(rows: DataFrame, key: str = "doc_id", same: str = "text_id") -> DataFrame:
    """Adds ``repeated``: whether a smaller key has the same text. A null key comes before and after none.

    Only texts of several rows travel in the second step, and the side with the copies is one that Spark can split.
    """
    first = rows.groupBy(same).agg(F.min(key).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    joined = rows.join(kept(first, "firsts"), same, "left")
    return joined.withColumn("repeated", F.coalesce(F.col(key) > F.col("_first"), F.lit(False))).drop("_first")


def flagged(df: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", block: int = BLOCK) -> DataFrame:
    """doc_id, part and the failures A to E of every row: few words, few different words, capitals, symbols, an earlier equal text.

    Nulls, repeats and empty tables as in ``document_terms`` and ``repeats_of_earlier``; a null part is the empty one.
    """
    numbered, _ = _matrix(df, key, text, part, block)
    rows = repeats_of_earlier(kept(numbered.mapInArrow(_counted, COUNTS), "rows"))  # shards and their sums in one task
    return rows.select(
        "doc_id", "part",
        (F.col("n_words") < MIN_WORDS).alias("A"),
        (100 * F.col("n_distinct") < MIN_DISTINCT_PERCENT * F.col("n_words")).alias("B"),
        (100 * F.col("n_upper").cast("long") > MAX_UPPER_PERCENT * F.col("n_chars").cast("long")).alias("C"),
        (F.col("n_symbols") > 0).alias("D"),
        F.col("repeated").alias("E"),
    )


def interactions(rows: DataFrame, filters: str, part: str, good: Column, toxic: Column) -> DataFrame:
    """Every order of ``filters`` (names of boolean columns, one letter each) applied step by step, per value of ``part``.

    One row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (what a step's filter
    removes, summed over all orders). What crosses the network is one row per part and mask of failures. A null flag
    is no failure. At most seven filters, since orders are as many as their permutations. An empty table gives no row.
    """
    if not 0 < len(set(filters)) == len(filters) <= 7:
        raise ValueError("one to seven different filters")
    bits = {c: 1 << i for i, c in enumerate(filters)}
    mask = sum((F.when(F.col(c), F.lit(b)).otherwise(F.lit(0)) for c, b in bits.items()), F.lit(0))
    one = rows.select(F.col(part).alias("part"), mask.alias("mask"), F.coalesce(good, F.lit(False)).alias("good"), F.coalesce(toxic, F.lit(False)).alias("toxic"))
    masks = one.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))
    # what each step of each order needs: its filter and the filters before it
    steps = [
        {"filter_order": "".join(p), "step": i + 1, "bit": bits[p[i]], "before": sum(bits[c] for c in p[:i])}
        for p in permutations(filters) for i in range(len(filters))
    ]
    every = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    steps = parts.withColumn("s", F.explode(every)).select("part", "m", "s.*")

    def total(value, where) -> Column:
        return F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.when(where(x["mask"]), value(x)).otherwise(F.lit(0)).cast("long"))

    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    earlier = lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = lambda m: fails(m) & ~earlier(m)
    n_orders = factorial(len(filters))
    return steps.select(
        "part", "filter_order", "step",
        total(lambda x: x["n"], lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        total(lambda x: x["n"], removed).alias("removed"),
        total(lambda x: x["n"], lambda m: fails(m) & earlier(m)).alias("redundant"),
        total(lambda x: x["n"], lambda m: m == F.col("bit")).alias("unique_fails"),
        total(lambda x: x["good"], removed).alias("good_lost"),
        total(lambda x: x["toxic"], removed).alias("toxic_lost"),
        # of the orders of a document's failing filters, each comes first equally often
        total(lambda x: x["n"] * (F.lit(n_orders) / F.greatest(F.bit_count(x["mask"]), F.lit(1))).cast("long"), fails).alias("shapley"),
    )


def audit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", block: int = BLOCK) -> DataFrame:
    """The five filters over all rows of ``df``, by part; ``labels`` (doc_id, quality, toxic) says what is lost with them.

    Several labels of a document count once, if one of them says so; labels without a document and null keys count for nothing.
    """
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
    rows = flagged(df, key, text, part, block).join(kept(known, "labels"), "doc_id", "left")
    return interactions(rows, "ABCDE", "part", F.col("_good"), F.col("_toxic"))
