"""The best documents of every item by weighted terms, searched in trees of documents that share their frequent terms.

1. Restricted vectors. One pass over the texts keeps of each document the terms that some item holds, with their counts, and its
   length. Weights and lengths need four kinds of totals, which are aggregates over those rows.
2. Document FP-trees. A task takes its vectors in shards. Terms are ordered by the number of documents that hold them, the most
   frequent first, and documents whose vectors begin alike share the path of those terms. Small subtrees side by side are one leaf.
3. Bounds. A node knows the largest count of every term and the smallest length factor below it. A score grows with counts
   and falls with length, so the node's own score is at least that of any document below.
4. Search. Depth first, the most promising child first, with one threshold per item: its k-th best score so far in the task. An item
   leaves the walk at a node whose bound is below its threshold; leaves are scored exactly, by whole numbers.

Items come in blocks of bounded size, and every block meets all documents; no pair of item and document is ever a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewall.llm import arrays as A
from tidewall.llm.store import kept, written

BLOCK_TERMS = 100_000  # terms of the items that are searched together, on average
SHARD = 8192  # documents of a tree
LEAF = 64  # documents of a leaf
TASK_GROUPS = 64  # lists of tasks that are merged first
SCALE, TF, LENGTH = 1_000_000_000, 1000, 20
GAPS = np.ones(256, bool)
GAPS[np.r_[48:58, 65:91, 97:123, 128:256]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VECTORS = "doc_id long, n long, term array<int>, tf array<int>"
FOUND = "item long, doc_id long, score long, _task int"


def terms(column: pa.Array, most: int = A.CHUNK) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """Runs of letters, digits and all that is not ASCII, A to Z lowered: ranges of texts (lo, hi), their terms, each text's first term."""
    data, offsets = A.text_buffers(column)
    for lo, hi in A.chunks(offsets, most):
        part, where = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = A.words(part, where, GAPS)
        at = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
        inside = LOWER[part[~GAPS[part]]]
        yield lo, hi, pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(inside)]), first


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, found, first in terms(batch.column("text")):
            item = np.repeat(batch.column("item").to_numpy()[lo:hi], np.diff(first))
            yield pa.RecordBatch.from_arrays([pa.array(item), found.cast(pa.binary())], names=["item", "term"])


def _restricted(vocabulary: list[bytes]):
    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size = pa.array(vocabulary, pa.large_binary()), max(len(vocabulary), 1)
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, found, first in terms(batch.column("text")):
                slot = pc.index_in(found, value_set=known)
                hit = np.flatnonzero(slot.is_valid().to_numpy(zero_copy_only=False))
                text = np.repeat(np.arange(hi - lo), np.diff(first))[hit]
                cell, tf = np.unique(text * size + slot.take(pa.array(hit)).to_numpy(zero_copy_only=False), return_counts=True)
                start = pa.array(np.searchsorted(cell, np.arange(hi - lo + 1) * size), pa.int32())
                lists = [pa.ListArray.from_arrays(start, pa.array(x, pa.int32())) for x in (cell % size, tf)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(np.diff(first)), *lists], names=["doc_id", "n", "term", "tf"])

    return restrict


@dataclass
class Query:
    """The items of a block: their numbers, and for each its terms (from ``start`` on) with weights."""

    item: np.ndarray
    start: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    order: np.ndarray  # of a term: its place among all by falling number of documents

    def scores(self, parts: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Sums over the terms of the given items. parts: what every term adds per unit of weight, one row per document or node."""
        size = (self.start[1:] - self.start[:-1])[items]
        upto = np.cumsum(size)
        at = np.repeat(self.start[items] - (upto - size), size) + np.arange(int(upto[-1]))
        return np.add.reduceat(parts[:, self.term[at]] * self.weight[at], upto - size, axis=1)


def term_part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (SCALE * tf) // (TF * tf + LENGTH * m)


class Tree:
    """Documents in the order of their paths, as leaves and inner nodes with bounds. Children have larger numbers than their node."""

    def __init__(self, query: Query, start: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, leaf: int = LEAF):
        n, n_terms = len(m), len(query.order)
        owner = np.repeat(np.arange(n), np.diff(start))
        place = query.order[term]
        by_place = np.lexsort((place, owner))
        paths = place[by_place].astype(">u4")
        keys = [paths[a:b].tobytes() for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
        self.docs = np.array(sorted(range(n), key=keys.__getitem__), np.int64)
        shared = self._shared([keys[i] for i in self.docs])
        self.leaves: dict[int, tuple[int, int]] = {}
        self.children: dict[int, list[int]] = {}
        self._grow(shared, leaf)
        # where each document lies, and what every node knows of the documents below it
        rank = np.empty(n, np.int64)
        rank[self.docs] = np.arange(n)
        leaf_of = np.empty(n, np.int64)
        n_nodes = len(self.leaves) + len(self.children)
        self.m = np.full(n_nodes, np.iinfo(np.int64).max)
        for node, (lo, hi) in self.leaves.items():
            leaf_of[lo:hi] = node
            self.m[node] = m[self.docs[lo:hi]].min()
        most = np.zeros((n_nodes, n_terms), np.int32)
        np.maximum.at(most.reshape(-1), leaf_of[rank[owner]] * n_terms + term, tf)
        for node in sorted(self.children, reverse=True):
            below = self.children[node]
            most[node], self.m[node] = most[below].max(axis=0), self.m[below].min()
        self.bounds = query.scores(term_part(most, self.m[:, None]), np.arange(len(query.item)))

    @staticmethod
    def _shared(keys: list[bytes]) -> np.ndarray:
        """Terms that a document's path shares with the path before it."""
        out = np.zeros(len(keys), np.int64)
        for i in range(1, len(keys)):
            a, b = keys[i - 1], keys[i]
            if a == b:
                out[i] = len(a) // 4
            elif a[:4] == b[:4]:
                size = min(len(a), len(b))
                apart = np.frombuffer(a, ">u4", size // 4) != np.frombuffer(b, ">u4", size // 4)
                out[i] = apart.argmax() if apart.any() else size // 4
        return out

    def _grow(self, shared: np.ndarray, leaf: int) -> None:
        """Splits the documents where their paths part, until what is left fits a leaf."""
        todo, number = [(0, len(shared), -1)], 0
        while todo:
            lo, hi, above = todo.pop()
            node, number = number, number + 1
            if above >= 0:
                self.children[above].append(node)
            if hi - lo <= leaf:
                self.leaves[node] = (lo, hi)
                continue
            self.children[node] = []
            inner = shared[lo + 1 : hi]
            cuts = [lo, *(np.flatnonzero(inner == inner.min()) + lo + 1).tolist(), hi]
            begin = lo
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - begin > leaf and a > begin:  # the small subtrees before this one make a leaf
                    todo.append((begin, a, node))
                    begin = a
                if b - a > leaf:
                    todo.append((a, b, node))
                    begin = b
            if begin < hi:
                todo.append((begin, hi, node))


class Best:
    """The k best documents of every item so far: highest score, then smallest key, null keys last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.score = [np.zeros(0, np.int64)] * n_items
        self.key = [np.zeros(0, object)] * n_items
        self.least = np.ones(n_items, np.int64)  # lower scores have no chance

    def add(self, i: int, score: np.ndarray, key: np.ndarray) -> None:
        score, key = np.r_[self.score[i], score], np.concatenate([self.key[i], key])
        if len(score) > self.k:
            missing = np.array([x is None for x in key])
            order = np.lexsort((np.where(missing, 0, key).astype(np.int64), missing, -score))[: self.k]
            score, key = score[order], key[order]
        self.score[i], self.key[i] = score, key
        if len(score) == self.k:
            self.least[i] = score.min()


def search(tree: Tree, query: Query, best: Best, keys: np.ndarray, start: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> int:
    """Walks one tree for all items; returns the number of documents scored, counted once per item."""
    n_terms, scored = len(query.order), 0
    stack = [(0, np.arange(len(query.item)))]
    while stack:
        node, items = stack.pop()
        items = items[tree.bounds[node, items] >= best.least[items]]
        if not len(items):
            continue
        if node in tree.leaves:
            docs = tree.docs[slice(*tree.leaves[node])]
            size = start[docs + 1] - start[docs]
            upto = np.cumsum(size)
            at = np.repeat(start[docs] - (upto - size), size) + np.arange(int(upto[-1]))
            parts = np.zeros((len(docs), n_terms), np.int64)
            parts[np.repeat(np.arange(len(docs)), size), term[at]] = term_part(tf[at], np.repeat(m[docs], size))
            scores = query.scores(parts, items)
            scored += scores.size
            good = scores >= best.least[items]
            for j in np.flatnonzero(good.any(axis=0)).tolist():
                pick = good[:, j]
                best.add(int(items[j]), scores[pick, j], keys[docs[pick]])
        else:
            below = np.array(tree.children[node])
            promise = tree.bounds[np.ix_(below, items)].max(axis=1)
            stack.extend((int(below[j]), items) for j in np.argsort(promise))
    return scored


def _searcher(query: Query, k: int, n_docs: int, n_terms: int, shard: int, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(query.item), k)
        for batch in batches:
            for lo in range(0, batch.num_rows, shard):
                part = batch.slice(lo, shard)
                listed, tf = part.column("term"), part.column("tf").flatten().to_numpy()
                start = listed.offsets.to_numpy().astype(np.int64)
                start = start - start[0]
                n = part.column("n").to_numpy()
                m = 50 + (50 * n * n_docs) // n_terms
                term = listed.flatten().to_numpy()
                keys = np.array(part.column("doc_id").to_pylist(), object)
                search(Tree(query, start, term, tf, m, leaf), query, best, keys, start, term, tf, m)
        n = [len(x) for x in best.score]
        if sum(n):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(query.item, n), pa.int64()), pa.array(np.concatenate(best.key).tolist(), pa.int64()),
                    pa.array(np.concatenate(best.score), pa.int64()), pa.array([TaskContext.get().partitionId()] * sum(n), pa.int32()),
                ],
                names=["item", "doc_id", "score", "_task"],
            )

    return run


def _best_of(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    first = W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def rank(
    docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    block_terms: int = BLOCK_TERMS, shard: int = SHARD, leaf: int = LEAF,
) -> DataFrame:
    """item, rank (from 1), doc_id and score of the k best documents of every row of ``items``, of all if fewer score above 0.

    Equal scores go by ascending key, null keys last. A null text has no term: such a document is never found and counts in no total,
    such an item has no row. Repeated rows are documents and items of their own; repeated items share the name, not the ranks.
    Only the named columns are read, so none can clash. An empty table on either side gives no row. The driver holds one block of items
    (``block_terms`` terms on average, at least one item) with the number of documents of its terms.
    """
    spark = docs.sparkSession
    own = items.select(F.col(item).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    numbered = kept(kept(own, "items").withColumn("item", F.monotonically_increasing_id()), "items")
    held = kept(numbered.mapInArrow(_item_terms, "item long, term binary").distinct(), "item_terms")
    blocks = max(1, math.ceil(held.count() / block_terms))
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = None
    for b in range(blocks):
        pairs = held.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item", "term").collect()
        if not pairs:
            continue
        vocabulary = sorted({bytes(p.term) for p in pairs})
        number = {t: i for i, t in enumerate(vocabulary)}
        vectors = written(texts.mapInArrow(_restricted(vocabulary), VECTORS).where("n > 0"), "vectors")
        n_docs, n_terms = vectors.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        counts = vectors.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
        df = np.zeros(len(vocabulary), np.int64)
        df[[r.term for r in counts]] = [r.df for r in counts]
        weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()]
        order = np.empty(len(df), np.int64)
        order[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
        term = np.array([number[bytes(p.term)] for p in pairs])
        which, start = np.unique([p.item for p in pairs], return_index=True)
        query = Query(which, np.r_[start, len(pairs)], term, np.array(weight, np.int64)[term], order)
        part = vectors.where(F.size("term") > 0).mapInArrow(_searcher(query, k, n_docs, n_terms, shard, leaf), FOUND)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    some = _best_of(found.withColumn("_group", F.pmod("_task", F.lit(TASK_GROUPS))), ["item", "_group"], k).drop("rank", "_group")
    ranked = _best_of(some, ["item"], k)
    return ranked.join(numbered.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
