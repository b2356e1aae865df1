"""Nearest neighbours by a hash-prefix forest.

Each tree is a sorted array of hash strings (signs of random projections). A query descends every tree to its longest
prefix match and then ascends all trees together, one bit at a time, until the ranges of rows that share the
prefix hold enough candidates. The rows are dealt into blocks of bounded size, each with a
forest of its own; the stated query set is sent to every block, and the best of all blocks are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BLOCK_ROWS = 32_768
TREES = 48
BITS = 32
SHARE = 0.75  # of a block's rows; candidates are counted once per tree that offers them
QUERY_BATCH = 256


class Forest:
    """Sorted hash strings of the rows of one block, one array per tree."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, seed: int = 11):
        self.vectors = vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.planes = np.random.Generator(np.random.PCG64(seed)).standard_normal((vectors.shape[1], trees * BITS)).astype(np.float32)
        self.trees = trees
        keys = self._strings(vectors)
        self.order = np.argsort(keys, axis=0, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=0)

    def _strings(self, vectors: np.ndarray) -> np.ndarray:
        """Hash strings as numbers whose first bit is the highest: rows x trees."""
        out = np.empty((len(vectors), self.trees), np.uint32)
        for lo in range(0, len(vectors), 2048):
            part = vectors[lo : lo + 2048]
            scale = np.maximum(np.abs(part).max(axis=1, keepdims=True), 1e-300)
            bits = (part / scale).astype(np.float32) @ self.planes > 0
            out[lo : lo + 2048] = np.packbits(bits.reshape(len(part), self.trees, BITS), axis=2).view(">u4")[:, :, 0]
        return out

    def _ranges(self, strings: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each tree holds the rows that share the first ``level`` bits with each query."""
        low = (1 << (BITS - level)) - 1
        first = strings & np.uint32(0xFFFFFFFF ^ low)
        last = strings | np.uint32(low)
        lo = np.empty(strings.shape, np.int64)
        hi = np.empty(strings.shape, np.int64)
        for t in range(self.trees):
            lo[:, t] = np.searchsorted(self.keys[:, t], first[:, t], "left")
            hi[:, t] = np.searchsorted(self.keys[:, t], last[:, t], "right")
        return lo, hi

    def candidates(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """Rows of the block to compare with each query."""
        strings = self._strings(queries)
        n = len(queries)
        lo, hi = self._ranges(strings, BITS)  # the descent; equal strings match in full
        open_ = np.flatnonzero((hi - lo).sum(axis=1) < enough)
        for level in range(BITS - 1, -1, -1):  # the ascent of all trees together
            if not len(open_):
                break
            lo[open_], hi[open_] = self._ranges(strings[open_], level)
            open_ = open_[(hi[open_] - lo[open_]).sum(axis=1) < enough]
        seen = np.zeros(len(self.vectors), bool)
        for i in range(n):
            seen[:] = False
            for t in range(self.trees):
                seen[self.order[lo[i, t] : hi[i, t], t]] = True
            yield np.flatnonzero(seen)


def cosines(vectors: np.ndarray, norms: np.ndarray, query: np.ndarray, query_norm: float) -> np.ndarray:
    """Row sums are taken the same way for every row, so equal vectors get equal scores."""
    return np.ascontiguousarray(vectors * query).sum(axis=1) / (norms * query_norm)


def _searcher(k: int, trees: int, share: float):
    out_names = ["_query", "query_id", "vec_id", "score"]

    def answer(forests: dict, batch: list) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, list] = {}
        for row in batch:
            by_size.setdefault(len(row[2]), []).append(row)
        for size, rows in by_size.items():
            if size not in forests:
                continue
            ids, forest = forests[size]
            queries = np.array([r[2] for r in rows], np.float64)
            found: list[tuple] = []
            for (key, own, _), q, near in zip(rows, queries, forest.candidates(queries, max(int(share * len(ids)), trees * (k + 1))), strict=True):
                near = near[ids[near] != own]
                score = cosines(forest.vectors[near], forest.norms[near], q, float(np.sqrt((q * q).sum())))
                best = np.lexsort((ids[near], -score))[:k]
                found += [(key, own, int(ids[near[b]]), float(score[b])) for b in best]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=out_names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, forests, waiting = None, [], None, []
        for batch in batches:
            b = batch.column("_block").to_numpy()
            is_query = batch.column("_kind").to_numpy()
            key, ids = batch.column("_key").to_numpy(), batch.column("vec_id").to_numpy()
            flat = batch.column("_vector")
            values, at = flat.flatten().to_numpy(), np.r_[0, np.cumsum(flat.value_lengths().to_numpy())]
            for i in range(len(b)):
                if b[i] != block:
                    if waiting:
                        yield from answer(forests, waiting)
                    block, rows, forests, waiting = b[i], [], None, []
                vector = values[at[i] : at[i + 1]]
                if not is_query[i]:
                    rows.append((ids[i], vector))
                    continue
                if forests is None:
                    forests = {}
                    for size in {len(v) for _, v in rows}:
                        pick = [r for r in rows if len(r[1]) == size]
                        forests[size] = (np.array([r[0] for r in pick]), Forest(np.array([r[1] for r in pick], np.float64), trees))
                    rows = []
                waiting.append((int(key[i]), int(ids[i]), vector))
                if len(waiting) >= QUERY_BATCH:
                    yield from answer(forests, waiting)
                    waiting = []
        if waiting:
            yield from answer(forests or {}, waiting)

    return search


def searchable(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows that take part: an id and a vector that is not null, not empty, not zero, and holds finite numbers only."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).where(finite & some).select(
        F.col(id_col).cast("long").alias("vec_id"), v.alias("_vector")
    )


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, trees: int = TREES, share: float = SHARE, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows that the forest finds for every query row: query_id, rank (from 1), vec_id, score.

    Score: cosine in double precision on the vectors as given; ties go to the smaller vec_id. A row with
    the query's own id is no candidate. Rows and queries that ``searchable`` leaves out take no part, and a vector is
    compared with vectors of its own length only. Repeated ids among rows are rows of their own;
    repeated queries are answered each. Other columns are left out. Fewer rows than ``k``: all of them. ``share`` sets
    the candidates, and so recall, against time.
    """
    rows = searchable(rows, id_col, vector)
    queries = searchable(queries, id_col, vector).withColumn("_key", F.monotonically_increasing_id())
    spark = rows.sparkSession
    n_blocks = max(2 * spark.sparkContext.defaultParallelism, -(-rows.count() // block_rows))
    dealt = rows.select(
        (F.monotonically_increasing_id() % n_blocks).cast("int").alias("_block"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_key"), "vec_id", "_vector"
    )
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_block"), F.lit(1).alias("_kind"), "_key", "vec_id", "_vector")
    blocks = dealt.unionByName(asked).repartition(n_blocks, "_block").sortWithinPartitions("_block", "_kind", "vec_id")
    found = blocks.mapInArrow(_searcher(k, trees, share), "_query long, query_id long, vec_id long, score double")
    best = W.partitionBy("_query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
