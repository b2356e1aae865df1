"""Packing of token sequences by a configuration linear program over the histogram of lengths.

A configuration is a multiset of lengths that fits one sequence; the program covers the pieces of every length by as few
configurations as it can. Only the histogram, at most ``capacity`` numbers, reaches the driver. There the program is solved by
multiplicative weights: a length weighs less the more of it is covered, and drops out once it is covered in full. Weights over
counts are prices; a knapsack dynamic program finds the dearest configurations, which grow together until none of them is near the
dearest any more, and the prices of that moment bound the program's value from below. The fractional shares, scaled so that no length is
covered beyond its pieces, are rounded down to whole sequences, and what they leave is a smaller program of the same
kind. Pieces left in the end are placed best-fit into the gaps and into new sequences; where plain best-fit
packs all pieces in fewer sequences, its packing is taken.

The plan is a table of runs (length, rank) -> (sequence, offset), whose size does not depend on the number of documents; the cluster
ranks the pieces of each length by prefix sums over partitions and looks them up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewall.llm import arrays as A
from tidewall.llm import tokens
from tidewall.session import cut_lineage

CAPACITY = 2048
ROUNDS = 2  # programs solved, the second on what the first one left
EFFORT = 2000  # times that a length is covered in part before it drops out, over a power of the number of lengths
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass
class Plan:
    """Runs of ranks by length: piece ``rank`` of a length lies in sequence ``sequence + (rank - first)`` at ``offset``."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int
    total: int
    capacity: int
    value: float  # no more than the program's value

    @property
    def bound(self) -> int:
        """No packing has fewer sequences."""
        return max(-(-self.total // self.capacity), int(np.ceil(self.value - 1e-6)))


def _priced(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: most price within each size, and the last length used for it (0: one less suffices)."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for v in range(int(lengths[0]), capacity + 1):
        n = upto[v]
        worth = best[v - lengths[:n]] + prices[:n]
        k = worth.argmax()
        if worth[k] > best[v - 1] * (1 + 1e-12):
            best[v], last[v] = worth[k], lengths[k]
        else:
            best[v] = best[v - 1]
    return best, last


def _configuration(anchor: int, last: np.ndarray, capacity: int) -> dict[int, int]:
    """The anchor with the lengths of most price beside it."""
    config, v = {anchor: 1}, capacity - anchor
    while v > 0:
        step = int(last[v])
        if step:
            config[step] = config.get(step, 0) + 1
        v -= step or 1
    return config


def fractional(counts: dict[int, int], capacity: int = CAPACITY, effort: int = EFFORT) -> tuple[dict[tuple, float], np.ndarray, float]:
    """Shares of configurations that cover all counts, how often each length is covered at them, and a lower bound of the program's value.

    Lengths are in ascending order; a configuration is a tuple of (length, number).
    """
    lengths = np.array(sorted(counts), np.int64)
    demand = np.array([counts[k] for k in lengths.tolist()], float)
    slot = np.zeros(capacity + 1, np.int64)
    slot[lengths] = np.arange(len(lengths))
    enough = max(6.0, effort / len(lengths) ** 0.8)
    eps = min(0.5, (np.log(len(lengths) + 1) / enough) ** 0.5)
    covered, open_ = np.zeros(len(lengths)), np.ones(len(lengths), bool)
    log_weight = np.log(demand * lengths)  # the area: at first, prices are the lengths
    shares: dict[tuple, float] = {}
    bound = 0.0
    while open_.any():
        scale = log_weight[open_].max()
        weight = np.where(open_, np.exp(log_weight - scale), 0.0)
        price = weight / demand
        best, last = _priced(lengths[open_], price[open_], capacity)
        dearest = best[capacity]
        bound = max(bound, weight.sum() / dearest)
        anchors = lengths[open_ & (price + best[capacity - lengths] >= dearest * (1 - eps))].tolist()
        configs = [_configuration(k, last, capacity) for k in anchors]
        size = np.array([len(c) for c in configs])
        first = np.cumsum(size) - size
        row = slot[np.array([k for c in configs for k in c])]
        times = np.array([v for c in configs for v in c.values()], float)
        amount = np.array([counts[k] / c[k] for k, c in zip(anchors, configs, strict=True)])  # what covers the anchor alone
        grown = np.zeros(len(configs))
        while open_.any():
            weight = np.where(open_, np.exp(log_weight - scale), 0.0)
            near = np.add.reduceat((weight / demand)[row] * times, first) >= dearest * (1 - eps)
            if not near.any():
                break
            now = np.where(near, amount, 0.0)
            add = np.bincount(row, np.repeat(now, size) * times, len(lengths)) / demand
            step = 1 / add[open_].max()
            grown += step * now
            covered += step * add
            log_weight -= eps * step * add
            open_ &= covered < enough
        for config, x in zip(configs, grown.tolist(), strict=True):
            if x:
                key = tuple(sorted(config.items()))
                shares[key] = shares.get(key, 0.0) + x
    return shares, covered, bound


def _rounded(shares: dict[tuple, float], left: dict[int, int], scale: float, up: bool, fullest: bool = False) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Whole multiplicities of the configurations, the largest share (or the fullest) first, as far as there are pieces; and what is left."""
    left, chosen = dict(left), []
    fill = (lambda c: -sum(k * v for k, v in c)) if fullest else (lambda c: 0)
    for config, x in sorted(shares.items(), key=lambda c: (fill(c[0]), -c[1], c[0])):
        if not up and x * scale < 1:
            continue
        times = min(int(np.ceil(x * scale - 1e-6) if up else x * scale + 1e-6), *(left.get(k, 0) // v for k, v in config))
        if times > 0:
            chosen.append((dict(config), times))
            for k, v in config:
                left[k] -= times * v
    return chosen, {k: n for k, n in left.items() if n}


def configurations(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, effort: int = EFFORT) -> tuple[list[list[tuple[dict[int, int], int]]], list[dict[int, int]], float]:
    """Ways to round the program: configurations with whole multiplicities, the counts they leave over; and a lower bound.

    Two ways round the whole cover up at once, one rounds down what is covered nowhere twice and solves a program for the rest.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    ways: list[list[tuple[dict[int, int], int]]] = []
    rests: list[dict[int, int]] = []
    sofar: list[tuple[dict[int, int], int]] = []
    bound = 0.0
    for t in range(rounds):
        if not left or t and not sofar:
            break
        shares, covered, value = fractional(left, capacity, effort)
        bound = bound if t else value
        for fullest in (False, True):
            chosen, rest = _rounded(shares, left, 1 / covered.min(), True, fullest)
            ways.append(sofar + chosen)
            rests.append(rest)
        chosen, left = _rounded(shares, left, 1 / covered.max(), False)
        sofar = sofar + chosen
    return ways, rests, bound


def best_fit(counts: dict[int, int], gaps: dict[int, list[list[int]]], n_sequences: int, capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best-fit decreasing of the counts into runs of sequences with equal gaps, then into new ones.

    ``gaps``: free size -> runs [first sequence, number]. Returns (length, number, first sequence, offset) and the number
    of sequences. Runs are split, never listed one by one.
    """
    placed: list[tuple[int, int, int, int]] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            free = min((f for f, runs in gaps.items() if f >= length and runs), default=None)
            if free is None:
                per = max(1, capacity // length)
                n = -(-left // per)
                gaps.setdefault(capacity, []).append([n_sequences, n])
                n_sequences += n
                continue
            seq, n = gaps[free].pop()
            per = free // length
            full = min(n, left // per)
            rest = left - full * per if full < n else 0
            for j in range(per if full else 0):
                placed.append((length, full, seq, capacity - free + j * length))
            if full:
                gaps.setdefault(free - per * length, []).append([seq, full])
                left -= full * per
            if full < n and rest:
                for j in range(rest):
                    placed.append((length, 1, seq + full, capacity - free + j * length))
                gaps.setdefault(free - rest * length, []).append([seq + full, 1])
                left -= rest
                full += 1
            if full < n:
                gaps.setdefault(free, []).append([seq + full, n - full])
    return placed, n_sequences


def plan_lengths(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, effort: int = EFFORT) -> Plan:
    """A plan for ``counts`` pieces of every length from 1 to ``capacity``, in no more sequences than plain best-fit takes."""
    total = sum(k * v for k, v in counts.items())
    fills = counts.get(capacity, 0)
    shorter = {k: v for k, v in counts.items() if k < capacity and v}
    ways, rests, value = configurations(shorter, capacity, rounds, effort)
    runs, n = best_fit(shorter, {}, fills, capacity)
    for chosen, left in zip(ways, rests, strict=True):
        some, gaps, at = [], {}, fills
        for config, times in chosen:
            offset = 0
            for length, copies in sorted(config.items(), reverse=True):
                for _ in range(copies):
                    some.append((length, times, at, offset))
                    offset += length
            if offset < capacity:
                gaps.setdefault(capacity - offset, []).append([at, times])
            at += times
        more, at = best_fit(left, gaps, at, capacity)
        if at <= n:
            runs, n = some + more, at
    if fills:
        runs.append((capacity, fills, 0, 0))
    runs.sort(key=lambda r: (r[0], r[2], r[3]))
    length, number, sequence, offset = (np.array(x, np.int64) for x in (zip(*runs, strict=True) if runs else ([], [], [], [])))
    done = np.cumsum(number) - number
    first = done - done[np.searchsorted(length, length)] if len(length) else done
    return Plan(length, first, sequence, offset, n, total, capacity, fills + value)


def _cutter(file: str, end_id: int, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(file)
        for batch in batches:
            data, offsets = A.text_buffers(batch.column(1))
            for lo, hi in A.chunks(offsets, tokens.CHUNK):
                ids, at = encoder.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                n = np.diff(at) + 1
                raw = memoryview(np.insert(ids, at[1:], end_id).astype("<u4").view(np.uint8))
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(hi - lo), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                begin = 4 * ((np.cumsum(n) - n)[doc] + start)
                crc = [zlib.crc32(raw[b : b + 4 * k]) for b, k in zip(begin.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return cut


def token_pieces(df: DataFrame, file: str = "word_bpe_49k.json", end_id: int = 0, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every whole text with ``end_id`` after them, as pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32.

    A null text is an empty text: one piece that holds the end id alone. Null and repeated keys keep
    their rows. Other columns are left out.
    """
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_cutter(file, end_id, capacity), PIECES)


def _lookup(plan):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        wide = np.int64(1) << np.int64(48)
        keys = p.length * wide + p.first
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            k = np.searchsorted(keys, length * wide + rank, "right") - 1
            cols = [batch.column(c) for c in batch.schema.names if c != "_rank"]
            names = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(p.sequence[k] + rank - p.first[k]), pa.array(p.offset[k])], names=[*names, "sequence_id", "offset"]
            )

    return look


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """All rows of ``pieces`` with sequence_id and offset; ``length`` must lie between 1 and ``capacity``.

    Pieces of one length are interchangeable, so only their rank matters: the count of the length in all partitions
    before, one row per partition and length, plus the rank inside the partition. The pieces are written to
    the checkpoint folder first, so that counting and ranking see the same partitions. Sequences are filled gaplessly
    from 0. Columns named sequence_id, offset, or starting with an underscore are replaced. No
    pieces give no rows.
    """
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset") and not c.startswith("_")]
    fixed = cut_lineage(pieces.select(*keep, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    per_part = fixed.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    counts = {int(r["length"]): int(r["n"]) for r in per_part.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    plan = pieces.sparkSession.sparkContext.broadcast(plan_lengths(counts, capacity, rounds))  # bounded by the capacity
    before = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = per_part.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    ranked = fixed.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_part").orderBy("_at")) - 1)
    placed = ranked.join(starts, ["length", "_part"]).select(*keep, (F.col("_rank") + F.col("_from")).alias("_rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*keep).schema)
    return placed.mapInArrow(_lookup(plan), f"{schema}, sequence_id long, offset long")
