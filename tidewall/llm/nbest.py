"""N-best segmentation over the piece lattice of a SentencePiece vocabulary, and decoding.

A forward Viterbi pass gives every place of the lattice the best score of a way from the start. The backward search
(A*) takes these scores as its heuristic; they are exact, so ways to the end are completed in the order of
their scores and the search stops at the n-th.

No piece of the vocabulary spans a pair of neighbouring characters that is inside no piece, so the lattice
falls apart there into spans. Equal spans share one Viterbi pass, which goes through many spans at once, place by
place; across the chain of spans the same search runs on losses against the best, and only the n - 1 spans with the
least second-best loss can differ from the best way.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewall.llm import arrays as A
from tidewall.llm.learnt import Learnt
from tidewall.llm.tokens import vocabulary

SPACE = "▁"
OFFSET = 2.7  # of the Zipf law that turns a piece's rank into a probability
BYTE_COST = 10.0  # how much less likely than the rarest piece a byte is
KNOWN_SPANS = 400_000
LONG_SPAN = 64  # characters beyond which a span goes through the lattice by itself
AT_ONCE = 250_000  # characters of spans that go through it together


class Lattice:
    """Pieces and their log probabilities.

    The file's scores are the ranks of merges, not probabilities; a piece of rank r gets the probability of a
    Zipf law, 1 / (r + 2.7), normalised over the vocabulary. Characters without a piece are written as byte pieces.
    """

    def __init__(self, file: str = "piece_bpe_32k.model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(file))
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_id = np.zeros(256, np.uint32)
        rank: dict[str, float] = {}
        ids: dict[str, int] = {}
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                ids[piece], rank[piece] = i, -sp.get_score(i)
        norm = float(np.log(sum(1 / (r + OFFSET) for r in rank.values())))
        self.raw = [p.encode() for p in self.pieces]
        for byte, i in enumerate(self.byte_id.tolist()):
            self.raw[i] = bytes([byte])
        self.ids = ids
        self.score = {p: -float(np.log(r + OFFSET)) - norm for p, r in rank.items()}
        self.longest = max(map(len, ids))
        self.byte_score = min(self.score.values()) - BYTE_COST
        inside = {(ord(a) << 21) | ord(b) for p in ids for a, b in zip(p, p[1:], strict=False)}
        self._trie()
        self.pairs = np.array(sorted(inside), np.int64)
        self.ascii_pair = np.zeros(128 * 128, bool)
        for code in inside:
            a, b = code >> 21, code & ((1 << 21) - 1)
            if a < 128 and b < 128:
                self.ascii_pair[a * 128 + b] = True

    def _trie(self) -> None:
        """The pieces as a tree: sorted steps (node, character), the node after each, and the piece at every node, if any."""
        steps: dict[int, int] = {}
        piece_at = {}
        for piece, i in self.ids.items():
            node = 0
            for c in piece:
                node = steps.setdefault((node << 21) | ord(c), len(steps) + 1)
            piece_at[node] = i
        self.steps = np.array(sorted(steps), np.int64)
        self.after_step = np.array([steps[s] for s in self.steps.tolist()], np.int64)
        # a number for every edge: a piece, a character of one to four bytes, none
        n = len(self.pieces)
        self.piece_at = np.full(len(steps) + 1, n + 4, np.int32)
        self.piece_at[list(piece_at)] = list(piece_at.values())
        self.edge_score = np.full(n + 5, -np.inf)
        for piece, i in self.ids.items():
            self.edge_score[i] = self.score[piece]
        self.edge_score[n : n + 4] = [self.byte_score * k for k in range(1, 5)]

    def _edges_of_all(self, codes: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Edge of every length (row) that ends at every character; ``left``: characters up to the end of the span, this one included."""
        n = len(self.pieces)
        out = np.full((self.longest + 1, len(codes)), n + 4, np.int32)
        at = np.arange(len(codes))
        node = np.zeros(len(codes), np.int64)
        for length in range(1, self.longest + 1):
            step = (node << 21) | codes[at + length - 1]
            slot = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
            found = self.steps[slot] == step
            at, node = at[found], self.after_step[slot[found]]
            out[length, at + length - 1] = self.piece_at[node]
            more = left[at] > length
            at, node = at[more], node[more]
        alone = np.flatnonzero(out[1] == n + 4)
        out[1, alone] = n + np.searchsorted([0x80, 0x800, 0x10000], codes[alone], "right")
        return out

    def best_and_losses(self, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``best_and_loss`` of many spans at once: ids of all of them in a row, how many each has, and score and loss of each.

        ``codes`` are the characters of all spans in a row, ``size`` the characters of each span. Places are laid out by their
        distance from the start of the span, the longest spans first, so that a step of the pass is a step of all spans.
        """
        spans_n, longest, none = len(size), int(size.max()), len(self.pieces) + 4
        first = np.cumsum(size) - size
        span = np.repeat(np.arange(spans_n), size)
        end = np.arange(len(codes)) - first[span] + 1
        order = np.argsort(-size, kind="stable")
        rank = np.empty(spans_n, np.int64)
        rank[order] = np.arange(spans_n)
        reach = np.r_[spans_n, np.cumsum(np.bincount(size, minlength=longest + 1)[::-1])[::-1][1:]]  # spans of so many characters at least
        base = np.cumsum(reach) - reach
        put = base[end] + rank[span]  # place after every character
        edge = np.full((self.longest + 1, len(codes) + spans_n), none, np.int32)
        edge[:, put] = self._edges_of_all(codes, size[span] - end + 1)

        best, after = np.zeros(len(codes) + spans_n), np.zeros(len(codes) + spans_n)
        back = np.zeros(len(best), np.int64)
        for e in range(1, longest + 1):
            n, here = int(reach[e]), int(base[e])
            top, by = np.full(n, -np.inf), np.zeros(n, np.int64)
            for length in range(min(e, self.longest), 0, -1):  # of equal ways the one with the longest last piece
                way = best[base[e - length] : base[e - length] + n] + self.edge_score[edge[length, here : here + n]]
                better = way > top
                top[better], by[better] = way[better], length
            best[here : here + n], back[here : here + n] = top, by
        for e in range(longest - 1, -1, -1):
            top = np.full(int(reach[e + 1]), -np.inf)
            for length in range(1, min(longest - e, self.longest) + 1):
                n, there = int(reach[e + length]), int(base[e + length])
                np.maximum(top[:n], after[there : there + n] + self.edge_score[edge[length, there : there + n]], out=top[:n])
            after[base[e] : base[e] + len(top)] = top

        own = np.zeros(len(best), bool)
        own[base[size] + rank] = True
        for e in range(longest, 0, -1):
            here = np.arange(base[e], base[e] + reach[e])
            here = here[own[here]]
            own[base[e - back[here]] + here - base[e]] = True
        second = np.full(len(best), -np.inf)
        level = np.repeat(np.arange(longest + 1), reach)
        for length in range(1, min(longest, self.longest) + 1):
            to = np.flatnonzero((edge[length] != none) & ~(own & (back == length)))
            start = base[level[to] - length] + to - base[level[to]]
            second[to] = np.maximum(second[to], best[start] + self.edge_score[edge[length, to]] + after[to])
        score = best[base[size] + rank]
        loss = np.maximum(score - np.maximum.reduceat(second[put], first), 0.0)

        cut = np.flatnonzero(own[put])
        taken = edge[back[put[cut]], put[cut]].astype(np.int64)
        count = np.where(taken < len(self.pieces), 1, taken - len(self.pieces) + 1)
        ids = np.repeat(taken, count)
        as_bytes = ids >= len(self.pieces)
        if as_bytes.any():
            plain = codes[cut[taken >= len(self.pieces)]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            ids[as_bytes] = self.byte_id[np.frombuffer(plain.encode("utf-8", "surrogatepass"), np.uint8)]
        return ids.astype(np.uint32), np.bincount(span[cut], count, spans_n).astype(np.int64), np.stack([score, loss], axis=1)

    def edges(self, text: str, end: int) -> list[tuple[int, float]]:
        """Pieces of the text that end at a place: where they start and their scores."""
        out = []
        for start in range(max(0, end - self.longest), end):
            score = self.score.get(text[start:end])
            if score is not None:
                out.append((start, score))
        if not out or out[-1][0] != end - 1:
            out.append((end - 1, self.byte_score * len(text[end - 1].encode("utf-8", "surrogatepass"))))
        return out

    def forward(self, text: str) -> tuple[list[float], list[list[tuple[int, float]]], list[int]]:
        """Best score up to every place, the edges into it, and where its best edge starts."""
        best, into, back = [0.0], [[]], [0]
        for end in range(1, len(text) + 1):
            edges = self.edges(text, end)
            top, at = -np.inf, 0
            for start, score in edges:
                if best[start] + score > top:
                    top, at = best[start] + score, start
            best.append(top)
            into.append(edges)
            back.append(at)
        return best, into, back

    def best_and_loss(self, text: str) -> tuple[list[int], float, float]:
        """Ids of the best way, its score, and how much the second best loses (infinite if there is none).

        The second best way has an edge that the best has not; the best way through an edge is the forward
        score before it, its own, and the backward score after it.
        """
        best, into, back = self.forward(text)
        n = len(text)
        after = [-np.inf] * n + [0.0]
        for end in range(n, 0, -1):
            for start, score in into[end]:
                if after[end] + score > after[start]:
                    after[start] = after[end] + score
        cuts, at = [n], n
        while at:
            at = back[at]
            cuts.append(at)
        cuts.reverse()
        own = set(zip(cuts, cuts[1:], strict=False))
        second = max((best[s] + w + after[e] for e in range(1, n + 1) for s, w in into[e] if (s, e) not in own), default=-np.inf)
        return self._ids(text, cuts), best[n], max(best[n] - second, 0.0)

    def _ids(self, text: str, cuts: list[int]) -> list[int]:
        out = []
        for s, e in zip(cuts, cuts[1:], strict=False):
            i = self.ids.get(text[s:e])
            out += [i] if i is not None else self.byte_id[list(text[s:e].encode("utf-8", "surrogatepass"))].tolist()
        return out

    def n_best(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best ways by backward A*, best first. Ties: the way further on goes first."""
        if not text:
            return [(0.0, [])]
        best, into, _ = self.forward(text)
        agenda = [(-best[-1], len(text), 0, 0.0, (len(text), None))]
        out, count = [], 0
        while agenda and len(out) < n:
            _, place, _, done, way = heapq.heappop(agenda)
            if place == 0:
                cuts, w = [], way
                while w is not None:
                    cuts.append(w[0])
                    w = w[1]
                out.append((done, self._ids(text, cuts)))
                continue
            for start, score in into[place]:
                count += 1
                heapq.heappush(agenda, (-(best[start] + score + done), start, count, done + score, (start, way)))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids: pieces joined, runs of bytes read as UTF-8, the leading space dropped."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:]


def spans(lattice: Lattice, codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Starts of the spans of some texts, given as code points; ``firsts`` are the starts of the texts."""
    if not len(codes):
        return np.zeros(0, np.int64)
    a, b = codes[:-1].astype(np.int64), codes[1:].astype(np.int64)
    joined = np.zeros(len(a), bool)
    plain = (a < 128) & (b < 128)
    joined[plain] = lattice.ascii_pair[a[plain] * 128 + b[plain]]
    rest = np.flatnonzero(~plain)
    code = (a[rest] << 21) | b[rest]
    at = np.minimum(np.searchsorted(lattice.pairs, code), len(lattice.pairs) - 1)
    joined[rest] = lattice.pairs[at] == code
    cut = np.ones(len(codes), bool)
    cut[1:] = ~joined
    cut[firsts[firsts < len(codes)]] = True
    return np.flatnonzero(cut)


class Segmenter:
    """N-best ways of whole texts, span by span."""

    def __init__(self, file: str = "piece_bpe_32k.model"):
        self.lattice = Lattice(file)
        self.known = Learnt(KNOWN_SPANS, 2)
        self.ways: dict[tuple[str, int], list[tuple[float, list[int]]]] = {}

    def _few(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        if (text, n) not in self.ways:
            if len(self.ways) > KNOWN_SPANS // 4:
                self.ways.clear()
            self.ways[text, n] = self.lattice.n_best(text, n)
        return self.ways[text, n]

    def segment(self, texts: list[str | None], n: int) -> Iterator[list[tuple[float, np.ndarray]]]:
        """For every text its n best ways (fewer if there are no more): score and ids. An empty text has one way, of no ids."""
        ready = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        whole = "".join(ready)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.r_[0, np.cumsum([len(t) for t in ready])]
        starts = spans(self.lattice, codes, offsets[:-1])
        ends = np.r_[starts[1:], len(codes)] if len(starts) else starts
        hashes = A.run_hashes(A.mix(codes.astype(np.uint64) + A.U(1)), starts, ends, A.WORDS)

        def learn(at: np.ndarray):
            size = ends[at] - starts[at]
            long = size > LONG_SPAN
            part = np.where(long, -1, np.cumsum(np.where(long, 0, size)) // AT_ONCE)
            count, numbers = np.zeros(len(at), np.int64), np.zeros((len(at), 2))
            found, done = [], []
            for p in np.unique(part[~long]).tolist():
                own = np.flatnonzero(part == p)
                n = size[own]
                chars = codes[np.repeat(starts[at[own]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                few, count[own], numbers[own] = self.lattice.best_and_losses(chars.astype(np.int64), n)
                found.append(few)
                done.append(own)
            for i in np.flatnonzero(long).tolist():
                few, *numbers[i] = self.lattice.best_and_loss(whole[starts[at[i]] : ends[at[i]]])
                count[i] = len(few)
                found.append(np.array(few, np.uint32))
                done.append([i])
            done = np.concatenate(done)
            first = np.empty(len(at), np.int64)
            first[done] = np.cumsum(count[done]) - count[done]
            return np.concatenate(found), first, count, numbers

        slots = self.known.slots(hashes, learn)
        ids, count = self.known.gather(slots)
        score, loss = self.known.numbers[slots, 0], self.known.numbers[slots, 1]
        first = np.searchsorted(starts, offsets)
        upto = np.r_[0, np.cumsum(count)]
        for i in range(len(texts)):
            lo, hi = int(first[i]), int(first[i + 1])
            best_ids = ids[upto[lo] : upto[hi]]
            total = float(score[lo:hi].sum())
            if n == 1 or lo == hi:
                yield [(total, best_ids)]
                continue
            own = loss[lo:hi]
            pick = np.argpartition(own, n - 2)[: n - 1] if hi - lo > n - 1 else np.arange(hi - lo)
            pick = np.sort(pick[np.isfinite(own[pick])]) + lo
            options = [self._few(whole[starts[p] : ends[p]], n) for p in pick.tolist()]
            yield self._chain(total, best_ids, pick, options, upto, lo, n)

    @staticmethod
    def _chain(total: float, best_ids: np.ndarray, pick: np.ndarray, options: list, upto: np.ndarray, lo: int, n: int) -> list[tuple[float, np.ndarray]]:
        """The same search across the spans that may differ: a state is a choice for the spans from one on."""
        agenda = [(0.0, len(options), 0, ())]
        out, count = [], 0
        while agenda and len(out) < n:
            lost, place, _, choice = heapq.heappop(agenda)
            if place == 0:
                parts, at = [], int(upto[lo])
                for p, option, c in zip(pick.tolist(), options, choice, strict=True):
                    if c:
                        parts += [best_ids[at - upto[lo] : upto[p] - upto[lo]], np.array(option[c][1], np.uint32)]
                        at = int(upto[p + 1])
                parts.append(best_ids[at - upto[lo] :])
                out.append((total - lost, np.concatenate(parts)))
                continue
            for c, (score, _) in enumerate(options[place - 1]):
                count += 1
                heapq.heappush(agenda, (lost + options[place - 1][0][0] - score, place - 1, count, (c, *choice)))
        return out


_SEGMENTERS: dict[str, Segmenter] = {}


def segmenter(file: str = "piece_bpe_32k.model") -> Segmenter:
    if file not in _SEGMENTERS:
        _SEGMENTERS[file] = Segmenter(file)
    return _SEGMENTERS[file]


def batches_of(texts: list[str | None], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


RESULT = "doc_id long, n_pieces array<int>, scores array<double>, ids_crc32 array<long>, round_trip boolean"


def _encoder(n: int, file: str, keep_ids: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = segmenter(file)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in batches_of(texts):
                size, scores, crcs, same, best = [], [], [], [], []
                for text, ways in zip(texts[lo:hi], work.segment(texts[lo:hi], n), strict=True):
                    size.append([len(ids) for _, ids in ways])
                    scores.append([s for s, _ in ways])
                    crcs.append([zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in ways])
                    same.append(work.lattice.decode(ways[-1][1].tolist()) == (text or ""))
                    if keep_ids:
                        best.append([ids.tolist() for _, ids in ways])
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(size, pa.list_(pa.int32())), pa.array(scores, pa.list_(pa.float64())), pa.array(crcs, pa.list_(pa.int64())), pa.array(same)]
                names = ["doc_id", "n_pieces", "scores", "ids_crc32", "round_trip"]
                if keep_ids:
                    cols.append(pa.array(best, pa.list_(pa.list_(pa.int32()))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return encode


def n_best(df: DataFrame, n: int = 4, file: str = "piece_bpe_32k.model", key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """For every row the ``n`` best segmentations of its whole text, best first.

    Gives doc_id, n_pieces, scores (log probabilities), ids_crc32 (of the ids as little-endian 32-bit integers), round_trip (the
    last way, decoded, is the text) and, with ``with_ids``, the ids. A null text is an empty text: one way without ids. Texts
    with fewer ways give fewer. Among ways of equal score any may come first. Repeated rows are answered each;
    other columns are left out.
    """
    schema = RESULT + (", ids array<array<int>>" if with_ids else "")
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_encoder(n, file, with_ids), schema)


def decode(df: DataFrame, file: str = "piece_bpe_32k.model", ids: str = "ids", into: str = "text") -> DataFrame:
    """Adds the text of a column of ids; null ids give null. A column named as ``into`` is replaced."""

    @F.pandas_udf("string")
    def read(column):
        import pandas as pd

        lattice = segmenter(file).lattice
        return pd.Series([None if x is None else lattice.decode(x) for x in column], dtype=object)

    return df.withColumn(into, read(F.col(ids)))
