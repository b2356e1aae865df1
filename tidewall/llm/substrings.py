"""Removal of long passages that occur earlier in the corpus, by suffix automata of reference shards.

1. Anchors. Every window of ``length`` words holds the word run of ``GRAM`` words with the least hash; equal windows hold
   the same one at the same place. A window can only repeat if its anchor does, so one count of anchors finds all text
   that can repeat, at a seventh of the words.
2. Reference. The surroundings of a repeated anchor, each different one once and from where it comes first, are
   the reference text. It is cut into shards of bounded size by the document in which an anchor comes first, so
   that a copied passage stays in one piece.
3. Automata. A task builds the suffix automaton of one shard; states know where their words end first. All text around repeated
   anchors is streamed through the automaton of its shard. The automaton is sent, as the shard's text, to every task that streams
   against it: documents meet the shards they can match and no others, so the work grows with the text and not with
   the square of it.
4. Matching statistics give, for every word, the longest run ending there that the reference holds. Where it reaches
   ``length`` and starts earlier, the span goes.

An anchor with more than ``HOT`` surroundings would swell a shard without bound. Its windows are grouped by their
hashes instead, which finds the first of each exactly and needs no automaton.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewall.llm import arrays as A
from tidewall.llm.store import settled, written
from tidewall.session import cut_lineage

LENGTH = 20
GRAM = 8
HOT = 32  # different surroundings of an anchor
SHARD_WORDS = 100_000  # of reference text, on average
STREAM_SEGMENTS = 20_000  # streamed against one copy of an automaton


class SuffixAutomaton:
    """Suffix automaton of several word runs. Every state knows where its runs end first, in the order of the additions."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.first: list[tuple] = [(None, 0)]

    def _state(self, length: int, first: tuple) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.first.append(first)
        return len(self.length) - 1

    def _clone(self, p: int, q: int, word) -> int:
        nxt, link = self.next, self.link
        c = self._state(self.length[p] + 1, self.first[q])
        nxt[c], link[c] = nxt[q].copy(), link[q]
        link[q] = c
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = c
            p = link[p]
        return c

    def add(self, words: list, source, place: int) -> None:
        """Adds a run whose first word has the given place in its source."""
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for i, word in enumerate(words):
            q = nxt[last].get(word)
            if q is not None:  # the run so far is known
                last = q if length[q] == length[last] + 1 else self._clone(last, q, word)
                continue
            new = self._state(length[last] + 1, (source, place + i + 1))
            p = last
            while p >= 0 and word not in nxt[p]:
                nxt[p][word] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][word]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, word)
            last = new

    def statistics(self, words: list, most: int) -> Iterator[tuple[int, tuple]]:
        """For every word: the longest run ending there that was added, up to ``most``, and where that run ends first."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        state = size = 0
        for word in words:
            while state and word not in nxt[state]:
                state = link[state]
                size = length[state]
            state = nxt[state].get(word, 0)
            size = size + 1 if state else 0
            while state and length[link[state]] >= most:
                state = link[state]
            size = min(size, most, length[state])
            yield size, first[state]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For every text with a window: its number, the places of its anchors, their hashes and those of their surroundings."""
    starts, ends, first = A.words(data, offsets)
    hashes = A.word_hashes(data, starts, ends)
    grams = A.window_hashes(hashes, gram)
    span = length - gram + 1  # grams in a window
    n_words = np.diff(first)
    for i in np.flatnonzero(n_words >= length).tolist():
        lo, hi = int(first[i]), int(first[i + 1])
        g = grams[lo : hi - gram + 1]
        least = np.lib.stride_tricks.sliding_window_view(g, span).argmin(axis=1) + np.arange(len(g) - span + 1)
        place = least[np.r_[True, least[1:] != least[:-1]]]
        left = np.maximum(place - (length - gram), 0)
        right = np.minimum(place + length, hi - lo)
        around = A.run_hashes(hashes[lo:hi], left, right, A.WORDS) + (place - left).astype(np.uint64)
        yield i, place, g[place], around


def _chunked(batch: pa.RecordBatch, column: str, most: int = 1_000_000):
    data, offsets = A.text_buffers(batch.column(column))
    for lo, hi in A.chunks(offsets, most):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def _finder(length: int, gram: int, full: bool):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("_t").to_numpy()
            for lo, _, data, offsets in _chunked(batch, "_text"):
                doc, place, gramhash, around = [], [], [], []
                for i, p, g, a in anchors(data, offsets, length, gram):
                    if full:
                        doc.append(np.full(len(p), docs[lo + i]))
                        place.append(p)
                        around.append(a)
                    gramhash.append(g)
                if not gramhash:
                    continue
                cols = {"h": np.concatenate(gramhash).view(np.int64)}
                if full:
                    cols |= {"c": np.concatenate(around).view(np.int64), "_t": np.concatenate(doc), "place": np.concatenate(place)}
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols.values()], names=list(cols))

    return find


def _runs(places: np.ndarray, before: int, after: int, end: int) -> list[tuple[int, int]]:
    """Stretches of words around sorted places, joined where they overlap."""
    lo, hi = np.maximum(places - before, 0), np.minimum(places + after, end)
    cut = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
    return [(int(lo[a]), int(hi[b - 1])) for a, b in zip(cut, np.r_[cut[1:], len(lo)], strict=True)]


PARTS = "kind int, shard long, salts int, doc long, place long, n_words long, text string, sha string"
DONE, REFERENCE, STREAM, WINDOW, OPEN = range(5)


def _cutter(length: int, gram: int):
    """Splits the texts: reference and streamed runs, windows of hot anchors, texts to finish later, and results of texts without repeated anchors."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            frequent: list[tuple] = []  # texts with hot anchors: document, text, places of the anchors
            docs, texts, lists = (batch.column(c).to_pylist() for c in ("doc", "_text", "_targets"))
            for doc, text, targets in zip(docs, texts, lists, strict=True):
                raw = text.encode()
                words = raw.split()
                if not targets:
                    out.append((DONE, 0, 0, doc, 0, len(words), None, hashlib.sha256(b" ".join(words)).hexdigest()))
                    continue
                out.append((OPEN, 0, 0, doc, 0, len(words), text, None))
                by: dict[tuple, list[int]] = {}
                hot: list[int] = []
                for t in targets:
                    if t["shard"] is None:
                        hot.append(t["place"])
                    else:
                        by.setdefault((t["role"], t["shard"], t["salts"]), []).append(t["place"])
                for (role, shard, salts), places in by.items():
                    for lo, hi in _runs(np.unique(places), length - gram, length, len(words)):
                        out.append((role, shard, salts, doc, lo, hi - lo, b" ".join(words[lo:hi]).decode(), None))
                if hot:
                    frequent.append((doc, text, hot))
                if len(out) > 20_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)
            if frequent:
                yield from _windows(frequent, length, gram)

    return cut


TYPES = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
NAMES = ["kind", "shard", "salts", "doc", "place", "n_words", "text", "sha"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)


def _windows(frequent: list[tuple], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The windows of hot anchors, with two hashes each (in the columns shard and n_words)."""
    every, offsets = A.text_buffers(pa.array([f[1] for f in frequent], pa.string()))
    for a, b in A.chunks(offsets, 1_000_000):
        data = every[offsets[a] : offsets[b]]
        starts, ends, first = A.words(data, offsets[a : b + 1] - offsets[a])
        hashes = A.word_hashes(data, starts, ends)
        windows = A.window_hashes(hashes, length).view(np.int64)
        second = A.window_hashes(A.mix(hashes + A.BASE), length).view(np.int64)
        grams = A.window_hashes(hashes, gram)
        at, doc, place = [], [], []
        for i, (own, _, hot) in enumerate(frequent[a:b]):
            lo, hi = int(first[i]), int(first[i + 1])
            g = grams[lo : hi - gram + 1]
            least = np.lib.stride_tricks.sliding_window_view(g, length - gram + 1).argmin(axis=1) + np.arange(hi - lo - length + 1)
            is_hot = np.zeros(hi - lo, bool)
            is_hot[hot] = True
            mine = np.flatnonzero(is_hot[least])
            at.append(mine + lo)
            doc.append(np.full(len(mine), own, np.int64))
            place.append(mine)
        at = np.concatenate(at)
        n = len(at)
        cols = [
            pa.array(np.full(n, WINDOW, np.int32)), pa.array(windows[at]), pa.array(np.zeros(n, np.int32)), pa.array(np.concatenate(doc)),
            pa.array(np.concatenate(place)), pa.array(second[at]), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(cols, names=NAMES)


def _streamer(length: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton, ids = None, None, {}
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            cols = (batch.column(c).to_pylist() for c in ("shard", "_salt", "kind", "doc", "place", "text"))
            for s, salt, kind, doc, place, text in zip(*cols, strict=True):
                if (s, salt) != shard:
                    shard, automaton, ids = (s, salt), SuffixAutomaton(), {}
                # words that the reference lacks need no number of their own
                words = [ids.setdefault(w, len(ids)) for w in text.encode().split()] if kind == REFERENCE else [ids.get(w, -1) for w in text.encode().split()]
                if kind == REFERENCE:
                    automaton.add(words, doc, place)
                    continue
                span = None
                for end, (size, (source, first)) in enumerate(automaton.statistics(words, length), place + 1):
                    if size >= length and (source, first) < (doc, end):
                        if span and span[1] >= end - length:
                            span[1] = end
                        else:
                            if span:
                                found.append((doc, span[0], span[1]))
                            span = [end - length, end]
                if span:
                    found.append((doc, span[0], span[1]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["doc", "lo", "hi"])

    return stream


def _finisher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        cols = (batch.column(c).to_pylist() for c in ("doc", "text", "_spans"))
        for doc, text, spans in zip(*cols, strict=True):
            words = text.encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            for s in spans or ():
                gone[s["lo"]] += 1
                gone[s["hi"]] -= 1
            stay = np.cumsum(gone)[:-1] == 0
            kept = b" ".join(w for w, k in zip(words, stay.tolist(), strict=True) if k)
            cut = np.flatnonzero(np.diff(np.r_[True, stay, True].astype(np.int8)))
            removed = [{"start": int(a), "end": int(b)} for a, b in zip(cut[::2], cut[1::2], strict=True)]
            rows.append((doc, len(words), len(words) - int(stay.sum()), hashlib.sha256(kept).hexdigest(), removed))
        if rows:
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), kind)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc", "n_words", "n_removed", "kept_sha256", "removed"])


def _numbered(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, Column]:
    """The different pairs of key and text: _key, _t (an identity that no two share), _n (rows), doc (a number in the order of key and text hash).

    Also the texts with their _t, one row for each pair, and _t as a column over ``df``. The rows are small: they hold no text.
    """
    spark = df.sparkSession
    known = F.col(key).cast("long"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    pairs = settled(df.select(known[0].alias("_key"), known[1].alias("_sha")).groupBy("_key", "_sha").agg(F.count("*").alias("_n")))
    n_pairs, n_rows = pairs.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    salt = 0
    while pairs.select(F.xxhash64(F.lit(salt), "_key", "_sha").alias("_t")).distinct().count() < n_pairs:
        salt += 1  # 64 bits that two pairs share would mix them up
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = pairs.withColumn("_t", F.xxhash64(F.lit(salt), "_key", "_sha")).repartitionByRange(n_parts, "_key", "_sha").sortWithinPartitions("_key", "_sha")
    ids = settled(in_order.select("_key", "_t", "_n", F.monotonically_increasing_id().alias("doc")))
    t = F.xxhash64(F.lit(salt), *known)
    texts = df.select(t.alias("_t"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    if n_pairs < n_rows:  # rows equal in both are worked on once
        texts = written(texts.groupBy("_t").agg(F.first("_text").alias("_text")), "texts")
    return ids, texts, t


def _spans(ids: DataFrame, named: DataFrame, length: int, gram: int) -> DataFrame:
    """For every pair of ``_numbered``: _key, _t, _n, n_words, n_removed, kept_sha256, removed."""
    once = named.select("_t", "_text").mapInArrow(_finder(length, gram, False), "h long")
    twice = settled(once.groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1").select("h"))
    every = named.mapInArrow(_finder(length, gram, True), "h long, c long, _t long, place long")
    spots = settled(every.join(twice, "h").join(ids.select("_t", "doc"), "_t").drop("_t"))

    around = cut_lineage(spots.groupBy("h", "c").agg(F.min(F.struct("doc", "place")).alias("_own")))
    info = around.groupBy("h").agg(F.count("*").alias("_forms"), F.min("_own").alias("_first"))
    info = cut_lineage(info.select("h", "_forms", F.col("_first.doc").alias("_owner")))
    reference = cut_lineage(around.join(info, "h").select("h", "_owner", "_forms", F.col("_own.doc").alias("doc"), F.col("_own.place").alias("place")))
    n_shards = max(1, reference.where(F.col("_forms") <= HOT).count() * length // SHARD_WORDS)
    shard = F.when(F.col("_forms") <= HOT, F.pmod(F.xxhash64("_owner"), F.lit(n_shards)).cast("long"))
    streams = cut_lineage(spots.join(info, "h").select("doc", "place", shard.alias("shard")))
    load = streams.where(F.col("shard").isNotNull()).groupBy("shard").agg(F.ceil(F.count("*") / STREAM_SEGMENTS).cast("int").alias("salts"))
    load = cut_lineage(load)
    sent = reference.select("doc", "place", shard.alias("shard")).where(F.col("shard").isNotNull()).withColumn("role", F.lit(REFERENCE))
    sent = sent.unionByName(streams.withColumn("role", F.lit(STREAM))).join(load, "shard", "left")
    targets = sent.groupBy("doc").agg(F.collect_list(F.struct("place", "shard", "salts", "role")).alias("_targets"))
    targets = settled(ids.select("_t", "doc").join(targets, "doc", "left"))

    parts = written(named.join(targets, "_t").select("doc", "_text", "_targets").mapInArrow(_cutter(length, gram), PARTS), "parts")
    runs = parts.where(F.col("kind").isin(REFERENCE, STREAM))
    salt = F.explode(F.when(F.col("kind") == REFERENCE, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc", "place"), F.col("salts")).cast("int"))))
    dealt = runs.select("shard", salt.alias("_salt"), "kind", "doc", "place", "text").repartition("shard", "_salt")
    dealt = dealt.sortWithinPartitions("shard", "_salt", "kind", "doc", "place")
    found = dealt.mapInArrow(_streamer(length), "doc long, lo long, hi long")
    windows = parts.where(F.col("kind") == WINDOW).select(F.col("shard").alias("w"), F.col("n_words").alias("w2"), "doc", "place")
    firsts = windows.groupBy("w", "w2").agg(F.min(F.struct("doc", "place")).alias("_own")).select("_own.doc", "_own.place")
    later = windows.join(firsts, ["doc", "place"], "left_anti").select("doc", F.col("place").alias("lo"), (F.col("place") + length).alias("hi"))
    spans = settled(found.unionByName(later).groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("_spans")))
    open_ = parts.where(F.col("kind") == OPEN).join(spans, "doc", "left").select("doc", "text", "_spans")
    removed = "array<struct<start:bigint,end:bigint>>"
    finished = open_.mapInArrow(_finisher, f"doc long, n_words long, n_removed long, kept_sha256 string, removed {removed}")
    untouched = parts.where(F.col("kind") == DONE).select("doc", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.array().cast(removed).alias("removed"))
    return finished.unionByName(untouched).join(ids, "doc").drop("doc")


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """For every row: key, n_words, n_removed, kept_sha256 (of the words that stay, joined by a space), removed (spans of word places).

    A word goes if it lies in a window of ``length`` words that also starts earlier: in a row of a smaller key, in the same
    row before, or, where keys repeat, in a row of the same key whose text has the smaller SHA-256. Rows equal in key and text do not count as
    earlier than each other. A null key comes before all others. Windows are judged on the input. Words are runs of bytes other than ASCII
    white space; a null text has none. Texts of fewer words than ``length`` stay whole. Other columns are left out.
    """
    ids, texts, t = _numbered(df, key, text)
    whole = _spans(ids, texts, length, gram)
    out = [F.col("_key").alias(key), "n_words", "n_removed", "kept_sha256", "removed"]
    if ids.where("_n > 1").isEmpty():
        return whole.select(*out)
    return df.select(t.alias("_t")).join(whole, "_t").select(*out)


def _keeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, removed in zip(batch.column("_text").to_pylist(), batch.column("_removed").to_pylist(), strict=True):
            if not removed:
                out.append(text)
                continue
            words = text.encode().split()
            for s in removed:
                words[s["start"] : s["end"]] = [None] * (s["end"] - s["start"])
            out.append(b" ".join(w for w in words if w is not None).decode())
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(out, pa.string())], names=["_row", "_text"])


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """All rows and columns of ``df``; texts that lose words become their other words joined by a space, the others stay as they are.

    See ``repeated_spans`` for what goes and for nulls and repeated keys.
    """
    ids, texts, t = _numbered(df, key, text)
    spans = cut_lineage(_spans(ids, texts, length, gram).where("n_removed > 0").select("_t", F.col("removed").alias("_removed")))
    others = [c for c in df.columns if c != text]
    named = df.select(F.struct(*others, F.lit(0).alias("_")).alias("_row"), t.alias("_t"), F.col(text).alias("_text"))
    row = T.StructType([T.StructField("_row", named.schema["_row"].dataType), T.StructField("_text", T.StringType())])
    done = named.join(spans, "_t", "left").select("_row", "_text", "_removed").mapInArrow(_keeper, row)
    return done.select(*(F.col("_text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in df.columns))
