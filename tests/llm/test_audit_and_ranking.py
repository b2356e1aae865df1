"""Ranked search, filter interactions, digests and covering programs against plain versions of themselves."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewall.llm import digests, filter_audit, lexical, packing, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, source string, item_id string, rank string, part string, n_chars string, _range string"
ODD = [None, "", " \n\t", "One", "É é É e", "a\x00b A B", "日本語。テスト", "x " * 30, "#tag $ 5", "ABC DEF", "one"]


def docs(spark, texts, ids=None, sources=None):
    rows = [(i if ids is None else ids[i], t, sources[i] if sources else "s", "own", "own", "own", "own", "own") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, size=60):
    return " ".join(f"w{min(int(rng.expovariate(0.08)), size)}" for _ in range(n))


def found_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_rank(rows, items, k):
    held = [(i, Counter(found_terms(t))) for i, t in rows]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(found_terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out.update((item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k]))
    return out


@pytest.mark.parametrize(("shard", "leaf", "block_terms", "k"), [(8192, 64, 100_000, 50), (37, 4, 100_000, 5), (64, 1, 30, 7)])
def test_ranking_equals_all_scores(spark, shard, leaf, block_terms, k):
    """Odd texts, repeated rows and ids, ties, a long text, items without known terms; small trees prune, several blocks of items."""
    rng = random.Random(5)
    texts = ODD + [words(rng, rng.choice([1, 3, 20, 90])) for _ in range(240)] + ["tie tie"] * 60 + ["w1 w2 W3 " * 40_000]
    ids = [None, 7, 7, *range(3, len(texts) - 1), 7]
    items = [(0, words(rng, 12)), (0, words(rng, 3)), (1, None), (2, ""), (3, "nowhere"), (4, "tie w3 É"), (None, "日本語 one"), *((10 + i, words(rng, 8)) for i in range(12))]
    df = docs(spark, texts, ids).repartition(5)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    got = Counter(tuple(r) for r in lexical.rank(df, asked, k, block_terms=block_terms, shard=shard, leaf=leaf).collect())
    want = plain_rank(list(zip(ids, texts, strict=True)), items, k)
    assert got == want


def test_ranking_of_empty_tables(spark):
    some, none = docs(spark, ["a b"]), docs(spark, [])
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank(none, items).count() == 0
    assert lexical.rank(some, items.where("false")).count() == 0
    assert lexical.rank(some, items.withColumn("text", F.lit("?"))).count() == 0
    assert lexical.rank(some, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_search_prunes_and_bounds_hold():
    """A node's bound is at least every score below it, and a walk scores a part of the documents."""
    rng = np.random.default_rng(3)
    n, v = 3000, 40
    rows = [np.unique(np.minimum(rng.geometric(0.1, rng.integers(1, 25)), v) - 1) for _ in range(n)]
    start = np.r_[0, np.cumsum([len(r) for r in rows])]
    term, tf = np.concatenate(rows), rng.geometric(0.6, start[-1])
    m = 50 + rng.integers(10, 200, n)
    query = lexical.Query(np.arange(6), np.arange(0, 25, 4), np.concatenate([rng.choice(v, 4, replace=False) for _ in range(6)]), rng.integers(100, 9000, 24), np.arange(v))
    tree = lexical.Tree(query, start, term, tf, m, 16)
    dense = np.zeros((n, v), np.int64)
    dense[np.repeat(np.arange(n), np.diff(start)), term] = lexical.term_part(tf, np.repeat(m, np.diff(start)))
    scores = query.scores(dense, np.arange(6))
    for node, (lo, hi) in tree.leaves.items():
        assert (tree.bounds[node] >= scores[tree.docs[lo:hi]].max(axis=0)).all()
    for node, below in tree.children.items():
        assert (tree.bounds[node] >= tree.bounds[below].max(axis=0)).all()
    best = lexical.Best(6, 10)
    scored = lexical.search(tree, query, best, np.arange(n).astype(object), start, term, tf, m)
    assert scored < 0.8 * n * 6
    for i in range(6):
        assert sorted(best.score[i], reverse=True) == sorted(scores[:, i], reverse=True)[:10]


def plain_failures(rows):
    first, out = {}, []
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            any(c in "#$%&*|" for c in t), i is not None and first[t] < i,
        )
        out.append((i, part or "", {c for c, f in zip("ABCDE", fails, strict=True) if f}))
    return out


@pytest.mark.parametrize("block", [filter_audit.BLOCK, 500])
def test_interactions_of_filters_equal_a_plain_walk(spark, block):
    rng = random.Random(8)
    texts = ODD + [words(rng, rng.choice([5, 49, 50, 80]), rng.choice([20, 400])) + rng.choice(["", " #", " ABCDEFG " * 9]) for _ in range(150)] + ["copy " * 60] * 50 + ["long word " * 30_000]
    ids = [None, None, 5, *range(3, len(texts) - 1), 5]
    sources = [rng.choice(["a", "b", None, ""]) for _ in texts]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, len(texts), 2)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (99999, 1, 1)]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    df = docs(spark, texts, ids, sources)
    lab = spark.createDataFrame([(*x, "own") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(df, lab, block=block).collect()}
    rows = plain_failures(list(zip(ids, texts, sources, strict=True)))
    want, total = {}, Counter()
    for part in {p for _, p, _ in rows}:
        for order in permutations("ABCDE"):
            left = [(i, f) for i, p, f in rows if p == part]
            everyone = list(left)
            for s, c in enumerate(order):
                gone = [(i, f) for i, f in left if c in f]
                left = [(i, f) for i, f in left if c not in f]
                total[part, c] += len(gone)
                want[part, "".join(order), s + 1] = (
                    len(left), len(gone), sum(c in f for _, f in everyone) - len(gone), sum(f == {c} for _, f in everyone),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), c,
                )
    assert got == {k: (*v[:-1], total[k[0], v[-1]]) for k, v in want.items()}


def test_the_matrix_has_one_number_for_every_word(spark):
    rng = random.Random(2)
    texts = [words(rng, 30) for _ in range(40)] + ["", None, "A a A"]
    shards, dictionary = filter_audit.document_terms(docs(spark, texts), block=300)
    name = {r.id: bytes(r.word).decode() for r in dictionary.collect()}
    assert len(name) == len(set(name.values()))
    rows = {}
    for s in shards.collect():
        for d, a, b in zip(s.docs, s.row_start[:-1], s.row_start[1:], strict=True):
            rows[d.doc_id] = Counter({name[c]: t for c, t in zip(s.col[a:b], s.times[a:b], strict=True)})
    assert rows == {i: Counter((t or "").split()) for i, t in enumerate(texts)}
    empty, words_ = filter_audit.document_terms(docs(spark, []))
    assert empty.count() == words_.count() == 0
    assert filter_audit.audit(docs(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_shards_of_a_block_are_bounded_and_share_its_words(spark):
    """Rows stay small however large the block, across batches too; the numbers of words hold for all shards."""
    rng = random.Random(8)
    texts = [words(rng, 30) for _ in range(50)] + [f"w{i} " * 20_000 for i in range(40)] + [None, "", " ".join(f"u{i}" for i in range(40_000))]
    df = docs(spark, texts).coalesce(1)
    shards, dictionary = filter_audit.document_terms(df)
    name = {r.id: bytes(r.word).decode() for r in dictionary.collect()}
    assert len(name) == len(set(name.values())) > 40_000  # more words than a stretch
    rows, got = {}, shards.collect()
    for s in got:
        assert sum(d.n_chars for d in s.docs) <= filter_audit.SHARD
        for d, a, b in zip(s.docs, s.row_start[:-1], s.row_start[1:], strict=True):
            rows[d.doc_id] = Counter({name[c]: t for c, t in zip(s.col[a:b], s.times[a:b], strict=True)})
    assert len({s.block for s in got}) == len(got) > 3
    assert rows == {i: Counter((t or "").split()) for i, t in enumerate(texts)}
    counts = {r.doc_id: (r.n_words, r.n_distinct) for r in filter_audit.row_counts(shards).collect()}
    assert counts == {i: (sum(c.values()), len(c)) for i, c in rows.items()}


def plain_digest(text):
    raw = (text or "").encode()
    counts = [0] * digests.BUCKETS
    for i in range(len(raw) - 2):
        counts[((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % 2**32) >> 24] += 1
    q = sorted(counts)
    low, mid, high = q[63], q[127], q[191]
    size = len(raw) + 1
    octave = size.bit_length()
    return [4 * octave + ((size << 2 >> (octave - 1)) & 3), 16 * low // (high + 1), 16 * mid // (high + 1), *(sum(c > x for x in (low, mid, high)) for c in counts)]


def plain_text(d):
    return f"{d[0]:02x}{d[1]:x}{d[2]:x}" + "".join(f"{4 * d[i] + d[i + 1]:x}" for i in range(3, len(d), 2))


def plain_likeness(a, b):
    return 1 - min(sum(abs(x - y) for x, y in zip(a, b, strict=True)), digests.BOUND) / digests.BOUND


@pytest.mark.parametrize("parts", [1, 6])
def test_digests_of_texts_edits_and_neighbours(spark, parts):
    rng = random.Random(parts)
    texts = [*ODD, *(words(rng, rng.choice([1, 40, 400])) for _ in range(60)), "ab", "abc", "é", "same same", "same same", "long text " * 60_000]
    ids = [None, *range(1, len(texts))]
    got = {r.doc_id: r for r in digests.compare_with_next(docs(spark, texts, ids).repartition(parts)).collect()}
    assert len(got) == len(texts)
    for i, (k, t) in enumerate(zip(ids, texts, strict=True)):
        t, nxt, r = t or "", texts[(i + 1) % len(texts)] or "", got[k]
        new = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, b, c = plain_digest(t), plain_digest(new), plain_digest(nxt)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (plain_text(a), plain_text(b))
        assert (r.near_edited, r.near_next) == (plain_likeness(a, b), plain_likeness(a, c))


def test_digests_with_repeated_keys_and_few_rows(spark):
    assert digests.compare_with_next(docs(spark, [])).count() == 0
    one = digests.compare_with_next(docs(spark, ["abcd"])).first()
    assert (one.near_next, one.edited_sha256) == (1.0, hashlib.sha256(b"abab").hexdigest())
    same = digests.compare_with_next(docs(spark, ["one text here"] * 500, [4] * 500).repartition(7)).collect()
    assert len(same) == 500 and {(r.near_next, r.fingerprint) for r in same} == {(1.0, same[0].fingerprint)}
    df = docs(spark, ["some words of a text", None]).select("doc_id", digests.fingerprint(F.col("text")).alias("a"))
    got = {r.doc_id: r for r in df.withColumn("b", F.when(F.col("doc_id") == 0, F.col("a"))).select("doc_id", "a", digests.likeness(F.col("a"), F.col("b")).alias("x")).collect()}
    assert got[0].x == 1.0 and got[1].x is None and got[0].a == plain_text(plain_digest("some words of a text"))


def test_programs_beat_best_fit():
    cases = [({1034: 6000, 532: 6000, 522: 6000, 491: 12000}, 9000), ({700: 3000, 690: 3000, 650: 3000}, 3000)]
    for counts, best in cases:
        plan = packing.plan_lengths(dict(counts))
        assert best <= plan.n_sequences <= best + len(counts)
        assert plan.bound <= best
    rng = np.random.default_rng(1)
    better = 0
    for _ in range(50):
        counts = {int(k): int(rng.integers(1, 3000)) for k in rng.choice(np.arange(5, 150), int(rng.integers(1, 25)), replace=False)}
        plan = packing.plan_lengths(dict(counts), 200, effort=400)
        plain = packing.best_fit(dict(counts), {}, 0, 200)[1]
        assert plan.bound <= plan.n_sequences <= plain
        better += plan.n_sequences < plain
    assert better > 10


@pytest.mark.parametrize("name", ["op11_document_fp_tree", "op12_filter_matrix", "op13_quartile_digest"])
def test_queries_equal_their_statements(spark, name):
    from tidewall.plans.check import compare

    ok, note = compare(spark, "/root/testdata/sf0.001", name, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, note
