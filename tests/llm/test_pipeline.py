"""The five stages one after another, each against what its brute-force version makes of the stage before."""

import random
import zlib

import numpy as np

import corpus_pipeline
from tests.llm.test_search_operators import bag, jaccard, near_copy, prose, repeat_corpus
from tidewall.llm import surrogates, tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(21)
    texts = [t for t in repeat_corpus(rng) if t is None or len(t) < 3000]
    base = prose(rng, 150)
    texts += [base, near_copy(rng, base, 1), near_copy(rng, base, 2), base]
    texts += ["Home | News | Sport | Food\n" * 30, "again again " * 60]
    mail = f"{prose(rng, 40)} write to jo.doe@mail.example.com or +1 (415) 555-0132 {prose(rng, 30)}"
    texts += [mail, f"{prose(rng, 60)} jo.doe@mail.example.com {prose(rng, 5)}", "All rights reserved.\n" + prose(rng, 90) + "."]
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def test_stages(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [rows]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, "")
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == COLUMNS
        kept.append([tuple(r) for r in docs.collect()])
    first, quality, near, cut, clean, packed = kept

    text = [{r[0]: r[1] for r in k} for k in (first, quality, near, cut, clean)]
    assert [k for k, t in text[0].items() if t and t.startswith("Home |")][0] not in text[1]
    assert not any(t.startswith("All rights") for t in text[1].values())
    assert all(len((t or "").split()) >= 20 for t in text[1].values())

    bags = {k: bag(t) for k, t in text[1].items()}
    ids, group = sorted(bags), {}
    for k in ids:  # classes by all pairs
        like = {group[j] for j in group if text[1][j] == text[1][k] or jaccard(bags[j], bags[k]) >= 0.8}
        root = min(like, default=k)
        for j in group:
            if group[j] in like:
                group[j] = root
        group[k] = root
    assert set(text[2]) == set(group.values())
    assert all(text[2][k] == text[1][k] for k in text[2])

    seen = {}
    for k in sorted(text[2]):
        words = (text[2][k] or "").split()
        gone = set()
        for s in range(len(words) - 19):
            w = tuple(words[s : s + 20])
            if seen.setdefault(w, (k, s)) != (k, s):
                gone.update(range(s, s + 20))
        want = text[2][k] if not gone else " ".join(w for i, w in enumerate(words) if i not in gone)
        assert text[3][k] == want

    for k, t in text[3].items():
        if surrogates.detect(t):
            assert text[4][k] != t
            assert "jo.doe@" not in text[4][k]
            assert "555-0132" not in text[4][k]
        else:
            assert text[4][k] == t
    assert all(r[4] == len(r[1]) for k in (quality, near, cut, clean) for r in k)

    tok = tokens.encoder().tok
    got = {(r[0], r[1]): r for r in packed}
    n = 0
    for k, t in text[4].items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), 2048):
            part = ids[p : p + 2048]
            r = got[k, p // 2048]
            assert r[2:5] == (p, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
            n += 1
    assert n == len(packed)


def test_an_empty_table_goes_through(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
        if "piece" not in docs.columns:
            docs = spark.createDataFrame([], docs.schema)


def test_columns_of_the_caller_pass_every_stage(spark):
    """Names that the operators use themselves, repeated rows, and null keys and texts."""
    names = ["doc_id", "n_words", "text", "kept", "clean_text", "n_entities", "_row", "root", "class_id", "removed", "n_chars"]
    rng = random.Random(5)
    one, two = (f"{prose(rng, 60)} jo.doe@mail.example.com {prose(rng, 30)}." for _ in range(2))
    rows = [(i, f"mine{i}", t, "k", "c", 99, "r", "o", "cl", "re", len(t or "")) for i, t in [(1, one), (2, two), (None, prose(rng, 50) + "."), (4, None), (5, one), (5, one)]]
    docs = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n in ('doc_id', 'n_entities', 'n_chars') else 'string'}" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == names
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == {1, 2, None}
    assert all((r.n_words, r.n_entities, r._row, r.removed) == (f"mine{1 if k == 1 else 2}" if k else "mineNone", 99, "r", "re") for k, r in got.items())
    assert all("jo.doe@" not in r.text and r.n_chars == len(r.text) for r in got.values())
