"""Near-duplicates, repeated passages, nearest neighbours and page languages against plain versions of themselves."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewall.llm import arrays as A
from tidewall.llm import bagminhash, forest, language, substrings
from tidewall.llm.components import components

WORDS = [f"w{i}" for i in range(4000)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "own", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, class_id string, _row int")


def bag(text, size=5):
    w = (text or "").split()
    return Counter(tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, min(1, len(w)))))


def jaccard(a, b):
    both = sum((a & b).values())
    either = sum((a | b).values())
    return both / either if either else 0.0


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2040)]
    links += [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in link and link[0] != link[1] and None not in link for link in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(1)
    base = [rng.choice(WORDS[:300]) for _ in range(600)]
    other = base[:420] + [rng.choice(WORDS) for _ in range(180)]
    texts = [" ".join(base), " ".join(other), "z " * 900, "z " * 600]
    data, offsets = A.text_buffers(pa.array(texts))
    points = bagminhash.signatures(*bagminhash.bags(*bagminhash.shingles(data, offsets, 1)), 4, 2048)
    for a, b in ((0, 1), (2, 3)):
        true = jaccard(bag(texts[a], 1), bag(texts[b], 1))
        assert abs((points[a] == points[b]).mean() - true) < 0.05
    assert (points[0] == points[2]).sum() == 0


def test_bags_and_overlap_are_exact():
    rng = random.Random(2)
    texts = [prose(rng, 40), "a b a b a b a b a b a b", "a b", "", "x y z w v u t"] + [" ".join(rng.choice("ab") for _ in range(30)) for _ in range(6)]
    for s in texts:
        for t in texts:
            assert bagminhash.overlap(bagminhash._bag(s, 5), bagminhash._bag(t, 5)) == pytest.approx(jaccard(bag(s), bag(t)))


def near_copy(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


def test_classes_match_all_pairs(spark):
    rng = random.Random(7)
    base = [prose(rng, rng.randint(30, 250)) for _ in range(25)]
    texts = [*base, None, None, "", "one two", "one two", "same " * 500, "same " * 480, "same " * 100]
    for b in base[:12]:
        texts += [near_copy(rng, b, rng.randint(0, 6)) for _ in range(4)]
    texts += [near_copy(rng, base[0], rng.randint(0, 3)) for _ in range(40)] + [base[1]] * 20
    rng.shuffle(texts)
    bags = [bag(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or jaccard(bags[i], bags[j]) >= 0.8:
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    got = {r.doc_id: r.class_id for r in bagminhash.classes(docs(spark, texts)).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    kept = bagminhash.keep_first(docs(spark, texts)).collect()
    assert sorted(r.doc_id for r in kept) == sorted({find(i) for i in range(len(texts))})
    assert kept[0].class_id == "own"


def test_a_link_between_later_texts_of_a_bucket_is_found(spark):
    """The smallest text of a bucket is like none of the others, which are alike."""
    rng = random.Random(9)
    a = prose(rng, 100).split()
    far = " ".join(a[:88] + prose(rng, 12).split())
    b = " ".join(a[12:] + prose(rng, 12).split())
    c = " ".join(a[12:] + b.split()[-12:-1] + ["other"])
    got = {r.doc_id: r.class_id for r in bagminhash.classes(docs(spark, [far, b, c]), bands=200, rows=1).collect()}
    assert got == {0: 0, 1: 1, 2: 1}


@pytest.mark.parametrize("with_source", [True, False])
def test_a_large_group_of_copies_below_and_above_the_threshold(spark, with_source, monkeypatch):
    """Copies of one text with few and many edits: classes equal those of all pairs, few pairs are compared, one text meets over HOT."""
    rng = random.Random(31)
    source = prose(rng, 130)
    texts = [source] * with_source + [near_copy(rng, source, rng.choice([1, 1, 2, 2, 3, 5, 7, 9])) for _ in range(1500)]
    bags = [{k: n for k, n in bag(t).items()} for t in texts]
    numbers = {}
    held = [np.array(sorted(numbers.setdefault((g, i), len(numbers)) for g, n in b.items() for i in range(n))) for b in bags]
    dense = np.zeros((len(texts), len(numbers)), np.float32)
    for row, at in zip(dense, held, strict=True):
        row[at] = 1
    both = dense @ dense.T
    size = dense.sum(axis=1)
    like = both / (size[:, None] + size[None, :] - both) >= 0.8
    low = np.arange(len(texts))
    while True:  # smallest member of each component
        new = np.where(like, low[None, :], len(texts)).min(axis=1)
        if (new == low).all():
            break
        low = new
    compared = []

    def counted(pairs, *how, real=bagminhash._compared):
        compared.extend(r["count"] for r in pairs.groupBy("pivot").count().collect())
        return real(pairs, *how)

    monkeypatch.setattr(bagminhash, "_compared", counted)
    got = {r.doc_id: r.class_id for r in bagminhash.classes(docs(spark, texts)).collect()}
    assert got == {i: int(low[i]) for i in range(len(texts))}
    if with_source:
        assert max(compared) > bagminhash.HOT
        assert sum(compared) < 10 * len(texts)


def test_null_and_repeated_keys_and_empty_tables(spark):
    rng = random.Random(4)
    t = prose(rng, 60)
    df = docs(spark, [t, t, prose(rng, 60), t, prose(rng, 50)], [None, 5, 5, 5, None])
    got = Counter((r.doc_id, r.class_id) for r in bagminhash.classes(df).collect())
    assert got == Counter({(None, 5): 1, (5, 5): 3, (None, None): 1})
    assert bagminhash.keep_first(df).count() == 3
    assert bagminhash.classes(df.where("false")).count() == 0
    assert bagminhash.keep_first(df.where("false")).count() == 0


def plain_repeats(rows, length=20):
    """rows: (key, text); removes words in windows that start earlier by (key, place)."""
    first = {}
    split = [(k, (t or "").encode().split()) for k, t in rows]
    for k, w in sorted(split, key=lambda x: x[0]):
        for s in range(len(w) - length + 1):
            first.setdefault(tuple(w[s : s + length]), (k, s))
    out = {}
    for k, w in split:
        gone = set()
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < (k, s):
                gone.update(range(s, s + length))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[k] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def repeat_corpus(rng):
    passages = [prose(rng, rng.randint(20, 70)) for _ in range(6)]
    line = prose(rng, 14)
    texts = [None, "", "a " * 300, "a " * 19, "a b " * 60, prose(rng, 19), prose(rng, 20)]
    for i in range(90):
        parts = [prose(rng, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), prose(rng, rng.randint(0, 30))]
        if i % 2:
            parts += [line, prose(rng, 12)]  # a frequent anchor in ever new surroundings
        texts.append(" ".join(parts))
    base = prose(rng, 120)
    texts += [base] * 5 + [near_copy(rng, base, 3) for _ in range(60)] + [passages[0][:-1], "tab\t" + passages[1].replace(" ", "\n")]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "hot"), [(1, 32), (2, 3), (3, 1)])
def test_repeated_passages_match_a_plain_version(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 500)
    monkeypatch.setattr(substrings, "STREAM_SEGMENTS", 50)
    texts = repeat_corpus(random.Random(seed))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.repeated_spans(docs(spark, texts)).collect()}
    assert got == plain_repeats(list(enumerate(texts)))


def test_automaton_statistics_match_a_plain_version():
    rng = random.Random(6)
    runs = [[rng.randint(0, 2) for _ in range(rng.randint(0, 30))] for _ in range(12)]
    auto = substrings.SuffixAutomaton()
    for i, run in enumerate(runs):
        auto.add(run, i, 100 * i)
    text = [rng.randint(0, 3) for _ in range(200)]
    for end, (size, first) in enumerate(auto.statistics(text, 6), 1):
        best, where = 0, None
        for n in range(1, 7):
            if n > end:
                break
            piece = text[end - n : end]
            hit = next(((i, 100 * i + s + n) for i, run in enumerate(runs) for s in range(len(run) - n + 1) if run[s : s + n] == piece), None)
            if hit is None:
                break
            best, where = n, hit
        assert size == best
        if best:
            assert first == where


def test_removal_keeps_rows_columns_and_clean_texts(spark):
    rng = random.Random(8)
    p = prose(rng, 60)
    texts = [p, "new  words,\nkept as they are", "front " + p + " back", None]
    got = {r.doc_id: r for r in substrings.remove_repeats(docs(spark, texts)).collect()}
    assert (got[0].text, got[1].text, got[3].text) == (p, texts[1], None)
    assert got[2].text == "front back"
    assert got[2].class_id == "own"
    assert got[2]._row == 2
    # rows of one key: a copy with the same text is not earlier, one with another text comes in a fixed order
    same = substrings.repeated_spans(docs(spark, [p, p, None], [7, 7, None])).collect()
    assert [r.n_removed for r in same] == [0, 0, 0]
    other = substrings.repeated_spans(docs(spark, [p, "x " + p], [7, 7])).collect()
    assert sorted(r.n_removed for r in other) == [0, 60]
    first = {r.doc_id: r.n_removed for r in substrings.repeated_spans(docs(spark, [p, p], [7, None])).collect()}
    assert first == {7: 60, None: 0}
    assert substrings.repeated_spans(docs(spark, [])).count() == 0
    assert substrings.remove_repeats(docs(spark, [])).count() == 0


def test_texts_of_one_key_are_told_apart(spark):
    rng = random.Random(21)
    p = [prose(rng, 60) for _ in range(40)]
    texts = [f"{i} {prose(rng, 20 + i % 7)} {p[i % 40]} {i}" for i in range(5000)]
    order = sorted(range(len(texts)), key=lambda i: hashlib.sha256(texts[i].encode()).digest())
    want = plain_repeats([(n, texts[i]) for n, i in enumerate(order)])
    got = substrings.repeated_spans(docs(spark, texts + texts[:3], [None] * 5003)).collect()
    expected = [want[n] for n in range(5000)] + [want[order.index(i)] for i in range(3)]
    assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(expected)
    assert {r.doc_id for r in got} == {None}
    kept = substrings.remove_repeats(docs(spark, texts, [None] * 5000)).collect()
    digests = {r._row: hashlib.sha256(" ".join(r.text.split()).encode()).hexdigest() for r in kept}
    assert digests == {i: want[n][2] for n, i in enumerate(order)}


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "own", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")


def test_forest_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 32))
    x[100:140] = x[99] * 1.0  # ties
    df = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    got = forest.nearest(df, df.where("vec_id % 50 = 0")).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        rows = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
        s = unit @ unit[q]
        s[q] = -2
        best = np.lexsort((np.arange(3000), -np.round(s, 12)))[:5]
        hits += len({r.vec_id for r in rows} & set(best.tolist()))
        assert np.allclose([r.score for r in rows], [s[r.vec_id] for r in rows], atol=1e-12)
    assert hits >= 0.9 * 5 * 60
    tied = sorted((r for r in got if r.query_id == 100), key=lambda r: r["rank"])
    assert [r.vec_id for r in tied] == [99, 101, 102, 103, 104]


def test_forest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, []), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (100, [0.0, 0.0]), (9, [2.0, 0.0]), (9, [2.0, 0.0])]
    df = vectors(spark, rows)
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in forest.nearest(df, df.where("vec_id % 50 = 0")).collect())
    assert got == [(0, 1, 9), (0, 2, 9), (0, 3, 50), (0, 4, 1), (50, 1, 0), (50, 2, 1), (50, 3, 9), (50, 4, 9)]
    assert forest.nearest(df.where("false"), df.where("false")).count() == 0


LANGS = {"aa": "baka taka naka laka", "bb": "blor drim stolf grunt", "cc": "éli ôra ûni îso"}


def test_page_languages_use_every_evidence(spark):
    rng = random.Random(5)
    say = lambda lang, n: " ".join(rng.choice(LANGS[lang].split()) for _ in range(n))
    labelled = spark.createDataFrame([(i, say(x, 60), x) for i, x in enumerate(list(LANGS) * 10)] + [(99, None, "aa"), (98, "x", None)], "doc_id long, text string, lang string")
    model = language.fit_text_model(labelled)
    assert sorted(model) == ["aa", "bb", "cc"]
    pages, want = [], {}
    for i in range(240):
        lang = list(LANGS)[i % 3]
        pages.append((i, f"https://www.{lang}.example.org/p/{i}", f"<html lang='{lang}'><script>var x = '{say('bb', 30)}'</script><p>{say(lang, 40)}</p>", "own"))
        want[i] = lang
    pages += [
        (300, "https://www.aa.example.org/x", "", "own"),  # the host decides
        (301, "https://new.test/x", "<html lang=cc><p>1 2 3</p>", "own"),  # the declaration decides
        (302, None, None, "own"),
        (303, "not an address", f"<p>{say('bb', 30)}</p>", "own"),
        (304, "https://www.aa.example.org/y", f"<html lang='aa'><p>{say('cc', 200)}</p>", "own"),  # the text outweighs them
        (304, "https://www.aa.example.org/y", f"<html lang='aa'><p>{say('cc', 200)}</p>", "own"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, lang string")
    rows = language.identify(df, model).collect()
    assert len(rows) == len(pages)
    got = {r.page_id: r for r in rows}
    assert all(got[i].lang == x for i, x in want.items())
    assert (got[300].lang, got[301].lang, got[303].lang, got[304].lang) == ("aa", "cc", "bb", "cc")
    assert got[300].text_lang is None
    assert (got[302].host, got[303].host, got[300].host) == (None, None, "www.aa.example.org")
    assert all(0 < r.confidence <= 1 + 1e-9 for r in rows)
    assert language.identify(df.where("false"), model).count() == 0


def test_a_late_declaration_counts(spark):
    model = {x: np.full(language.BUCKETS, -np.log(language.BUCKETS), np.float32) for x in LANGS}
    late = f"<!-- {'licence ' * 1250} -->"
    meta = '<meta name=x content="aa"><meta http-equiv="Content-Language" content="bb-XX">'
    pages = [(0, "https://a.test/", late + "<html class=x lang='cc'><p>1</p>"), (1, "https://b.test/", late + f"<html><head>{meta}</head>"), (2, "https://c.test/", late)]
    got = {r.page_id: r for r in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    assert [got[i].declared for i in range(3)] == ["cc", "bb", None]
    assert language.declared_language("<html " * 200_000 + "<meta http-equiv=content-language " * 20_000) is None


def test_hosts_and_domains(spark):
    rows = [("http://A.b.Example.com:80/x", "a.b.example.com", "example.com"), ("https://u:p@news.site.co.uk?q", "news.site.co.uk", "site.co.uk"), ("ftp://localhost/", "localhost", "localhost"), ("mailto:x", None, None), (None, None, None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "url string")
    got = df.select("url", language.host_of(df.url).alias("h")).select("url", "h", language.domain_of(language.host_of(df.url)).alias("d")).collect()
    assert [tuple(r) for r in got] == rows


def test_visible_text():
    page = "<p>a &amp; b</p><SCRIPT>no</SCRIPT ><!-- no --><style>no</style>c"
    assert language.visible_text(page).split() == ["a", "&", "b", "c"]
