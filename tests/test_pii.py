import random
import re

from pyspark.sql import functions as F

from tidewall.functions.patterns import ascii_classes, gate_pattern
from tidewall.functions.text import context_excerpt, mask_value
from tidewall.operators import pii as P
from tidewall.rules import context as C
from tidewall.rules import pii as R

ALL = R.rules_jp() + R.rules_intl() + R.rules_kr()


def brute(text, rules):
    out = []
    for i, r in enumerate(rules):
        for m in re.finditer(ascii_classes(r.pattern), text):
            out.append((m.start(), i, r.name, m.group()))
    return sorted(out)


def brute_redact(text, rules):
    """Right to left by offset, later rules last among equals."""
    hits = brute(text, rules)
    chars = list(text)
    for off, i, _, hit in sorted(hits, key=lambda h: (-h[0], h[1])):
        mask = rules[i].mask_char
        masked = mask * len(hit) if len(hit) <= 2 else hit[0] + mask * (len(hit) - 2) + hit[-1]
        chars[off : off + len(hit)] = masked
    return "".join(chars)


def scan(spark, texts, rules=ALL, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = P.with_matches(df, "text", rules, **kw).orderBy("id").collect()
    return [[(m.offset, m.rule_ord, m.rule, m.matched_text) for m in r.matches] for r in rows]


def test_literal_hits(spark):
    texts = [
        "My Number is 123456789012 and it should be masked.",
        "Phone: 03-1234-5678, ID: 12345",
        "é123-4567 and 123-4567",
        "IBAN DE89370400440532013000, passport A1234567, amex 371449635398431, rrn 900101-1234567",
        "",
        None,
    ]
    got = scan(spark, texts)
    names = [{m[2] for m in g} for g in got]
    assert "my_number" in names[0] and "my_number" not in names[1]
    assert [m for m in got[2] if m[2] == "postal_code_jp"] == [(14, 5, "postal_code_jp", "123-4567")]
    assert {"pii_iban", "pii_passport_generic", "pii_credit_card_amex", "korean_rrn"} <= names[3]
    assert got[4] == [] and got[5] == []


def test_matches_and_redaction_equal_brute_force(spark):
    rnd = random.Random(7)
    parts = ["4111-1111-1111-1111", "a@b.example", "10.1.2.3", "090 1234 5678", "123-4567", "123456789012", "é", "日本", " ", "x", "0", "12", "-", "\n", "A1234567"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(120)]
    want = [brute(t, ALL) for t in texts]
    assert scan(spark, texts) == want
    assert scan(spark, texts, gate=False) == want
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = P.redact_text(P.with_matches(df, "text", ALL), "text").orderBy("id").collect()
    for t, r in zip(texts, rows):
        assert r.redacted_text == brute_redact(t, ALL)
        assert len(r.redacted_text) == len(t)


def test_long_text_with_many_hits(spark):
    text = "".join(f"日{i:04d} mail u{i}@corp.example, card 4111 1111 1111 {i:04d}; " for i in range(2500))
    assert len(text) > 3 * 32768
    rules = R.rules_jp()
    want = brute(text, rules)
    assert len(want) >= 5000
    assert scan(spark, [text], rules) == [want]
    df = spark.createDataFrame([(text,)], "text string")
    assert P.redact_text(P.with_matches(df, "text", rules), "text").first().redacted_text == brute_redact(text, rules)


def test_gate_never_hides_a_hit():
    import pyarrow as pa
    import pyarrow.compute as pc

    for r in ALL:
        gate = gate_pattern(r.pattern)
        assert gate is not None
        samples = ["é123-4567x", "1\x0b2", "a@b.cd", "4111\x0b1111\x0b1111\x0b1111", "1.2.3.4", "x0123456789y", "123456-1234567"]
        for s in samples:
            if re.search(ascii_classes(r.pattern), s):
                assert pc.match_substring_regex(pa.array([s]), gate).to_pylist() == [True]
    for odd in (r"a$", r"a\\$", r"\Bx", r"(?=x)", r"\p{L}", r"a++", r"[a[bc]]x", r"[a&&b]", r"[]a]", r"(?i)[^k]", r"a\b{3}b", "[a"):
        assert gate_pattern(odd) is None


def test_gate_passes_whatever_the_exact_scan_finds(spark):
    import random

    rng = random.Random(12)
    atoms = [r"\\", r"\b", r"\d", r"\s", r"\w", "a", "b", "d", "9", "[ab]", "[^a]", "[a[bc]]", r"[\d-]", ".", r"\$", "$", "^", "(?:ab)", "(a|d)", r"\.", "k"]
    tails = ["", "", "", "*", "+", "?", "{2}", "{1,2}", "+?", "++"]
    patterns = []
    while len(patterns) < 520:
        p = rng.choice(["", "", "(?i)"]) + "".join(rng.choice(atoms) + rng.choice(tails) for _ in range(rng.randint(1, 4)))
        try:
            spark._jvm.java.util.regex.Pattern.compile(p)
        except Exception:  # not a pattern
            continue
        patterns.append(p)
    patterns += [r"\\bd", r"[a[bc]]x", r"a\\$"]
    texts = ["".join(rng.choice("ab9d .$\\-kKxcAéK\x0b\n") for _ in range(rng.randint(0, 9))) for _ in range(40)] + ["\\bd", "cx", "a\\"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    gates = [gate_pattern(p) for p in patterns]
    assert sum(g is not None for g in gates) > 150
    exact = df.select("text", *(F.rlike("text", F.lit(p)).alias(f"m{i}") for i, p in enumerate(patterns))).collect()
    import pyarrow as pa
    import pyarrow.compute as pc

    for i, g in enumerate(gates):
        if g is None:
            continue
        passed = pc.match_substring_regex(pa.array([r.text for r in exact]), g).to_pylist()
        for r, ok in zip(exact, passed, strict=True):
            assert ok or not r[f"m{i}"], (patterns[i], g, r.text)


def test_many_hits_stay_linear(spark):
    text = "x a@b.example " * 3000
    df = spark.createDataFrame([(text,)], "text string")
    rules = R.rules_jp()
    scanned = P.with_matches(df, "text", rules)
    row = P.redact_text(scanned, "text").first()
    assert [m.offset for m in row.matches if m.rule == "email"] == [2 + 14 * i for i in range(3000)]
    assert row.redacted_text == brute_redact(text, rules)


def test_byte_offsets(spark):
    df = spark.createDataFrame([(1, "日本 a@b.example")], "id int, text string")
    row = P.pii_scan(df, ["id"], "text", R.rules_jp(), byte_offsets=True).first()
    assert (row.offset, row.byte_offset) == (3, 7)


def test_mask_and_excerpt(spark):
    df = spark.createDataFrame([("123456789012",), ("AB",), ("A",), ("",)], "v string")
    assert [r[0] for r in df.select(mask_value(F.col("v"))).collect()] == ["1**********2", "**", "*", ""]
    text = "word " * 30 + "a@b.example" + " tail" * 30
    row = spark.createDataFrame([(text,)], "t string").select(context_excerpt(F.col("t"), F.lit(150), F.lit(11))).first()[0]
    assert row.startswith("… word") or row.startswith("…word")
    assert row.endswith("…") and "a@b.example" in row


def test_rule_edits():
    bad = R.TextRule("bad", "(", "mask")
    assert R.valid_rules([bad, *R.rules_jp()]) == R.rules_jp()
    try:
        R.add_rule(R.rules_jp(), bad)
        raise AssertionError("a bad pattern must be refused")
    except ValueError:
        pass
    assert [r.name for r in R.rules_intl("EU")] == ["pii_iban"]


def context(spark, pii_type, prefix, suffix):
    df = spark.createDataFrame([(pii_type, prefix, suffix)], "pii_type string, prefix string, suffix string")
    return P.context_reason(P.score_context(df, C.default_keywords())).first()


def test_context_scores(spark):
    yes = context(spark, "national_id", "Your national id number is ", " please keep safe")
    assert yes.is_pii and yes.positive_words == ["national id"] and yes.reason.startswith("Confirmed")
    no = context(spark, "national_id", "Invoice no.", " reference code")
    assert not no.is_pii and "global:invoice" in no.negative_words
    plain = context(spark, "national_id", "", "")
    assert not plain.is_pii and plain.score == 0.5 and abs(plain.confidence - 0.7) < 1e-12
    quoted = P.score_context(
        spark.createDataFrame([("t", "it's a \\ here", "")], "pii_type string, prefix string, suffix string"),
        [C.Keyword("t", "positive", "it's a \\", 2.0, "before")],
    ).first()
    assert quoted.is_pii


def test_keyword_edits():
    words = C.default_keywords()
    own = [C.Keyword("email", "positive", "contact", 0.5), C.Keyword(C.GLOBAL, "anti", "draft", 0.5)]
    merged = P.merge_rulesets([words, own])
    assert [k.keyword for k in merged if k.pii_type == "email"] == ["contact"]
    assert len([k for k in merged if k.pii_type == C.GLOBAL]) == 11
    assert len(P.remove_keyword(words, "email", "email")) == len(words) - 1


def test_fallback_modes(spark):
    m = spark.createDataFrame([(1, "email", "", ""), (2, "email", "", "")], "id int, pii_type string, prefix string, suffix string")
    ext = spark.createDataFrame([(1, True, 0.9)], "id int, ext_is_pii boolean, ext_confidence double")
    got = {r.id: (r.is_pii, r.score_source) for r in P.score_with_fallback(m, ext, ["id"], C.default_keywords()).collect()}
    assert got == {1: (True, "external"), 2: (False, "keyword")}
    only = P.score_with_fallback(m, ext, ["id"], C.default_keywords(), "keyword_only").collect()
    assert not any(r.is_pii for r in only)
    try:
        P.score_with_fallback(m, ext, ["id"], C.default_keywords(), "fail_fast").collect()
        raise AssertionError("a missing verdict must fail the job")
    except Exception as e:
        assert "no external verdict" in str(e)


def test_doc_action_default(spark):
    df = P.with_matches(spark.createDataFrame([(1, "nothing")], "id int, text string"), "text", R.rules_jp())
    assert df.select(P.doc_action(F.col("matches"), "block")).first()[0] == "block"
