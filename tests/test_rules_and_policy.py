import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewall.functions.net import cidr_high, cidr_low, in_cidr, ip_to_long, network_class
from tidewall.operators import policy as A
from tidewall.operators import secrecy as K
from tidewall.operators import structured as S
from tidewall.rules import fields as FR
from tidewall.rules.secrecy import LEVELS, RULES, SecrecyRule, secrecy_scheme
from tidewall.sources.rules import load_rules


def level(spark, types, scheme=None):
    df = spark.createDataFrame([(types,)], "t array<string>")
    return K.classify_secrecy(df, "t", scheme or secrecy_scheme()).first()


@pytest.mark.parametrize(
    "types,want",
    [
        (["national_id"], "critical"), (["credit_card"], "critical"), (["email"], "medium"), ([], "public"),
        (["full_name", "address", "phone"], "critical"), (["unknown"], "medium"), (None, "public"), (["phone"], "high"),
        (["employee_id"], "low"),
    ],
)
def test_secrecy_levels(spark, types, want):
    assert level(spark, types).level_id == want


def test_conflict_modes(spark):
    assert level(spark, ["phone"], secrecy_scheme(conflict="lowest")).level_id == "medium"
    assert level(spark, ["phone"], secrecy_scheme(conflict="first")).level_id == "high"
    both = secrecy_scheme(LEVELS, [SecrecyRule("r", "low", "x", exclude_any=("a", "b"))], fallback="high")
    assert level(spark, ["a"], both).level_id == "low" and level(spark, ["a", "b"], both).level_id == "high"
    with pytest.raises(ValueError):
        secrecy_scheme(LEVELS, (*RULES, RULES[0]))


def test_filter_on_level_keeps_the_plan_small(spark):
    df = spark.createDataFrame([(["email"],)], "t array<string>")
    out = K.classify_secrecy(df, "t", secrecy_scheme()).where("level_id = 'medium'")
    assert out.count() == 1
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 40_000


R, C = A.PolicyRule, A.Condition


def decide(spark, rules, **attrs):
    names = list(attrs)
    df = spark.createDataFrame([tuple(attrs[n] for n in names)], ", ".join(f"{n} string" for n in names))
    return A.abac_decide(df, rules).first()


def test_deny_overrides(spark):
    rules = [R("low-p", "permit", (C("role", "eq", "admin"),), 1), R("high-d", "deny", (C("role", "eq", "admin"),), 100)]
    got = decide(spark, rules, role="admin")
    assert (got.effect, got.matched_rule_id, got.evaluated_rules) == ("deny", "high-d", 1)
    flipped = [R("p", "permit", (), 100), R("d", "deny", (), 1)]
    got = decide(spark, flipped, role="x")
    assert (got.effect, got.matched_rule_id, got.evaluated_rules) == ("deny", "d", 2)
    got = decide(spark, [R("off", "permit", (), 1, enabled=False)], role="x")
    assert (got.effect, got.matched_rule_id, got.evaluated_rules) == ("deny", None, 0)


def test_missing_attribute_is_false(spark):
    for op, value in (("neq", "a"), ("not_in", ("a",)), ("eq", "a"), ("regex", ".*"), ("gt", 1)):
        assert decide(spark, [R("p", "permit", (C("role", op, value),))], role=None).effect == "deny"
    assert decide(spark, [R("p", "permit", (C("role", "regex", "("),))], role="x").effect == "deny"


def test_addresses(spark):
    df = spark.createDataFrame([("10.0.0.1",), ("256.1.1.1",), ("1.2.3",), (None,), ("172.31.9.9",), ("172.32.0.1",)], "ip string")
    rows = df.select(ip_to_long(F.col("ip")).alias("n"), in_cidr(F.col("ip"), "10.0.0.0/8").alias("c"), network_class(F.col("ip")).alias("k")).collect()
    assert [r.n for r in rows][:4] == [167772161, None, None, None]
    assert [r.c for r in rows] == [True, False, False, False, False, False]
    assert [r.k for r in rows][4:] == ["corporate-lan", "unknown"]
    assert df.select(in_cidr(F.col("ip"), "bad/8")).first()[0] is False
    b = spark.createDataFrame([("192.168.5.77/24",), ("1.2.3.4",), ("0.0.0.0/0",)], "c string")
    got = b.select(cidr_low(F.col("c")).alias("a"), cidr_high(F.col("c")).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(3232236800, 3232237055), (16909060, 16909060), (0, 4294967295)]


def test_time_window_and_days(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 15, 9, 0),), (dt.datetime(2024, 1, 14, 17, 0),)], "ts timestamp")
    got = df.select(A.in_time_window(F.col("ts"), (9, 0), (17, 0)), A.in_day_mask(F.col("ts"), A.day_mask([1]))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False)]


def test_field_names(spark):
    maps = [*FR.default_mappings(), FR.FieldMapping("*mail*", "mailish", 0.5)]
    names = ["Full_Name", "NAME", "surname", "order_id", "webmailer", "email", "ID"]
    df = spark.createDataFrame([(n,) for n in names], "field string")
    got = {r.field: r.pii_type for r in S.classify_fields(df, maps).collect()}
    assert got == {
        "Full_Name": "full_name", "NAME": "full_name", "surname": "unknown", "order_id": "generic_id", "webmailer": "mailish",
        "email": "email", "ID": "unknown",
    }
    assert set(S.match_columns(names, maps)) == {"Full_Name", "NAME", "order_id", "webmailer", "email"}


def test_scan_json_paths(spark):
    doc = '{"email":"a@b.c","n":{"phone":["1"],"kids":[{"full_name":"Z","age":3}]},"x":"y","tel":5,"arr":["email"]}'
    df = spark.createDataFrame([(1, doc), (2, "not json"), (3, None)], "id int, doc string")
    got = {(r.id, r.path, r.value) for r in S.scan_json(df, "id", "doc", FR.default_mappings()).collect()}
    assert got == {(1, "email", "a@b.c"), (1, "n.kids[0].full_name", "Z"), (2, None, None)}
    flat = {r.path for r in S.scan_json(df, "id", "doc", FR.default_mappings(), arrays=False).collect()}
    assert flat == {"email", None}


def test_scan_xml(spark):
    doc = '<r><full_name>A</full_name><p email="x@y.z">t</p><q ssn="1"/></r>'
    df = spark.createDataFrame([(1, doc), (2, "<broken")], "id int, doc string")
    got = {(r.path, r.value) for r in S.scan_xml(df, "id", "doc", FR.default_mappings()).collect()}
    assert got == {("r/full_name", "A"), ("r/p/@email", "x@y.z"), ("r/q/@ssn", "1"), (None, None)}
    parity = {r.path for r in S.scan_xml(df, "id", "doc", FR.default_mappings(), attributes="empty_elements").collect()}
    assert parity == {"r/full_name", "r/q/@ssn", None}


def test_rule_files(spark, tmp_path):
    good = tmp_path / "s.yaml"
    good.write_text(
        "levels:\n  top: {rank: 2}\n  low: {rank: 0}\n"
        "classification_rules:\n  - {id: a, condition: {require_any_of: [email], exclude_all_of: [phone]}, result: {level: top}}\n"
        "  - {id: b, condition: {pii_types_present: []}, result: {level: low}}\n"
        "fallback: {unknown_default: low}\n"
    )
    scheme = load_rules(spark, str(good), "secrecy")
    assert level(spark, ["email"], scheme).level_id == "top" and level(spark, [], scheme).level_id == "low"
    bad = tmp_path / "b.yaml"
    bad.write_text("levels: 3")
    with pytest.raises(ValueError):
        load_rules(spark, str(bad), "secrecy")
    policy = tmp_path / "p.json"
    policy.write_text('{"rules":[{"id":"x","effect":"allow"}]}')
    with pytest.raises(ValueError):
        load_rules(spark, str(policy), "policy")


def test_json_of_any_depth_keeps_what_lies_above_the_limit():
    import json
    import random

    from tidewall.functions import markup

    deep = '{"email":"a@b.c","x":' + "[" * 20_000 + '{"y":"z"}' + "]" * 20_000 + ',"after":{"phone":"1"}}'
    status, found = markup.json_leaves(deep, 10, True)
    assert status == "depth_exceeded" and sorted(found) == [("after.phone", "phone", "1"), ("email", "email", "a@b.c")]
    assert markup.json_leaves(deep[:-1], 10, True) == ("malformed", [])
    assert markup.json_leaves(deep + "]", 10, True) == ("malformed", [])

    def value(rng, depth):
        kind = rng.randrange(9 if depth else 6)
        if kind >= 6:
            n = rng.randrange(4)
            return [value(rng, depth - 1) for _ in range(n)] if kind == 6 else {rng.choice("abcé\\\"") * rng.randrange(3): value(rng, depth - 1) for _ in range(n)}
        return rng.choice([None, True, 1.5, -3, 2e20, "s", "é\n\"", ""])

    def strings_only(x):
        if isinstance(x, dict):
            return {k: strings_only(v) for k, v in x.items()}
        if isinstance(x, list):
            return [strings_only(v) for v in x]
        return x if isinstance(x, str) else None

    rng = random.Random(4)
    for _ in range(500):
        text = json.dumps(value(rng, 4), indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        assert markup._deep_json(text) == strings_only(json.loads(text))
        cut = text[: rng.randrange(len(text))] + rng.choice(["", ",", "}", "]", "x", '"', ":"]) + text[rng.randrange(len(text)) :]
        try:
            want = strings_only(json.loads(cut, parse_constant=markup._no_constant))
        except ValueError:
            want = ValueError
        try:
            got = markup._deep_json(cut)
        except ValueError:
            got = ValueError
        assert got == want, cut


def test_patterns_are_checked_by_the_engine_that_runs_them(spark):
    from tidewall.functions.patterns import regex_error
    from tidewall.operators import policy
    from tidewall.rules import pii

    for good in ("(?<year>[0-9]{4})", "[a-z&&[^b]]+", "\\p{IsHiragana}+", "a++"):
        assert regex_error(good) is None
        assert pii.valid_rules([pii.TextRule("r", good, "mask")])
    for bad in ("(?P<year>[0-9]{4})", "(", "[a", "a**"):
        assert regex_error(bad)
        assert not pii.valid_rules([pii.TextRule("r", bad, "mask")])
        assert spark.range(1).select(policy.cond_regex(F.lit("2024"), bad).alias("x")).first().x is False
    assert regex_error("a*") == "pattern matches the empty string"
    df = spark.createDataFrame([("b",), ("a",)], "s string")
    assert {r.s: r.x for r in df.select("s", policy.cond_regex(F.col("s"), "^[a-z&&[^b]]$").alias("x")).collect()} == {"a": True, "b": False}
    assert df.select(policy.cond_regex(F.col("s"), "z*").alias("x")).first().x
