"""What the plans must look like at scale."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewall.operators import audit as U
from tidewall.operators import pii as P
from tidewall.operators import policy as A
from tidewall.plans.flagship import protect_documents
from tidewall.rules.pii import rules_jp
from tidewall.session import spread


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.fixture
def docs(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = [(i, f"text {i} mail u{i}@corp.example", "en", i) for i in range(400)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, extra int").write.parquet(path)
    return spark.read.parquet(path)


def as_if_large(spark, df, fn):
    """Make splits tiny, so that the table looks large enough for every core."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        return plan(fn(df))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_flagship_reads_once_and_never_shuffles(spark, docs):
    text = as_if_large(spark, docs, protect_documents)
    assert "Exchange" not in text and text.count("Scan parquet") == 2  # once in the tree, once in the details
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_small_inputs_are_spread(spark, docs):
    assert "RoundRobinPartitioning" in plan(spread(docs))


def test_decisions_do_not_shuffle(spark, docs):
    rules = [A.PolicyRule("p", "permit", (A.Condition("lang", "eq", "en"),))]
    text = plan(A.abac_decide(docs.select("doc_id", "lang"), rules))
    assert "Exchange" not in text and "ReadSchema: struct<doc_id:bigint,lang:string>" in text


def test_filters_before_a_scan_reach_the_files(spark, docs):
    text = plan(P.pii_scan(docs.where("lang = 'en'"), ["doc_id"], "text", rules_jp()))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in text


def test_scan_results_are_not_computed_twice(spark, docs):
    found = P.with_matches(docs.select("doc_id", "text"), "text", rules_jp())
    text = found.where(F.size("matches") > 0)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract_all") == len(rules_jp())


def test_audit_filters_are_pushed(spark, tmp_path):
    path = str(tmp_path / "a")
    spark.createDataFrame([(1, "x", "a", dt.datetime(2024, 1, 1))], "event_id int, event_type string, actor_id string, ts timestamp").write.parquet(path)
    text = plan(U.audit_query(spark.read.parquet(path), event_type="x", start="2023-01-01 00:00:00"))
    assert "EqualTo(event_type,x)" in text
    stats = plan(U.audit_query(spark.read.parquet(path), event_type="x").select("event_id"))
    assert "ReadSchema: struct<event_id:int,event_type:string>" in stats


def test_small_rows_that_become_long_texts_are_dealt_out(spark):
    from tidewall.plans import catalog

    catalog.load_all()
    cells = catalog.QUERIES["S3_hard_csv"](spark, "/root/testdata/sf0.001")
    assert cells.select(F.spark_partition_id()).distinct().count() > 4


def test_documents_to_walk_are_dealt_out(spark):
    from tidewall.plans import catalog

    catalog.load_all()
    for name in ("F4_scan_xml", "F3_scan_json"):
        found = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert found.select(F.spark_partition_id()).distinct().count() > 4, name
