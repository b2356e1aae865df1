"""Registered queries against their DuckDB statements.

All of them run when TIDEWALL_ALL is set; a cross-section otherwise.
"""

import os

import pytest

from tidewall.plans import catalog
from tidewall.plans.check import compare

SF = os.environ.get("TIDEWALL_SF", "/root/testdata/sf0.001")
catalog.load_all()
SAMPLE = (
    "P1_pii_scan", "P7_redact_text", "P12_score_context", "K2_classify_secrecy", "F2_scan_table", "A8_abac_decide", "L12_tally_votes",
    "U4_audit_stats", "U15_sessions", "I4_envelopes", "T9_scan_markup", "T23_verdict_consensus", "N2_shortest_path", "C7_business_days",
    "X1_stream_pii", "E6_sql_functions", "flagship_protect_documents",
)
NAMES = list(catalog.QUERIES) if os.environ.get("TIDEWALL_ALL") else SAMPLE


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    ok, note = compare(spark, SF, name, catalog.QUERIES[name], catalog.ORACLES.get(name))
    assert ok, note


def test_every_query_is_named_after_the_survey():
    import re

    ids = {m.group(1) for m in (re.match(r"([A-Z]\d+)_", n) for n in catalog.QUERIES) if m}
    want = {f"{k}{i}" for k, n in {"S": 12, "P": 19, "K": 6, "F": 9, "A": 21, "L": 15, "U": 15, "I": 16, "T": 31, "N": 17, "C": 7, "X": 10, "E": 6}.items() for i in range(1, n + 1)}
    assert want - ids == set()


def test_long_texts_are_scanned_whole(spark, tmp_path):
    rows = [(i, "word " * 10_000) for i in (0, 1, 11)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.token, r.offset) for r in catalog.QUERIES["T11_scan_whole"](spark, str(tmp_path)).collect()}
    assert got == {(0, "javascript", 50_010), (1, "open_action", 50_010), (11, "submit_form", 50_010)}
