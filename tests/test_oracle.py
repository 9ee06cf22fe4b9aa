"""The core queries against their SQL on the smallest tables; the driver does so on larger ones."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from lapwing.plans import oracle, queries

DATA = os.environ.get("LAPWING_TEST_DATA", "/root/testdata/sf0.001")
QUICK = ["sentence_split", "token_bag", "sentinel_hits", "melon_cosine", "threat_report", "paren_citations", "numeric_citations", "reference_parse", "claim_alignment", "candidates_pass1", "candidates_relaxed", "judge", "enhanced_jw", "field_similarity", "verdict_label", "liveness", "hrs_presets", "bibtex", "dense_search", "top_matches", "verdict_counts", "verdict_alignment", "audited_text", "valid_requests", "action_tokens", "title_windows", "malicious_labels"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def said(v):
    return f"{float(v):.5f}" if type(v).__name__ in ("float", "Decimal") else str(v)


@pytest.mark.parametrize("name", QUICK)
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("registry", "citations_flat", "manuscripts", "url_status", "documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    ours = queries.queries()[name](spark, DATA)
    theirs = con.sql(oracle.oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    order = [list(ours.columns).index(c) for c in sorted(ours.columns)], [list(theirs.columns).index(c) for c in sorted(theirs.columns)]
    a = Counter(tuple(said(r[i]) for i in order[0]) for r in map(tuple, ours.collect()))
    b = Counter(tuple(said(r[i]) for i in order[1]) for r in theirs.fetchall())
    assert a == b and a


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
