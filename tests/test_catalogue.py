"""Every registered query with SQL against DuckDB on the smallest tables. What the others return, other tests compare with plain versions."""

import os

import duckdb
import pytest

from quillgraph.plans import queries as catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Tests that compare these with plain versions: test_evaluation, test_local, test_training, test_functions.
COMPARED_ELSEWHERE = {
    "paragraph_metrics_with_ratio", "context_metrics", "local_graph", "local_injection", "positive_sentences", "plain_markdown_clauses", "tiered_negatives",
    "method_self_reflective", "method_corrective", "method_clause_graph", "alignment_with_sequence_ratio", "lr_router",
}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name not in catalogue.ORACLES:
        assert name in COMPARED_ELSEWHERE and len(got)
        return
    want = duck.sql(catalogue.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (x[columns].sort_values(columns, ignore_index=True) for x in (got, want))
    assert len(got) == len(want)
    for c in columns:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        if got[c].dtype.kind == "f" and want[c].dtype.kind in "fi":
            same |= (got[c] - want[c]).abs() < 1e-9
        assert same.all(), (c, got[~same].head(2), want[~same].head(2))
