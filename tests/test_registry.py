"""Names of queries, and the SQL of a few on the smallest tables."""

import os
from collections import Counter

import pytest

DATA = "/root/testdata/sf0.001"


def test_names():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert len(q) > 90 and set(s) <= set(q)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["agg3_top_words", "w2_top_bigrams", "flt1_composite_filter", "agg12_city_rollup", "fts6_rank_terms", "j12_related", "ts5_contexts"])
def test_sql_agrees(spark, name):
    import glob

    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.sql(e.oracle_sql()[name])
    cols = sorted(want.columns)
    got = Counter(tuple(r) for r in e.queries()[name](spark, DATA).select(*cols).collect())
    assert got == Counter(want.project(", ".join(cols)).fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["agg20_subcorpus_tokens", "agg9_corpus_tokens"])
def test_token_totals_count_tokens(spark, name):
    import __spark_entry__ as e

    test_sql_agrees(spark, name)
    assert "length(coalesce(body_text" not in e.oracle_sql()[name]
