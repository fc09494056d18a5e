"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from loxogram.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Without rows on 200 parts; the driver compares them on larger tables.
NONE_HERE = {"join_intersection", "similarity_cosine", "similarity_jaccard", "similarity_sum", "stsj_multiset_textual"}
pytestmark = pytest.mark.usefixtures("plain_plans")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(registry.ORACLE_SQL[name]).df(), registry.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns) and (len(got) or name in NONE_HERE)
    rows = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))
    assert rows(want) == rows(got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 30
    assert set(entry.oracle_sql()) <= set(entry.queries())
