"""The queries with SQL against it on the smallest tables."""

import duckdb
import pytest

from lectern.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_like_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns)
    normal = lambda rows: sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in rows)
    assert normal(map(tuple, got.collect())) == normal(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_without_sql_runs_over_the_whole_table(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    out = queries.QUERIES[name](spark, SF)
    if name == "op6_pack_tokens":
        ids = {d for r in out.select("doc_ids").collect() for d in r["doc_ids"]}
        assert ids == {r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 0").select("doc_id").collect()}
    else:
        assert out.count() == n
