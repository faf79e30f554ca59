"""The driver contract: every query with its SQL on the smallest tables, and the entry without the optional parts."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from groundling.plans import catalog

SF = "/root/testdata/sf0.001"
SMALL = ["route_sources", "url_facts", "links_extract", "strip_html_pages", "pack_greedy", "claims_extract", "section_stats", "code_blocks", "repo_walk", "repo_trees", "verify_passages", "code_signatures", "notebooks_flat", "source_dispatch", "verification_reports"]


def canon(v):
    return repr(list(map(canon, v))) if isinstance(v, (list, tuple)) else repr(v)


@pytest.mark.parametrize("name", SMALL)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    rel = con.execute(catalog.ORACLE_SQL[name])
    at = [[d[0] for d in rel.description].index(c) for c in cols]
    assert got == sorted(tuple(canon(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["worst_sections", "guard_triggers", "verify_passages"])
def test_query_needs_no_python_worker(spark, name):
    assert "Python" not in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_pages_reach_python_in_small_batches(spark, tmp_path):
    import pandas as pd
    from pyspark.sql import functions as F

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    pages = spark.range(0, 400, 1, 1).selectExpr("id as page_id", "'u' as url", "'<p>' || repeat('word ', 10000) || '</p>' as html")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    texts = catalog.QUERIES["html_markdown"](spark, str(tmp_path))
    assert {len(r["markdown"]) for r in texts.collect()} == {49999}
    size = F.pandas_udf(lambda s: pd.Series([len(s)] * len(s)), "int", F.PandasUDFType.SCALAR)
    most = spark.read.parquet(f"{tmp_path}/pages.parquet").select(size("html").alias("n")).agg(F.max("n")).first()[0]
    spark.conf.unset(key)
    assert most * 50_000 <= 8 << 20
