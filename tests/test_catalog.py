"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from lodestack.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(name, spark, sf, duck):
    found = catalog.QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    rows = sorted(repr(tuple(map(plain, r))) for r in found.select(*columns).collect())
    result = duck.execute(catalog.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(name, spark, sf):
    assert catalog.QUERIES[name](spark, sf).columns


def test_outline_match_covers_every_element(spark, sf):
    from pyspark.sql import functions as F

    from lodestack.functions import text
    from lodestack.sources import adapters

    heads = adapters.html_elements(spark.read.parquet(f"{sf}/pages.parquet")).where("kind <> 'list'")
    want = {(r.page_id, r.pos) for r in heads.where(text.norm_title(F.col("text")) != "").select("page_id", "pos").collect()}
    found = catalog.QUERIES["outline_match"](spark, sf).collect()
    assert {(r.doc_id, r.pos) for r in found} == want and len(found) == len(want) == len({(r.doc_id, r.entry) for r in found})


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(catalog.SQL) <= set(entry.oracle_sql()) and set(catalog.QUERIES) <= set(entry.queries())
