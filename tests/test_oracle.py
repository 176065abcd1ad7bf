"""Each query of the catalogue that has SQL, against DuckDB on the same tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pytest

from framequarry.plans import batched, catalogue, chains, further, media, motion, outlines, projects

assert batched and chains and further and media and motion and outlines and projects  # they add their queries to the catalogue

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(frame, columns):
    plain = lambda v: None if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, (float, np.floating)) else str(v)
    return sorted(tuple(map(str, map(plain, r))) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_agrees_with_duckdb(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, FOLDER).toPandas(), duck.sql(catalogue.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0
