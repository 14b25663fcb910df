"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from walkspark.jobs import catalogue, page_queries  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in os.listdir(SF):
        out.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return out


def _rows(rows):
    return sorted((tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    made = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in made.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    assert _rows(df.collect()) == _rows([r[i] for i in order] for r in made.fetchall())


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
