"""Every named query against its SQL twin on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
import pytest

from slatebed.plans.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__module__ == "numpy" and not isinstance(x, (bool,)) and hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x)

    return sorted(tuple(cell(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_every_page_of_a_source_is_read(spark):
    """Bodies that are no JSON of a source give no candidates, and null fields stay null."""
    from slatebed.sources import providers

    rows = spark.createDataFrame([("q", n, body) for n in providers.SPECS for body in ("no json", "[]", "{}", None, '{"results": null}')], "query string, source string, body string")
    assert all(providers.candidates_of(rows, n).count() == 0 for n in providers.SPECS)
