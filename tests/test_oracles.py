"""Every registered query outside the language-model subpackage against its SQL in DuckDB, on the smallest tables."""

import glob

import duckdb
import pytest

from tidemark import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1].removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(df, columns):
    def one(x):
        if x is None or x != x:
            return "null"
        return str(int(x)) if isinstance(x, float) and x == int(x) else str(x)

    return sorted(tuple(one(x) for x in row) for row in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLES:
        want = duck.execute(catalog.ORACLES[name]).fetchdf()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        assert plain(got, columns) == plain(want, columns)


def test_entry_names_match():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
