"""Every query that has SQL gives what DuckDB gives."""

import math

import duckdb
import pytest

from loomgeno.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def value(x):
        if isinstance(x, float) and not isinstance(x, bool):
            return "nan" if math.isnan(x) else round(x, 5)
        return x

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck(sf):
    # A query that runs away fails by itself rather than with the whole suite.
    con = duckdb.connect(config={"memory_limit": "3GB", "threads": 4, "max_temp_directory_size": "4GB"})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    c = duck.execute(registry.oracle_sql()[name])
    columns = [x[0] for x in c.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(c.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    # The smallest tables have no duplicates; test_kernels has some.
    assert len(df.collect()) > 0 or name == "duplicate_bins"
