"""Every registered query equals DuckDB's answer or, without SQL, passes its plain check."""

import os

import duckdb
import pytest

from sparkloom.plans import catalog

from .brute_force import CHECKS

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return sorted(columns), sorted(plain, key=lambda r: tuple((x is None, str(type(x)), 0 if x is None else x) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = df.collect()
    if name not in catalog.ORACLE_SQL:
        CHECKS[name]([r.asDict() for r in found], SF)
        return
    r = duck.execute(catalog.ORACLE_SQL[name])
    assert _rows(df.columns, found) == _rows([d[0] for d in r.description], r.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
