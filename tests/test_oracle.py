"""Every registered query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from palimpsest.plans import oracle, parts
from palimpsest.plans.queries import QUERIES
from tests.conftest import DATA

ORACLE = oracle.ORACLE | parts.ORACLE
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as from '{DATA}/{f}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(float(x), 5) + 0.0 if isinstance(x, (int, float)) or hasattr(x, "as_integer_ratio") else x
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in values), key=lambda r: tuple((x is not None, str(type(x)), x) if x is not None else (False, "", 0) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cur = db.execute(ORACLE[name])
    want = rows([c[0] for c in cur.description], cur.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
