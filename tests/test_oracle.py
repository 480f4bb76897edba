"""Every graph query against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from tessera import queries

DATA = Path("/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the generated tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, name):
    frame = queries.queries()[name](spark, str(DATA))
    found = table(frame.columns, frame.collect())
    cursor = duck.execute(queries.oracle_sql()[name])
    assert found == table([d[0] for d in cursor.description], cursor.fetchall())


def test_all_have_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())
