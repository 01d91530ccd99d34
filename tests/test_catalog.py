"""Queries of the second catalog against their SQL on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from veil import catalog, catalog_more

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n, f in catalog.QUERIES.items() if f.__module__ == catalog_more.__name__ and n in catalog.ORACLE_SQL) + ["find_ssns_in_text", "redact_text", "dp_count", "dp_sum", "dp_gaussian"]


@pytest.fixture(scope="module")
def db():
    made = duckdb.connect()
    for t in ("customer", "documents", "events", "nation", "orders", "part", "supplier"):
        made.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


def shown(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    want, got = db.sql(catalog.ORACLE_SQL[name]), catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert shown(map(tuple, got.select(*(F.col(c) for c in want.columns)).collect())) == shown(want.fetchall())
