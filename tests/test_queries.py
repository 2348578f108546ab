"""Every registered query agrees with its SQL or, where it has none, with a plain version."""

import plain
import pytest
from conftest import normal

from tessera.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_names():
    assert registry.FLAGSHIP in QUERIES and set(SQL) <= set(QUERIES) and len(QUERIES) > 150


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(name, spark, sf, duck, same):
    same(QUERIES[name](spark, sf), duck, SQL[name])


@pytest.fixture(scope="module")
def data(sf):
    import pyarrow.parquet as pq

    return {t: pq.read_table(f"{sf}/{t}.parquet").to_pylist() for t in "documents embeddings pages benchmark labels conversations events".split()}


def test_all_are_checked():
    assert set(plain.CHECKS) == set(QUERIES) - set(SQL)


@pytest.mark.parametrize("name", sorted(plain.CHECKS))
def test_agrees_with_plain_version(name, spark, sf, data):
    """Queries that SQL can't express, against row-by-row Python over the same tables."""
    df = QUERIES[name](spark, sf)
    got = [r.asDict() for r in df.collect()]
    want = plain.CHECKS[name](got, data)
    if want is not None:
        rows = lambda found: sorted(normal([r[c] for c in df.columns]) for r in found)
        assert rows(got) == rows(want)
