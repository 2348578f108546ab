"""Queries on small tables with rows that the given ones lack, against their SQL and results worked out by hand."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.plans import registry


@pytest.fixture
def on_lineitem(spark, tmp_path, same):
    """Rows of a query on a made ``lineitem``, compared with its SQL."""

    def rows(name: str, columns: dict[str, pa.Array]) -> list[tuple]:
        pq.write_table(pa.table(columns), tmp_path / "lineitem.parquet")
        con = duckdb.connect(config={"threads": 1})
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
        df = registry.queries()[name](spark, str(tmp_path))
        same(df, con, registry.oracle_sql()[name])
        return [tuple(r) for r in df.collect()]

    return rows


def test_parse_violations_beyond_third_word(on_lineitem):
    """Words of any number count: sound and broken sentences that are alike in their first three words."""
    sentences = {1: [1, 2, 3, 4, 5, 6, 7], 2: [1, 2, 3, 14], 3: [1, 2, 4, 8, 16, 16, 33], 4: [1, 12, 6], 5: [5], 6: [4, 1, 2], 7: [1, None], None: [1, 2]}
    pairs = [(s, w) for s, words in sentences.items() for w in words]
    got = on_lineitem("x30_parse_violations", {"l_orderkey": pa.array([s for s, _ in pairs], pa.int64()), "l_linenumber": pa.array([w for _, w in pairs], pa.int32())})
    assert sorted(got, key=str) == sorted(
        [("roots", 5), *[("head_missing", s) for s in (2, 4, 5, None)], *[("unreached", s) for s in (2, 4, 5, 7, None)]], key=str
    )


def test_coalesced_spans_of_odd_quantities(on_lineitem):
    """Quantities are rounded, halves to even; spans without an end follow those with one, and begin no island that these reach."""
    lines = [
        (1, 1, 2.7), (1, 2, 1.0), (2, 1, 2.5), (2, 2, 1.0), (3, 1, 3.5), (4, 1, None), (4, 1, 2.0), (4, 2, None), (5, None, 3.0), (5, 1, 4.0), (6, 1, -3.0), (6, 1, -3.0), (None, 1, 1.0),
    ]
    id, line, quantity = zip(*lines, strict=True)
    got = on_lineitem("t30_coalesced_spans", {"l_orderkey": pa.array(id, pa.int64()), "l_linenumber": pa.array(line, pa.int32()), "l_quantity": pa.array(quantity, pa.float64())})
    want = [(1, 3, 7), (2, 3, 5), (2, 6, 7), (3, 3, 7), (4, 3, 5), (4, 6, None), (5, 3, 7), (5, None, None), (6, 3, 0), (6, 3, 0), (None, 3, 4)]
    assert sorted(got, key=str) == sorted(want, key=str)
