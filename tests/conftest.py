"""One local session for all tests; workers find the package through PYTHONPATH."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local_session

    session = local_session(4, "tests", 4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(x):
    """Values of both engines in one form; doubles to nine digits."""
    if isinstance(x, float):
        return repr(float(f"{x:.9g}"))
    if isinstance(x, (list, tuple)) or hasattr(x, "asDict"):
        return "[" + ",".join(normal(y) for y in x) + "]"
    return repr(x)


@pytest.fixture(scope="session")
def same():
    def check(df, con, sql):
        cols = sorted(df.columns)
        got = sorted(normal(list(r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
        names = ", ".join(f'"{c}"' for c in cols)
        want = sorted(normal(list(r)) for r in con.execute(f"SELECT {names} FROM ({sql})").fetchall())
        assert len(got) == len(want)
        assert got == want

    return check
