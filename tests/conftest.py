import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = os.environ.get("GRIDLOOM_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from gridloom.session import local_session

    session = local_session(cores=8, shuffle_partitions=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def larger_dir():
    """The next larger folder: the smallest has no day of 24 hours, so that most series queries would be held against nothing."""
    return DATA.replace("sf0.001", "sf0.01")


def views(folder):
    """DuckDB with a view for each table of a data folder."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="session")
def duck(sf_dir):
    return views(sf_dir)


def rounded(value):
    if hasattr(value, "asDict"):
        return {k: rounded(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [rounded(v) for v in value]
    return float(f"{value:.9g}") + 0.0 if isinstance(value, float) else value


def compared(con):
    """Asserts that a DataFrame and an SQL text give the same columns and rows; returns how many."""

    def check(df, sql):
        columns = sorted(df.columns)
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        want = sorted(repr([rounded(row[i]) for i in at]) for row in result.fetchall())
        got = sorted(repr([rounded(row[c]) for c in columns]) for row in df.collect())
        assert got == want
        return len(got)

    return check


@pytest.fixture(scope="session")
def same_rows(duck):
    return compared(duck)


@pytest.fixture(scope="session")
def same_rows_larger(larger_dir):
    return compared(views(larger_dir))
