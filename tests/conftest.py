import os
import sys

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import session

    out = session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g",
        spark__ui__showConsoleProgress="false", spark__driver__host="127.0.0.1",
    )
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()


@pytest.fixture(scope="session")
def duck():
    out = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        out.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return out


def rows_of(frame):
    """Rows as sorted tuples of comparable values, columns by name."""
    columns = sorted(frame.columns)

    def plain(v):
        if pd.isna(v):
            return "null"
        return repr(round(float(v), 5) + 0.0) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iufb" else str(v)

    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))
