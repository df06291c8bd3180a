import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from lattica.session import session

    s = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SMALL}/{name}'")
    return con


def rows_of(df):
    """Rows with columns by name, in order, comparable between engines."""
    import pandas as pd

    cols = sorted(df.columns)

    def cell(v):
        if not isinstance(v, (list, dict)) and pd.isna(v):
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        return f"{float(v):.9g}" if hasattr(v, "dtype") or isinstance(v, (int, float)) else str(v)

    return cols, sorted(tuple(cell(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def compared():
    return rows_of
