"""Every query with SQL gives the rows that DuckDB gives."""

import pytest

from lattica import plans

SQL = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(name, spark, small, duck, compared):
    assert compared(plans.queries()[name](spark, small).toPandas()) == compared(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(SQL)))
def test_runs(name, spark, small):
    assert plans.queries()[name](spark, small).count() > 0


def test_entry_works_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['lattica.llm'] = None; import __spark_entry__ as e; assert e.llm is None and 'win_matrix' in e.queries() and not any(k.startswith('op1_') for k in e.queries())"
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)
