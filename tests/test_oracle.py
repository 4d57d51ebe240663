"""Every registered query with SQL gives DuckDB's rows."""

import pytest

from tuplewise.plans.registered import QUERIES, SQL

from .compare import differences


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    assert differences(spark, QUERIES[name], SQL[name], "sf0.001")[:3] == (True, [], [])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["n_name", "suppliers", "cents"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_import_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 50"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)
