"""Every core query that has SQL gives the SQL's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from loupe.plans import registry
from verify import canon


@pytest.fixture(scope="module")
def con(data_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for path in Path(data_dir).iterdir():
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data_dir, con, name):
    df = registry.queries()[name](spark, data_dir)
    rows = [tuple(r) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    con.execute(sql)
    columns = [d[0] for d in con.description]
    assert canon(rows, df.columns) == canon(con.fetchall(), columns)


def test_entry(spark, data_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_in_the_core_imports_the_llm_package():
    root = Path(__file__).resolve().parent.parent / "loupe"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "loupe.llm" not in path.read_text(), path
