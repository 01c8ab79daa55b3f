"""Every registered query with SQL gives the rows of that SQL in DuckDB."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry  # noqa: E402
from compare import canon  # noqa: E402

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for p in Path(DIR).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, DIR)
    rel = con.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    assert canon([tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]) == canon([tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()])


def test_entry_and_names(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
