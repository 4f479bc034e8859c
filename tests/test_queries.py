"""Every query against its SQL on the smallest tables, with many partitions."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "scripts"))
import __spark_entry__ as entry
from compare import plain

SF = "/root/testdata/sf0.001"
CORE = {name: f for part in entry._PARTS[:3] for name, f in part.queries().items()}


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    found.sql("SET timezone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        found.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return found


@pytest.mark.parametrize("name", list(CORE))
def test_query(spark, db, name):
    df = CORE[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(plain, r)) for r in df.select(*[df[c] for c in columns]).collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        rel = db.sql(sql)
        assert columns == sorted(rel.columns)
        assert ours == sorted(tuple(map(plain, r)) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
