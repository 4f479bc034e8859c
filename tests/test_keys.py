"""Keys spelled in other ways: queries over the given tables against their SQL over tables whose keys are bare identifiers."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "scripts"))
import __spark_entry__ as entry
from compare import plain

SF = "/root/testdata/sf0.01"
BARE = r"lower(regexp_replace({0}, '^[\s{{}}]+|[\s{{}}]+$', '', 'g')) AS {0}".format
READ_ID = r"regexp_replace(lower(regexp_replace(read_id, '[{}-]', '', 'g')), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS read_id"
KEYS = {"read_rows": BARE("run_info"), "run_info": BARE("acquisition_id"), "file_records": BARE("acquisition_id") + ", " + READ_ID}


@pytest.fixture(scope="module")
def bare():
    found = duckdb.connect()
    found.sql("SET timezone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        changed = f" REPLACE ({KEYS[p.stem]})" if p.stem in KEYS else ""
        found.sql(f"CREATE VIEW {p.stem} AS SELECT *{changed} FROM '{p}'")
    return found


@pytest.mark.parametrize("name", ["view_all", "view_pruned", "container_round_trip", "unknown_run_infos", "distinct_run_infos", "subset_route", "subset_sizes", "merge_union", "debug_summary", "template_dest"])
def test_bare_keys(spark, bare, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(plain, r)) for r in df.select(*[df[c] for c in columns]).collect())
    theirs = bare.sql(entry.oracle_sql()[name])
    assert ours == sorted(tuple(map(plain, r)) for r in theirs.select(*[f'"{c}"' for c in columns]).fetchall())
    print(name, len(ours), "rows")
