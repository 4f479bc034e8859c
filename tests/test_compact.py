import random

import pytest
from conftest import rows
from strandlake.operators import compact

SCHEMA = "record_id bigint, file_id bigint, read_id string, acquisition_id string, n_bytes bigint, out_file string"


def data(n=900):
    rng = random.Random(7)
    out = []
    for k in range(n):
        digits = f"{0 if rng.random() < 0.4 else rng.randrange(60):032x}"
        dashed = f"{digits[:8]}-{digits[8:12]}-{digits[12:16]}-{digits[16:20]}-{digits[20:]}"
        read = rng.choice([digits, digits.upper(), dashed, "{" + dashed.upper() + "}", None, "no id"])
        out.append((k, k % 7, read, rng.choice(["a", "A ", "{b}", None]), rng.choice([None, 10, 30]), "clash"))
    return out


def brute(table, target):
    key = lambda r: (r[3].strip(" {}").lower() if r[3] is not None else None, r[2].strip("{}").replace("-", "").lower() if r[2] not in (None, "no id") else r[2])
    seen, kept = set(), []
    for r in sorted(table):
        if r[2] is None or key(r) not in seen:
            seen.add(key(r))
            kept.append(r)
    files, sums = {}, {}
    order = lambda r: (key(r)[0] is not None, key(r)[0] or "", key(r)[1] is not None, key(r)[1] or "", r[0])
    for r in sorted(kept, key=order):
        a = key(r)[0]
        f = (a, sums.get(a, 0) // target)
        n, b = files.get(f, (0, 0))
        files[f] = (n + 1, b + (r[4] or 0))
        sums[a] = sums.get(a, 0) + (r[4] or 0)
    return sorted({r[0] for r in table} - {r[0] for r in kept}), sorted(((*k, *v) for k, v in files.items()), key=repr)


def test_against_brute_force(spark, tmp_path):
    table = data()
    left, files = brute(table, 500)
    df = spark.createDataFrame(table, SCHEMA)
    assert sorted(r[0] for r in rows(compact.left_out(df))) == left
    target = f"file://{tmp_path}/out"
    for _ in range(2):  # the second time over what is there
        manifest = compact.compact(spark, df, target, 500)
        assert rows(manifest) == files
    written = spark.read.parquet(target)
    assert sorted(r[0] for r in written.select("record_id").collect()) == sorted({r[0] for r in table} - set(left))
    assert len([p for p in (tmp_path / "out").rglob("*.parquet")]) == len(files)


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    assert rows(compact.left_out(df)) == []
    assert rows(compact.compact(spark, df, f"file://{tmp_path}/none")) == []


def test_nothing_is_swapped_if_counts_differ(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(data(50), SCHEMA)
    target = f"file://{tmp_path}/out"
    compact.compact(spark, df, target)
    before = spark.read.parquet(target).count()
    real = compact.placed_records
    monkeypatch.setattr(compact, "placed_records", lambda r, t: real(r, t).filter("record_id > 5"))
    with pytest.raises(compact.LostRecords):
        compact.compact(spark, df, target)
    assert spark.read.parquet(target).count() == before
