"""The bucketed keyed table: touched buckets only, retries, nulls, schema checks, vacuum."""

import pytest

from briskbi.streaming import keyed_table as K

SCHEMA = "a int, b string, v string, at int"


def rows_of(spark, target):
    rows = [(r.a, r.b, r.v) for r in K.read(spark, target).collect()]
    assert len(rows) == len({r[:2] for r in rows})
    return {r[:2]: r[2] for r in rows}


def batch(spark, rows):
    return spark.createDataFrame([(a, b, v, i) for i, (a, b, v) in enumerate(rows)], SCHEMA).repartition(3)


def test_batches_rewrite_only_their_buckets(spark, tmp_path):
    target = str(tmp_path / "t")
    first = [(i, "x", "old") for i in range(1000)] + [(None, "x", "old"), (None, None, "old")]
    assert K.upsert(batch(spark, first), target, ["a", "b"], ["at"], 0, buckets=64) == list(range(64))
    want = {(a, b): v for a, b, v in first}
    assert rows_of(spark, target) == want
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "data").rglob("*.parquet")}

    second = [(i, "x", "new") for i in range(10)] + [(3, "x", "newest"), (None, "x", "new"), (7, "y", "new")]
    touched = K.upsert(batch(spark, second), target, ["a", "b"], ["at"], 1)
    assert 0 < len(touched) <= 12
    want.update({(a, b): v for a, b, v in second})
    assert rows_of(spark, target) == want
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "data").rglob("*.parquet")}
    assert {p: after[p] for p in files} == files  # nothing written before is touched
    made = {p.parent.name for p in after.keys() - files.keys()}
    assert made == {f"_bucket={b}" for b in touched}
    now, before = K.manifest(spark, target)["at"], K.manifest(spark, target, below=1)["at"]
    assert {int(b) for b in now if now[b] != before[b]} == set(touched)

    K.upsert(batch(spark, second), target, ["a", "b"], ["at"], 1)  # the batch again, as after a crash
    assert rows_of(spark, target) == want
    with pytest.raises(ValueError, match="schema mismatch: v string -> int"):
        K.upsert(spark.createDataFrame([(1, "x", 5, 9)], "a int, b string, v int, at int"), target, ["a", "b"], ["at"], 2)
    assert rows_of(spark, target) == want
    assert K.upsert(batch(spark, second).limit(0), target, ["a", "b"], ["at"], 3) == []
    assert K.vacuum(spark, target, keep=1) == 1  # the first try of batch 1
    assert rows_of(spark, target) == want and K.manifest(spark, target, below=3) is None


def test_keys_only_and_empty_tables(spark, tmp_path):
    target = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no table"):
        K.read(spark, target)
    keys = spark.createDataFrame([(1,), (1,), (2,), (None,)], "`k.x` int")
    K.upsert(keys.limit(0), target, ["k.x"], [], 0, buckets=3)
    assert K.read(spark, target).collect() == [] and K.read(spark, target).columns == ["k.x"]
    K.upsert(keys, target, ["k.x"], [], 1)
    K.upsert(keys.where("`k.x` = 2"), target, ["k.x"], [], 2)
    assert sorted(K.read(spark, target).collect(), key=str) == sorted([(1,), (2,), (None,)], key=str)
