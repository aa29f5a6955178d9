"""The profile merged from batches equals the profile of all rows."""

import datetime as dt
import random

import pytest

from briskbi.operators import profile_state, summaries
from briskbi.streaming import incremental


def rows(n, seed):
    rng = random.Random(seed)
    return [(i, rng.gauss(1e6, 3) if i % 7 else None, rng.choice(["a", "b", "ccc", "é", None]), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(9999)),
             f"{rng.randrange(50)}", None) for i in range(n)]


SCHEMA = "id long, `v.x` double, kind string, at timestamp, code string, nothing string"


def test_merged_batches_equal_the_whole(spark, tmp_path):
    all_rows = rows(500, 1)
    state = str(tmp_path / "state")
    whole = spark.createDataFrame(all_rows, SCHEMA)
    types = {"id": "numeric", "v.x": "numeric", "kind": "text", "at": "datetime", "code": "numeric", "nothing": "text"}
    for i, (a, b) in enumerate([(0, 3), (3, 300), (300, 300), (300, 500)]):  # one batch is empty
        profile_state.update(spark.createDataFrame(all_rows[a:b], SCHEMA), state, i, types)
    profile_state.update(spark.createDataFrame(all_rows[3:300], SCHEMA), state, 1)  # tried again
    assert sorted(map(str, profile_state.profile(spark, state).collect())) == sorted(map(str, summaries.profile(whole, types).collect()))
    wrong = spark.createDataFrame([(1, "x")], "id long, `v.x` string")
    with pytest.raises(ValueError, match="schema mismatch: .*v.x double -> string"):
        profile_state.update(wrong, state, 9)


def test_stream_refuses_a_batch_of_other_types(spark, tmp_path):
    inbox, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    good = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")

    def run(schema):
        incremental.append_stream(incremental.file_stream(spark, inbox, schema), target, str(tmp_path / "c"), profile=state)

    good.write.parquet(inbox)
    run(good.schema)
    assert profile_state.profile(spark, state).count() == 2
    good.selectExpr("k", "v", "1 AS more").write.mode("append").parquet(inbox)
    with pytest.raises(Exception, match="schema mismatch"):
        run(good.selectExpr("k", "v", "1 AS more").schema)
    assert spark.read.parquet(target).count() == 2
