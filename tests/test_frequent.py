"""Value counts and profiles from hashes against brute force; column names with dots."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from briskbi.operators import summaries


def brute(rows, k):
    out = []
    for c, values in rows.items():
        ranked = sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0].encode()))[:k]
        out += [(c, v, n, i + 1) for i, (v, n) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("most", [100_000, 0])
def test_top_values_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(summaries, "MOST_CANDIDATES", most)
    rng = random.Random(1)
    n = 600
    rows = {
        "a.b": [rng.choice(["x", "y", "z", "é", "", None]) for _ in range(n)],
        "unique": [f"https://www.example.org/a/long/path/{i:05d}" for i in rng.sample(range(n), n)],  # ties beyond the prefix
        "thrice": [f"{i % 200:03d}" for i in range(n)],
        "hot": ["same"] * n,
        "none": [None] * n,
        "few": [f"value {rng.choice('aabbbcd')} with a common beginning" if rng.random() < 0.2 else f"rare {i}" for i in range(n)],
    }
    df = spark.createDataFrame(list(zip(*rows.values())), ", ".join(f"`{c}` string" for c in rows)).repartition(5)
    got = summaries.top_values(df, k=4)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4)
    shares = {r["column"]: r.unique_ratio for r in summaries.profile(df, {c: "text" for c in rows}).collect()}
    assert shares == {c: round(len({v for v in values if v is not None}) / n, 4) for c, values in rows.items()}


def test_no_text_is_shuffled(spark):
    df = spark.range(1000).select(F.concat(F.lit("some long text value "), "id").alias("t"))
    plan = summaries.top_values(df, k=3)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_dotted_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1.0, "x", 2), (2.0, "y", 5), (4.0, None, 9)], "`m.x` double, `t.y` string, `n` int")
    assert {r["column"] for r in summaries.numeric_summary(df).collect()} == {"m.x", "n"}
    assert {r["column"]: r.null_ratio for r in summaries.profile(df).collect()} == {"m.x": 0.0, "t.y": 0.3333, "n": 0.0}
    twice = df.unionByName(df.limit(1)).unionByName(spark.createDataFrame([(None, "x", 2), (2.0, None, 5)], df.schema))
    assert summaries.quality(twice).first().duplicate_rows == 1
    assert [r.source for r in summaries.correlations(df).collect()] == ["m.x"]
    assert summaries.null_percentages(df).count() >= 1
    assert summaries.profile(df.limit(0)).count() == 3
    assert summaries.top_values(df.select("n")).collect() == []
