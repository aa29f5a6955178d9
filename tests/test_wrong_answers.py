"""Cases that once gave wrong answers: nested JSON, prose as identifiers, large totals, one bad detector."""

import json

from pyspark.sql import functions as F

from briskbi.functions import text
from briskbi.operators import charts, ranking, signals
from briskbi.sources import files


def test_json_keeps_null_keys_and_cleans_nested_values(spark):
    nan, inf = float("nan"), float("inf")
    schema = "`a.b` int, c double, d array<double>, e struct<x: double, y: array<struct<z: double>>>, f map<string, double>, g binary"
    rows = [(1, None, [nan, 1.0, None], (inf, [(nan,), (2.0,)]), {"k": -inf, "l": 1.0}, b"\xc3\xa9"), (None, nan, None, None, None, b"\xff")]
    got = [json.loads(r.row) for r in files.to_json_rows(spark.createDataFrame(rows, schema).coalesce(1)).collect()]
    assert got[0] == {"a.b": 1, "c": None, "d": [None, 1.0, None], "e": {"x": None, "y": [{"z": None}, {"z": 2.0}]}, "f": {"k": None, "l": 1.0}, "g": "é"}
    assert got[1] == {"a.b": None, "c": None, "d": None, "e": None, "f": None, "g": "\ufffd"}


def test_only_identifiers_are_spaced(spark):
    cases = {
        "McDonald re-entry on 2024-01-01, iPhone and PayPal": "McDonald re entry on 2024-01-01, iPhone and PayPal",
        "marketing_timeseries Spend-vs-Cost": "marketing timeseries Spend vs Cost",
        "revenueByMarketingChannel": "revenue By Marketing Channel",
        "snake_camelCase_mix KPI_KPIList": "snake camel Case mix KPI KPI List",
        "'spend_vs_cost' stays \u201cas it is\u201d": "spend vs cost stays as it is",
        "3a_b éa_b _x a_ b--c 10-year-old": "3a_b éa_b _x a_ b--c 10-year old",
        "GitHubActions RegionNameList": "Git Hub Actions Region Name List",
        "": "",
    }
    got = spark.createDataFrame(list(cases.items()), "t string, want string").select("want", text.humanize_identifiers("t").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert spark.createDataFrame([(None,)], "t string").select(text.humanize_identifiers("t")).first()[0] is None


def test_running_sums_pass_64_bits(spark):
    rows = spark.createDataFrame([("a", 9e16), ("b", 8e16), ("c", -5.25), ("d", 0.5), ("e", None)], "k string, v double")
    got = ranking.global_order(rows, [F.col("k")], "v", n_parts=2).orderBy("k").collect()
    assert [r.running_sum for r in got] == [9e16, 1.7e17, 169999999999999994.75, 169999999999999995.25, 169999999999999995.25]
    assert charts.pareto(rows.where("v > 1"), "k", "v", scale=2).count() == 2


def test_a_failing_detector_leaves_the_others(spark, tmp_path):
    assert signals.detect([], spark).count() == 0
    calls = []
    summary = spark.createDataFrame([("Champions", 1.0), ("Lost", 50.0)], "segment string, percentage double")

    def good():
        calls.append("good")
        return signals.segment_signals(summary, "rfm")

    def late():  # fails only when it runs
        return signals.segment_signals(summary.withColumn("percentage", F.expr("CAST(raise_error('late fault') AS DOUBLE)")), "rfm")

    detectors = {"segments": good, "profile": lambda: signals.profile_signals(summary, None), "late": late}
    first = signals.run_all(spark, detectors, str(tmp_path), ["d1", "2024-01-01", None])
    kinds = sorted((r.type, r.affected_entity) for r in first.collect())
    assert kinds == [("detector_failed", "late"), ("detector_failed", "profile"), ("growing_at_risk_segment", "Lost"), ("shrinking_top_segment", "Champions")]
    again = signals.run_all(spark, detectors, str(tmp_path), ["d1", "2024-01-01", None])
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect())) and calls == ["good"]
    signals.run_all(spark, detectors, str(tmp_path), ["d2", "2024-01-01", None])
    assert calls == ["good", "good"]
    assert signals.run_all(spark, {"p": detectors["profile"]}, str(tmp_path), ["d3"]).count() == 1
