"""Inputs that once crashed operators or lost rows: retries, constants, null keys, quotes, wide tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from briskbi.operators import accumulate, charts, clean, segment, series, signals, summaries
from briskbi.sources import files
from briskbi.streaming import incremental, keyed_table


def test_retried_upsert_batch_keeps_earlier_rows(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k int, v string, at int"
    first = spark.createDataFrame([(i, "a", 1) for i in range(9)], schema)
    first.write.mode("append").parquet(source)

    def upsert(checkpoint):
        stream = incremental.file_stream(spark, source, first.schema)
        incremental.upsert_stream(stream, target, str(tmp_path / checkpoint), ["k"], ["at"])

    upsert("c1")
    spark.createDataFrame([(8, "b", 2), (9, "b", 2)], schema).write.mode("append").parquet(source)
    upsert("c1")
    rows = {r.k: r.v for r in keyed_table.read(spark, target).collect()}
    assert len(rows) == 10 and rows[8] == "b" and rows[0] == "a"
    # The second batch again, as after a crash between writing and committing it.
    commits = sorted((tmp_path / "c1" / "commits").glob("[0-9]*"))
    commits[-1].unlink()
    for crc in (tmp_path / "c1" / "commits").glob(".*.crc"):
        crc.unlink()
    upsert("c1")
    again = {r.k: r.v for r in keyed_table.read(spark, target).collect()}
    assert again == rows


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 5.0, None) for i in range(20)], "a double, b double, c double, d double")
    assert [tuple(r)[:3] for r in summaries.correlations(df).collect()] == [("a", "b", 1.0)]
    scores = {r.feature: r.score for r in summaries.rank_features(df, "a").collect()}
    assert scores["b"] == 1.0 and scores["c"] is None
    assert summaries.correlation_matrix(df).count() == 4


def test_numeric_text_is_ranked_as_a_number(spark):
    df = spark.createDataFrame([(str(i), float(i), "x" if i % 2 else "y") for i in range(40)], "t string, y double, g string")
    got = {r.feature: (r.method, r.score) for r in summaries.rank_features(df, "y").collect()}
    assert got["t"] == ("pearson", 1.0) and got["g"][0] == "mutual_info"


def test_cards_rank_every_numeric_column(spark):
    df = spark.createDataFrame([tuple(range(1, 7)) + (1000,)], ", ".join(f"c{i} int" for i in range(7)))
    names = [r.name for r in summaries.kpi_cards(df).orderBy("rank").collect()]
    assert names[:2] == ["rows", "c6"] and len(names) == 5
    assert {r.column for r in summaries.zscore_anomalies(spark.createDataFrame([(1.0,) * 7] * 30 + [(99.0,) * 7], ", ".join(f"c{i} double" for i in range(7)))).collect()} == {f"c{i}" for i in range(7)}


def test_abc_with_small_and_zero_totals(spark):
    tiny = spark.createDataFrame([("a", 0.004), ("b", 0.003), ("c", 0.002)], "e string, v double")
    got = {r.entity: (r.total_value, r.cumulative_pct) for r in segment.abc(tiny, "e", "v").collect()}
    assert got["a"] == (0.004, 44.44) and got["c"][1] == 100.0
    zero = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "e string, v double")
    assert {r.cumulative_pct for r in segment.abc(zero, "e", "v").collect()} == {0.0}
    assert {r.cumulative_pct for r in segment.abc(zero, "e", "v", scale=2).collect()} == {0.0}
    with pytest.raises(ValueError):
        segment.abc(tiny.limit(0), "e", "v")


def days(n, key, start=dt.datetime(2020, 1, 1)):
    return [(key, start + dt.timedelta(days=i), float(i % 5)) for i in range(n)]


def test_null_series_keys_are_dropped_alike(spark):
    df = spark.createDataFrame(days(30, "a") + days(30, None) + days(1, "one"), "k string, t timestamp_ntz, y double")
    assert {r.k for r in series.check(df, "t", "y", ["k"]).collect()} == {"a", "one"}
    assert {r.k: r.freq for r in series.detect_freq(df, "t", ["k"]).collect()} == {"a": "D", "one": "D"}
    assert {r.k for r in series.resample(df, "t", "y", ["k"]).collect()} == {"a", "one"}
    assert series.check(df.limit(0), "t", "y").collect()[0].ready is False


def test_series_keep_every_day_unless_told(spark):
    df = spark.createDataFrame(days(1400, "a"), "k string, t timestamp_ntz, y double")
    assert series.resample(df, "t", "y", ["k"], freq="D").count() == 1400
    assert series.resample(df, "t", "y", ["k"], freq="D", keep_newest=1200).count() == 1200
    gaps = [("a", dt.datetime(2020, 1, 1) + dt.timedelta(hours=6 * i), 1.0) for i in range(9)] + [("b", dt.datetime(2020, 1, 1) + dt.timedelta(days=10 * i), 1.0) for i in range(5)]
    got = {r.k: (r.median_gap_days, r.n_dates) for r in series.detect_freq(spark.createDataFrame(gaps, "k string, t timestamp_ntz, y double"), "t", ["k"]).collect()}
    assert got == {"a": (0.25, 9), "b": (10.0, 5)}
    total = series.detect_freq(spark.createDataFrame(gaps, "k string, t timestamp_ntz, y double").where("k = 'b'"), "t").collect()[0]
    assert (total.median_gap_days, total.freq) == (10.0, "MS")


def test_charts_return_every_group_unless_told(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("x"), (F.col("id") + 1).cast("double").alias("y"))
    assert charts.bar(df, "x", "y").count() == 300 and charts.bar(df, "x", "y", limit=5).count() == 5
    assert charts.combo(df, "x", "y").count() == 300
    part = {r.label: r.cumulative for r in charts.pareto(df, "x", "y", limit=2).collect()}
    assert part == {"299": round(300 / 45150 * 100, 2), "298": round(599 / 45150 * 100, 2)}
    wide = df.withColumn("x", F.concat(F.lit("value"), "x"))
    assert charts.value_filter(wide, "how about value257?").count() == 1
    assert charts.relative_range("last12m", dt.date(2024, 2, 29))[0] == dt.date(2023, 2, 28)
    assert charts.relative_range("last12m", dt.date(2023, 8, 31))[0] == dt.date(2022, 8, 31)


def test_quoted_csv(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('a,b\n"x ""y"" z",1\n"two\nlines, here",2\n', encoding="utf-8")
    frame = files.read_any(spark, [f"file://{path}"]).frames[0]
    assert sorted(map(tuple, frame.collect())) == [("two\nlines, here", "2"), ('x "y" z', "1")]


def test_encoding_is_judged_on_the_whole_file(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_bytes(b"a,b\n" + b"plain,1\n" * 20_000 + "café €,2\n".encode("cp1252"))
    frame = files.read_any(spark, [f"file://{path}"]).frames[0]
    assert frame.where("b = '2'").first()["a"] == "café €"


def test_names_and_keys():
    assert [clean.snake_clean(n) for n in (" A--B c!", "", "__x__", "Ärger")] == ["a_b_c", "unnamed", "x", "rger"]
    assert [clean.snake_merge(n) for n in (" A--B c!d", "!!", "a__b", "x y-z")] == ["a_b_cd", "column", "a_b", "x_y_z"]
    assert accumulate.schemas_match(["a", "b"], ["b", "a"]) == (True, "")
    ok, note = accumulate.schemas_match(["a", "b"], ["b", "c"])
    assert not ok and "'a'" in note and "'c'" in note
    assert [accumulate.looks_like_id(n) for n in ("id", "order_id", "no_x", "paid", "ID_x", "")] == [True, True, True, False, True, False]


def test_report_sections_are_whole(spark):
    s = spark.createDataFrame([(i, f"t{i}", "x" * 900 if i else " ") for i in range(8)], "section_no int, title string, content string")
    note = str(signals.report_insights(s, "report").collect()[0])
    assert note.count("summary") == 7 and "x" * 900 in note
    assert str(signals.report_insights(s, "report", 3, 10).collect()[0]).count("summary") == 2


def test_kmeans_guards_and_shares(spark):
    rows = [(float(i % 3) * 10, float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double")
    out, meta, share = segment.kmeans(df, ["a", "b"], ks=range(3, 5), starts=2)
    assert out.count() == 60 and meta.first()["k"] == 3
    assert abs(sum(r.importance for r in share.collect()) - 1) < 1e-9
    with pytest.raises(ValueError):
        segment.kmeans(df.limit(9), ["a", "b"])


def test_blueprint_order_and_validation():
    from briskbi.plans import dashboard

    profile = [{"column": c, "data_type": t, "unique_ratio": u} for c, t, u in
               (("Day", "datetime", 1.0), ("Amount", "numeric", 0.9), ("Units", "numeric", 0.5), ("Region", "text", 0.05), ("Order", "numeric", 1.0))]
    roles = {"Day": "date", "Amount": "measure", "Units": "measure", "Region": "dimension", "Order": "id"}
    kinds = [s["chart_type"] for s in dashboard.auto_blueprint(profile, roles, 100)]
    assert kinds == ["kpi_card", "line", "bar", "pie", "combo", "pareto"]
    undated = {k: v for k, v in roles.items() if k != "Day"}
    assert [s["chart_type"] for s in dashboard.auto_blueprint(profile, undated, 100)] == ["kpi_card", "bar", "pie", "treemap", "histogram", "pareto"]
    assert len(dashboard.auto_blueprint(profile, roles, 100, max_charts=2)) == 2
    good, notes = dashboard.validate_charts([
        {"chart_type": "Bar", "x_axis": "region", "y_axis": "AMOUNT"}, {"chart_type": "gauge"}, {"chart_type": "bar", "x_axis": "Region"},
        {"chart_type": "horizontal_bar", "x_axis": "Amount", "y_axis": "Region"}, {"chart_type": "pie", "x_axis": "Region", "y_axis": "Order"},
        {"chart_type": "histogram", "x_axis": "Region"}, {"chart_type": "kpi_card"}, {"chart_type": "combo", "x_axis": "Day", "y_axis": "Amount", "columns": ["Units"]},
        {"chart_type": "line", "x_axis": "Region", "y_axis": "Amount"}], profile, roles)
    assert [(g["chart_type"], g["x_axis"], g["y_axis"]) for g in good] == [
        ("bar", "Region", "Amount"), ("horizontal_bar", "Region", "Amount"), ("pie", "Region", None), ("kpi_card", None, "Amount"), ("combo", "Day", "Amount"), ("line", "Region", "Amount")]
    assert good[4]["y_axis_secondary"] == "Units" and len(notes) == 6


def test_logs_and_pages_are_not_clamped(spark, tmp_path):
    from briskbi.sources import files

    spark.range(2600).selectExpr("id AS created_at", "'a' AS kind").write.json(str(tmp_path / "log"))
    assert files.read_log(spark, str(tmp_path / "log")).count() == 2600
    assert files.read_log(spark, str(tmp_path / "log"), limit=700).count() == 700
    assert files.page(spark.range(2600).selectExpr("id AS row_index"), 2500).count() == 2500
