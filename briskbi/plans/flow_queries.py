"""Streaming, signals, usage and dashboard queries."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from briskbi.operators import charts, forecast, profile_state, segment, signals, summaries, usage
from briskbi.plans import dashboard
from briskbi.plans.registry import dec, register
from briskbi.session import table
from briskbi.streaming import incremental as S
from briskbi.streaming import keyed_table


def _events_stream(spark, d, max_files=None):
    schema = table(spark, d, "events").schema
    return S.file_stream(spark, d, schema, glob="events.parquet", max_files=max_files)


# X3 -----------------------------------------------------------------------
@register("q_stream_kpi", """
SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type,
       count(*) AS n, CAST(SUM(CAST(value AS DECIMAL(38,2))) AS DOUBLE) AS total
FROM events WHERE ts IS NOT NULL GROUP BY ALL
""")
def q_stream_kpi(spark, d):
    """Daily event KPIs from a file stream with a watermark; the update-mode
    changelog's current state equals the batch aggregate."""
    agg = S.kpi_windows(_events_stream(spark, d), "ts", "value", ["event_type"], "1 day", "1 day", scale=2)
    sink, ckpt = S.scratch(spark, "kpi-out"), S.scratch(spark, "kpi-ckpt")
    S.run_updates(agg, sink, ckpt)
    return S.read_latest(spark, sink, ["window_start", "window_end", "event_type"])


# X1 -----------------------------------------------------------------------
@register("q_stream_append", "SELECT * FROM events")
def q_stream_append(spark, d):
    """Cleaned events appended batch by batch (idempotent per batch id)."""
    from briskbi.operators.clean import clean_expressions

    target, ckpt = S.scratch(spark, "append-out"), S.scratch(spark, "append-ckpt")
    S.append_stream(_events_stream(spark, d), target, ckpt, lambda b: b.select(*clean_expressions(b)))
    return spark.read.parquet(target).drop("batch_id")


# Profile kept per batch --------------------------------------------
from briskbi.plans.summary_queries import _profile_sql  # noqa: E402


@register("q_stream_profile", _profile_sql())
def q_stream_profile(spark, d):
    """The profile of events after three appended batches, merged from what each batch left."""
    ev = table(spark, d, "events")
    inbox, target, ckpt, state = (S.scratch(spark, f"profile-{x}") for x in ("in", "out", "ckpt", "state"))
    for part in range(3):
        ev.where(F.pmod("event_id", F.lit(3)) == part).write.mode("append").parquet(inbox)  # the three parts are all events
        S.append_stream(S.file_stream(spark, inbox, ev.schema, glob="*.parquet"), target, ckpt, profile=state)
    return profile_state.profile(spark, state)


# X2 -----------------------------------------------------------------------
@register("q_stream_upsert", """
WITH base AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
new AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate, o_orderpriority
        FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')
SELECT * FROM new UNION ALL SELECT * FROM base WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)
""")
def q_stream_upsert(spark, d):
    """Two order extracts arrive one after the other; the later one wins per key."""
    o = table(spark, d, "orders")
    base = o.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    new = o.where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).withColumn(
        "o_totalprice", F.col("o_totalprice") + 1)
    inbox, target, ckpt = S.scratch(spark, "upsert-in"), S.scratch(spark, "upsert-out"), S.scratch(spark, "upsert-ckpt")
    for extract in (base, new):  # the second run of the stream finds the second extract's files
        extract.write.mode("append").parquet(inbox)
        S.upsert_stream(S.file_stream(spark, inbox, o.schema, glob="*.parquet"), target, ckpt, ["o_orderkey"], ["o_orderdate"], buckets=8)
    return keyed_table.read(spark, target)


# N1–N13 -------------------------------------------------------------------
@register("q_signals")
def q_signals(spark, d):
    """Signals over event forecasts, RFM/ABC summaries and the events profile."""
    ev = table(spark, d, "events")
    fc, log = forecast.run(ev, "ts", "value", ["event_type"], horizon=7, mode="fast", scale=2)
    parts = []
    dec, gro = signals.forecast_trend(fc, log.where("is_best"), ["event_type"], "event_type")
    parts += [dec, gro]
    parts += signals.forecast_quality(log, ["event_type"], "event_type")
    rfm = segment.rfm(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice", scale=2)
    parts += signals.segment_signals(segment.summarize(rfm, "rfm", ["monetary"], "monetary", scale=2), "rfm")
    abc = segment.abc(table(spark, d, "lineitem"), "l_partkey", "l_extendedprice", scale=2)
    parts += signals.segment_signals(segment.summarize(abc, "abc", ["total_value"], "total_value", scale=2), "abc")
    prof = summaries.profile(ev)
    parts += signals.profile_signals(prof, _dt.datetime(2024, 6, 30))
    series_ids = ev.select("event_type").distinct()
    parts.append(signals.missing(series_ids, fc, "event_type", "forecast"))
    return signals.detect(parts)


# C27–C30 --------------------------------------------------------------------
@register("q_usage_daily", """
SELECT user_id AS user, CAST(ts AS DATE) AS day, SUM(length(props)) AS chars, count(*) AS entries,
       SUM(length(props)) > 50000 AS over_cap
FROM events GROUP BY 1, 2
""")
def q_usage_daily(spark, d):
    """Characters per user per UTC day with the 50,000 cap flag."""
    ev = table(spark, d, "events").withColumn("chars", F.length("props").cast("long"))
    return usage.daily_usage(ev, "user_id", "ts", "chars")


@register("q_usage_summary", """
SELECT event_type AS kind, count(*) AS entries, count(*) FILTER (WHERE value > 300) AS errors,
       SUM(length(props)) AS amount
FROM events GROUP BY 1
""")
def q_usage_summary(spark, d):
    """Entries, errors (value > 300) and characters by event kind."""
    ev = table(spark, d, "events").withColumn("is_error", F.col("value") > 300).withColumn(
        "chars", F.length("props").cast("long"))
    return usage.usage_summary(ev, "event_type", "is_error", "chars")


@register("q_model_stats")
def q_model_stats(spark, d):
    """Winning models per event type joined to their category, win rates."""
    ev = table(spark, d, "events")
    _, log = forecast.run(ev, "ts", "value", ["event_type"], horizon=7, mode="fast", scale=2)
    runs = log.where("is_best").select("event_type", "model", "wape")
    cats = ev.select("event_type").distinct().withColumn(
        "category", F.when(F.col("event_type").isin("purchase", "signup"), F.lit("conversion")).otherwise(F.lit("engagement")))
    return usage.model_category_stats(runs, cats, "event_type", "category", "model", "wape")


# C32 / Q7 -----------------------------------------------------------------
_ROLES = {"l_shipdate": "date", "l_extendedprice": "measure", "l_quantity": "measure", "l_returnflag": "dimension",
          "l_linestatus": "dimension"}


@register("q_blueprint_cache", f"""
WITH day AS (
  SELECT l_shipdate AS d, CAST(SUM({dec('l_extendedprice')}) AS DOUBLE) AS v FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1),
days AS (SELECT strftime(d, '%Y-%m-%d') AS label, v, lag(v) OVER (ORDER BY d) AS p FROM day),
dim AS (
  SELECT l_linestatus AS label, SUM({dec('l_extendedprice')}) AS s FROM lineitem WHERE l_linestatus IS NOT NULL GROUP BY 1)
SELECT 'kpi_card|None|l_extendedprice|None' AS chart_key, CAST(NULL AS VARCHAR) AS label,
  CAST(SUM({dec('l_extendedprice')}) AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS line, CAST(NULL AS DOUBLE) AS cumulative
FROM lineitem
UNION ALL SELECT 'line|l_shipdate|l_extendedprice|None', label, v, NULL, NULL FROM days
UNION ALL SELECT 'combo|l_shipdate|l_extendedprice|None', label, v,
  CASE WHEN p IS NULL OR p = 0 THEN 0.0 ELSE round((v - p) / p * 100.0, 2) + 0.0 END, NULL FROM days
UNION ALL SELECT c || '|l_linestatus|l_extendedprice|None', label, CAST(s AS DOUBLE), NULL, NULL
FROM dim, (VALUES ('bar'), ('pie')) AS kinds(c)
UNION ALL SELECT 'pareto|l_linestatus|l_extendedprice|None', label, CAST(s AS DOUBLE), NULL,
  round(CAST(SUM(s) OVER (ORDER BY s DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
        / CAST(SUM(s) OVER () AS DOUBLE) * 100.0, 2)
FROM dim
""")
def q_blueprint_cache(spark, d):
    """Q7 + C32: blueprint from the lineitem profile, checked, every chart from one pass; the cached rows read back."""
    li = table(spark, d, "lineitem")
    prof = [r.asDict() for r in summaries.profile(li, counts=True).collect()]  # one row per column
    specs, _ = dashboard.validate_charts(dashboard.auto_blueprint(prof, _ROLES, 0), prof, _ROLES)
    rows = F.from_json("row_json", "label string, name string, value double, line double, cumulative double")
    cached = dashboard.chart_cache(li, specs, scale=2).select("chart_key", rows.alias("r"))
    return cached.select("chart_key", F.coalesce("r.label", "r.name").alias("label"), "r.value", "r.line", "r.cumulative")


@register("q_horizontal_bar", """
SELECT l_returnflag AS label, CAST(SUM(CAST(l_quantity AS DECIMAL(38,2))) AS DOUBLE) AS value
FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY value DESC, label LIMIT 12
""")
def q_horizontal_bar(spark, d):
    """Horizontal bar given with swapped axes (numeric x) is corrected."""
    return charts.aggregate(table(spark, d, "lineitem"), "l_quantity", "l_returnflag", chart_type="horizontal_bar",
                            scale=2)
