"""Signals (N1–N10, N12) on results that SQL can state: each detector's rule on values made from the driver tables."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from briskbi.operators import signals, summaries
from briskbi.plans.registry import register
from briskbi.session import table


def _rows(parts: list[DataFrame]) -> DataFrame:
    """Signals with their evidence as JSON text."""
    return signals.detect(parts).withColumn("evidence", F.to_json("evidence"))


def _json(**parts: str) -> str:
    """SQL of a JSON object of texts; an entry whose value is null shows null."""
    pairs = [f"'\"{k}\":' || coalesce('\"' || CAST({v} AS VARCHAR) || '\"', 'null')" for k, v in parts.items()]
    return "'{' || " + " || ',' || ".join(pairs) + " || '}'"


@register("q_signal_trend", f"""
WITH f AS (SELECT o_custkey, o_totalprice AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step FROM orders),
e AS (SELECT o_custkey, arg_min(value, step) AS a, arg_max(value, step) AS b, count(*) AS n FROM f GROUP BY 1),
s AS (SELECT *, o_custkey % 3 = 0 AS sure FROM e WHERE n >= 2 AND a > 0)
SELECT 'forecast_decline' AS type, CASE WHEN (a - b) / a > 0.25 THEN 'critical' ELSE 'warning' END AS severity, CAST(o_custkey AS VARCHAR) AS affected_entity,
  CASE WHEN sure THEN 0.9 ELSE 0.65 END::DOUBLE AS confidence, 1 AS detector_order,
  {_json(first_value="round(a, 2)", last_value="round(b, 2)", drop_pct="round((a - b) / a * 100, 1)", horizon_periods="n", best_model="'naive'")} AS evidence
FROM s WHERE (a - b) / a >= 0.10
UNION ALL SELECT 'forecast_growth', 'info', CAST(o_custkey AS VARCHAR), CASE WHEN sure THEN 0.85 ELSE 0.6 END::DOUBLE, 2,
  {_json(first_value="round(a, 2)", last_value="round(b, 2)", growth_pct="round((b - a) / a * 100, 1)", best_model="'naive'")}
FROM s WHERE (b - a) / a >= 0.20
""")
def q_signal_trend(spark, d):
    """Customers whose last order value lies well below or above their first."""
    o = table(spark, d, "orders")
    step = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    values = o.select("o_custkey", F.col("o_totalprice").alias("value"), step.alias("step"))
    log = o.select("o_custkey").distinct().select("o_custkey", F.lit("naive").alias("best_model"),
                                                  F.when(F.col("o_custkey") % 3 == 0, F.lit("high")).otherwise(F.lit("medium")).alias("confidence"))
    return _rows(list(signals.forecast_trend(values, log, ["o_custkey"], "o_custkey")))


_LOG = """
WITH log AS (SELECT c_custkey, (c_custkey % 97) / 100.0::DOUBLE AS wape, abs(c_acctbal) AS mae, 'ets' AS best_model,
  CASE WHEN c_custkey % 4 = 0 THEN 'low' ELSE 'high' END AS confidence, CASE c_custkey % 5 WHEN 0 THEN 'overfit' WHEN 1 THEN 'severe_overfit' ELSE 'healthy' END AS diagnosis,
  (c_custkey % 7) / 4.0::DOUBLE AS ratio FROM customer)"""


@register("q_signal_quality", f"""{_LOG}
SELECT 'low_confidence_forecast' AS type, 'warning' AS severity, CAST(c_custkey AS VARCHAR) AS affected_entity, 0.9::DOUBLE AS confidence, 3 AS detector_order,
  {_json(confidence_level="confidence", wape_pct="round(wape * 100, 1)", best_model="best_model")} AS evidence FROM log WHERE confidence = 'low' OR wape > 0.30
UNION ALL SELECT 'severe_overfit', 'warning', best_model, 0.95, 4, {_json(model="best_model", diagnosis="diagnosis", fit_ratio="ratio")} FROM log WHERE diagnosis <> 'healthy'
UNION ALL SELECT 'high_forecast_error', 'warning', CAST(c_custkey AS VARCHAR), 0.75, 10, {_json(wape_pct="round(wape * 100, 1)")} FROM log WHERE wape > 0.5
UNION ALL SELECT 'high_forecast_error', 'warning', CAST(c_custkey AS VARCHAR), 0.80, 11,
  {_json(wape_pct="round(wape * 100, 1)", best_mae="round(mae, 4)", best_model="best_model")} FROM log WHERE wape BETWEEN 0.20 AND 0.50
""")
def q_signal_quality(spark, d):
    """Weak forecasts by error, confidence and diagnosis, one log row per customer."""
    k = F.col("c_custkey")
    log = table(spark, d, "customer").select(
        "c_custkey", F.lit("ets").alias("model"), F.lit("ets").alias("best_model"), ((k % 97).cast("double") / 100).alias("wape"), F.abs("c_acctbal").alias("mae"),
        F.when(k % 4 == 0, F.lit("low")).otherwise(F.lit("high")).alias("confidence"), ((k % 7).cast("double") / 4).alias("fit_ratio"),
        F.when(k % 5 == 0, F.lit("overfit")).when(k % 5 == 1, F.lit("severe_overfit")).otherwise(F.lit("healthy")).alias("fit_diagnosis"))
    return _rows(signals.forecast_quality(log, ["c_custkey"], "c_custkey"))


_SEGMENTS = """
WITH named AS (SELECT *, CASE WHEN o_orderkey % 100 < 1 THEN 'Champions' WHEN o_orderkey % 100 < 4 THEN 'High Value' WHEN o_orderkey % 100 < 30 THEN 'At Risk'
  WHEN o_orderkey % 100 < 75 THEN 'Lost' ELSE 'A - high share' END AS segment FROM orders),
s AS (SELECT segment, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM orders) AS percentage, CASE WHEN segment LIKE 'A -%' THEN 88.25 ELSE 4.5 END::DOUBLE AS share FROM named GROUP BY segment)"""


@register("q_signal_segments", f"""{_SEGMENTS}
SELECT 'shrinking_top_segment' AS type, CASE WHEN percentage < 2 THEN 'critical' ELSE 'warning' END AS severity, segment AS affected_entity, 0.85::DOUBLE AS confidence, 5 AS detector_order,
  {_json(segment_name="segment", size_pct="round(percentage, 1)", method="'abc'")} AS evidence FROM s WHERE segment IN ('Champions', 'High Value') AND percentage < 5
UNION ALL SELECT 'growing_at_risk_segment', CASE WHEN percentage > 40 THEN 'critical' ELSE 'warning' END, segment, 0.85, 6,
  {_json(segment_name="segment", size_pct="round(percentage, 1)", method="'abc'")} FROM s WHERE segment IN ('At Risk', 'Lost') AND percentage > 25
UNION ALL SELECT 'concentration_risk', 'warning', segment, 0.9, 7, {_json(segment_name="segment", value_pct="round(share, 1)")} FROM s WHERE segment LIKE 'A -%' AND share > 70
UNION ALL SELECT 'missing_segmentation', 'info', CAST(c_custkey AS VARCHAR), 1.0, 13, {_json(dataset="c_custkey")} FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0)
""")
def q_signal_segments(spark, d):
    """Small top segments, large risk segments, concentration, customers without a tenth order key."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey") % 100
    name = (F.when(k < 1, "Champions").when(k < 4, "High Value").when(k < 30, "At Risk").when(k < 75, "Lost").otherwise("A - high share"))
    total = o.count()
    summary = o.groupBy(name.alias("segment")).agg((F.lit(100.0) * F.count(F.lit(1)) / F.lit(total)).alias("percentage"))
    summary = summary.withColumn("value_share", F.when(F.col("segment").startswith("A -"), 88.25).otherwise(4.5))
    alone = signals.missing(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), o.where(F.col("o_orderkey") % 10 == 0), "o_custkey", "segmentation")
    return _rows([*signals.segment_signals(summary, "abc"), alone])


@register("q_signal_profile", f"""
WITH p AS (SELECT 'o_orderpriority' AS c, round(avg(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END), 4) AS r FROM orders
  UNION ALL SELECT 'o_totalprice', round(avg(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END), 4) FROM orders
  UNION ALL SELECT 'o_orderstatus', round(avg(CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END), 4) FROM orders),
bad AS (SELECT c, round(r * 100, 1) AS pct FROM p WHERE r > 0.30),
g AS (SELECT count(*) AS n, string_agg(c, ', ' ORDER BY c) AS names,
  '[' || string_agg('{{\\"column\\":\\"' || c || '\\",\\"pct\\":' || CAST(pct AS VARCHAR) || '}}', ',' ORDER BY c) || ']' AS listed FROM bad),
last AS (SELECT max(o_orderdate) AS newest FROM orders)
SELECT 'high_null_columns' AS type, CASE WHEN n > 3 THEN 'critical' ELSE 'warning' END AS severity, names AS affected_entity, 1.0::DOUBLE AS confidence, 8 AS detector_order,
  {_json(count="n", columns="listed")} AS evidence FROM g WHERE n > 0
UNION ALL SELECT 'stale_data', CASE WHEN date_diff('day', newest::DATE, DATE '2002-06-30') > 180 THEN 'critical' ELSE 'warning' END, 'o_orderdate', 0.95, 9,
  {_json(latest_date="strftime(newest, '%Y-%m-%d %H:%M:%S')", days_old="date_diff('day', newest::DATE, DATE '2002-06-30')", column="'o_orderdate'")}
FROM last WHERE date_diff('day', newest::DATE, DATE '2002-06-30') > 90
""")
def q_signal_profile(spark, d):
    """Columns with many nulls and stale dates, from the profile of orders with blanked cells."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    for c, every in (("o_orderpriority", 2), ("o_totalprice", 3), ("o_orderstatus", 9)):
        o = o.withColumn(c, F.when(k % every != 0, F.col(c)))
    return _rows(signals.profile_signals(summaries.profile(o), _dt.datetime(2002, 6, 30)))
