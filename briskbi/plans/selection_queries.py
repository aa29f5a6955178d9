"""Model selection, intervals, constraints, diagnosis and warnings (T16, T19–T25) on values made from orders, which SQL can state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briskbi.operators import forecast
from briskbi.plans.registry import register
from briskbi.session import table

_MODELS = forecast.MODEL_ORDER
_METRICS = f"""
WITH m AS (SELECT o_custkey, list_extract({_MODELS!r}, (o_orderkey % {len(_MODELS)} + 1)::INT) AS model, o_orderkey % {len(_MODELS)} AS mi, max(o_totalprice) AS mae, min(o_totalprice) AS rmse,
  (max(o_orderkey) % 1000) / 1000.0::DOUBLE AS wape, count(*)::DOUBLE AS mase FROM orders GROUP BY ALL),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, mi < 2 ORDER BY wape, mi) AS r FROM m) WHERE mi < 2 OR r <= 3)"""


def _metrics(spark, d) -> DataFrame:
    """Metrics of a customer's models: an order counts for the model of its key."""
    o = table(spark, d, "orders")
    model = F.element_at(F.array(*[F.lit(m) for m in _MODELS]), (F.col("o_orderkey") % len(_MODELS) + 1).cast("int"))
    return o.groupBy("o_custkey", model.alias("model")).agg(
        F.max("o_totalprice").alias("mae"), F.min("o_totalprice").alias("rmse"), ((F.max("o_orderkey") % 1000).cast("double") / 1000).alias("wape"),
        F.count(F.lit(1)).cast("double").alias("mase")).withColumn("status", F.lit("ok"))


@register("q_select", f"""{_METRICS},
ranks AS (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY mae, mi) + row_number() OVER (PARTITION BY o_custkey ORDER BY rmse, mi)
  + row_number() OVER (PARTITION BY o_custkey ORDER BY wape, mi) + row_number() OVER (PARTITION BY o_custkey ORDER BY mase, mi)) / 4.0::DOUBLE AS avg_rank FROM kept),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY avg_rank, mae, mi) AS b FROM ranks) WHERE b = 1),
runner AS (SELECT k.o_custkey, arg_min(k.model, (k.mae, k.model)) AS model, min(k.mae) AS mae FROM kept k JOIN best b ON k.o_custkey = b.o_custkey AND k.model <> b.model GROUP BY 1),
s AS (SELECT b.o_custkey, b.model AS best_model, CASE WHEN b.mae >= 1e-12 AND (r.mae - b.mae) / b.mae <= 0.25 THEN r.model END AS ensemble_partner,
  CASE WHEN n.mae > 1e-12 THEN (n.mae - b.mae) / n.mae * 100 END AS gain FROM best b LEFT JOIN runner r USING (o_custkey) LEFT JOIN m n ON n.o_custkey = b.o_custkey AND n.mi = 0)
SELECT o_custkey, best_model, ensemble_partner, round(gain, 6) AS improvement_pct,
  CASE WHEN gain IS NULL THEN 'medium' WHEN gain >= 20 THEN 'high' WHEN gain >= 0 THEN 'medium' ELSE 'low' END AS confidence FROM s
""")
def q_select(spark, d):
    """Screened candidates, winner by average rank, ensemble partner and confidence per customer."""
    from briskbi.session import cut_lineage

    screen = cut_lineage(_metrics(spark, d))
    kept = screen.join(forecast.tournament_keep(screen, ["o_custkey"], len(_MODELS)), ["o_custkey", "model"], "left_semi")
    chosen = forecast.select(forecast.rank_models(kept, ["o_custkey"]), ["o_custkey"])
    return chosen.select("o_custkey", "best_model", "ensemble_partner", F.round("improvement_pct", 6).alias("improvement_pct"), "confidence")


@register("q_intervals", """
WITH r AS (SELECT o_orderpriority, o_totalprice - 150000 AS r FROM orders),
q AS (SELECT o_orderpriority, quantile_cont(r, 0.05) AS lo, quantile_cont(r, 0.95) AS hi FROM r GROUP BY 1),
c AS (SELECT o_orderpriority, least(greatest(r, lo), hi) AS r FROM r JOIN q USING (o_orderpriority)),
med AS (SELECT o_orderpriority, quantile_cont(r, 0.5) AS m FROM c GROUP BY 1),
mad AS (SELECT o_orderpriority, greatest(quantile_cont(abs(r - m), 0.5) * 1.4826, 1e-9) AS std FROM c JOIN med USING (o_orderpriority) GROUP BY 1),
w AS (SELECT o_orderpriority, CAST(step AS INTEGER) AS step, 1.645 * std * pow(step, 0.2) AS h FROM mad, (SELECT unnest(range(1, 6)) AS step)),
v AS (SELECT *, 90000.0::DOUBLE * (step - 2) AS value FROM w)
SELECT o_orderpriority, step, round(greatest(value, 0), 2) AS value, round(least(greatest(value - h, 0), greatest(value, 0)), 2) AS lower,
  round(greatest(greatest(value + h, 0), greatest(value, 0)), 2) AS upper FROM v
""")
def q_intervals(spark, d):
    """Robust interval widths by step from residuals, clamped and repaired brackets, per order priority."""
    preds = table(spark, d, "orders").select("o_orderpriority", F.col("o_totalprice").alias("y_true"), F.lit(150000.0).alias("pred"))
    widths = forecast.interval_widths(preds, ["o_orderpriority"], 5, 0.90)
    fc = widths.withColumn("value", (F.col("step") - 2) * F.lit(90000.0))
    fc = fc.withColumn("lower", F.col("value") - F.col("half_width")).withColumn("upper", F.col("value") + F.col("half_width"))
    fc = forecast.apply_constraints(fc, F.lit(True))
    return fc.select("o_orderpriority", F.col("step").cast("int").alias("step"), *[F.round(c, 2).alias(c) for c in ("value", "lower", "upper")])


def _ratio() -> Column:
    return F.try_divide(F.col("o_totalprice"), F.when(F.col("o_orderkey") % 10 != 0, F.lit(150000.0)))


@register("q_fit", """
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice / 150000 END AS r FROM orders)
SELECT o_orderkey, CASE WHEN r IS NULL THEN NULL WHEN r < 0.7 THEN 'check_leakage' WHEN r <= 1.2 THEN 'healthy' WHEN r <= 1.5 THEN 'mild_overfit'
  WHEN r <= 2 THEN 'overfit' ELSE 'severe_overfit' END AS fit_diagnosis FROM r
""")
def q_fit(spark, d):
    """Diagnosis of a test error against a validation error, one ratio per order."""
    return table(spark, d, "orders").select("o_orderkey", forecast.fit_diagnosis(_ratio()).alias("fit_diagnosis"))


@register("q_warnings", """
WITH f AS (SELECT o_custkey, floor(o_totalprice / 100000) * 100000 AS value FROM orders),
g AS (SELECT o_custkey, count(*) AS n, count(DISTINCT value) AS nd, avg(greatest((o_custkey % 5) * 60000.0::DOUBLE - 50000, 0)) AS width, avg(abs(value)) AS level FROM f GROUP BY 1)
SELECT o_custkey, n >= 10 AND nd / n < 0.6 AS repetitive, level > 1e-9 AND width / level > 1.0 AS wide_intervals FROM g
""")
def q_warnings(spark, d):
    """Repetitive forecasts and wide intervals, a customer's orders taken as the steps."""
    value = F.floor(F.col("o_totalprice") / 100000) * F.lit(100000.0)
    fc = table(spark, d, "orders").select("o_custkey", value.alias("value"), (value + 50000).alias("lower"),
                                          (value + (F.col("o_custkey") % 5) * F.lit(60000.0)).alias("upper"))
    return forecast.quality_warnings(fc, ["o_custkey"])
