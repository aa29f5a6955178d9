"""Chart queries (C1–C16, B4) on lineitem, orders, part and customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from briskbi.operators import charts
from briskbi.plans.registry import dec, register
from briskbi.session import table


# ---------------------------------------------------------------------------
# Charts
# ---------------------------------------------------------------------------

@register("q_month_revenue", f"""
SELECT strftime(l_shipdate, '%Y-%m') AS label, CAST(SUM({dec('l_extendedprice')}) AS DOUBLE) AS value
FROM lineitem WHERE l_shipdate IS NOT NULL
GROUP BY 1 ORDER BY 1
""")
def q_month_revenue(spark, d):
    """C10 + C13: monthly revenue (the flagship slice)."""
    return charts.aggregate(table(spark, d, "lineitem"), "l_shipdate", "l_extendedprice", grain="month", scale=2)


_AUTO_LABEL = """
CASE
  WHEN s.span <= 31 THEN strftime(l_shipdate, '%Y-%m-%d')
  WHEN s.span <= 183 THEN strftime(l_shipdate, '%G-W%V')
  WHEN s.span <= 1095 THEN strftime(l_shipdate, '%Y-%m')
  WHEN s.span <= 3650 THEN CAST(year(l_shipdate) AS VARCHAR) || '-Q' || CAST(quarter(l_shipdate) AS VARCHAR)
  ELSE strftime(l_shipdate, '%Y')
END"""
_SPAN = "(SELECT date_diff('day', min(l_shipdate), max(l_shipdate)) AS span FROM lineitem) s"


@register("q_auto_grain", f"""
SELECT {_AUTO_LABEL} AS label, CAST(SUM({dec('l_extendedprice')}) AS DOUBLE) AS value
FROM lineitem, {_SPAN}
WHERE l_shipdate IS NOT NULL
GROUP BY 1 ORDER BY 1
""")
def q_auto_grain(spark, d):
    """C14: grain chosen from the span of l_shipdate."""
    return charts.aggregate(table(spark, d, "lineitem"), "l_shipdate", "l_extendedprice", scale=2)


@register("q_cumulative", f"""
WITH g AS (
  SELECT strftime(l_shipdate, '%Y') AS label, SUM({dec('l_extendedprice')}) AS v
  FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1 ORDER BY 1)
SELECT label, CAST(SUM(v) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS value
FROM g
""")
def q_cumulative(spark, d):
    """Yearly running total of revenue."""
    return charts.aggregate(table(spark, d, "lineitem"), "l_shipdate", "l_extendedprice", grain="year",
                            cumulative=True, scale=2)


@register("q_bar", f"""
SELECT p_brand AS label, CAST(SUM({dec('p_retailprice')}) AS DOUBLE) AS value
FROM part WHERE p_brand IS NOT NULL
GROUP BY 1
""")
def q_bar(spark, d):
    """Bar of summed retail price by brand."""
    return charts.bar(table(spark, d, "part"), "p_brand", "p_retailprice", scale=2)


@register("q_bar_text_dates", f"""
SELECT strftime(o_orderdate, '%-m/%-d/%Y') AS label, CAST(SUM({dec('o_totalprice')}) AS DOUBLE) AS value
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, o_orderdate ORDER BY o_orderdate LIMIT 30
""")
def q_bar_text_dates(spark, d):
    """The first 30 days of a text date axis, in order of time."""
    o = table(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "M/d/yyyy"))
    return charts.bar(o, "day", "o_totalprice", scale=2, limit=30)


@register("q_bar_count", """
SELECT CAST(l_suppkey AS VARCHAR) AS label, CAST(COUNT(*) AS DOUBLE) AS value
FROM lineitem WHERE l_suppkey IS NOT NULL
GROUP BY 1
""")
def q_bar_count(spark, d):
    """C3 without y: row count per supplier, first 200 by count."""
    return charts.bar(table(spark, d, "lineitem"), "l_suppkey")


@register("q_pie_others", f"""
WITH g AS (
  SELECT p_brand AS name, SUM({dec('p_retailprice')}) AS v FROM part
  WHERE p_brand IS NOT NULL GROUP BY 1 HAVING SUM({dec('p_retailprice')}) > 0),
r AS (SELECT name, v, row_number() OVER (ORDER BY v DESC, name) AS rn, count(*) OVER () AS n FROM g)
SELECT name, CAST(v AS DOUBLE) AS value FROM r WHERE n <= 12 OR rn <= 11
UNION ALL
SELECT 'Others' AS name, CAST(SUM(v) AS DOUBLE) AS value FROM r WHERE n > 12 AND rn > 11 HAVING count(*) > 0
""")
def q_pie_others(spark, d):
    """C4/L1: brand shares, top 11 + Others."""
    return charts.pie(table(spark, d, "part"), "p_brand", "p_retailprice", scale=2)


@register("q_pareto", f"""
WITH g AS (
  SELECT CAST(l_partkey AS VARCHAR) AS label, SUM({dec('l_extendedprice')}) AS v
  FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY 1),
t AS (SELECT * FROM g WHERE v > 0)
SELECT label, CAST(v AS DOUBLE) AS value,
  round(CAST(SUM(v) OVER (ORDER BY v DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
        / CAST(SUM(v) OVER () AS DOUBLE) * 100.0, 2) AS cumulative
FROM t
""")
def q_pareto(spark, d):
    """Part revenue Pareto over all parts."""
    return charts.pareto(table(spark, d, "lineitem"), "l_partkey", "l_extendedprice", scale=2)


@register("q_combo_growth", f"""
WITH g AS (
  SELECT o_orderdate AS d, CAST(SUM({dec('o_totalprice')}) AS DOUBLE) AS v
  FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
l AS (SELECT d, v, lag(v) OVER (ORDER BY d) AS p FROM g)
SELECT strftime(d, '%Y-%m-%d') AS label, v AS value,
  CASE WHEN p IS NULL OR p = 0 THEN 0.0 ELSE round((v - p) / p * 100.0, 2) + 0.0 END AS line,
  'Growth %' AS line_name, true AS line_is_pct
FROM l
""")
def q_combo_growth(spark, d):
    """Daily order value with growth % line."""
    return charts.combo(table(spark, d, "orders"), "o_orderdate", "o_totalprice", scale=2)


@register("q_combo_secondary", f"""
SELECT l_returnflag AS label, CAST(SUM({dec('l_extendedprice')}) AS DOUBLE) AS value,
  CAST(SUM({dec('l_quantity')}) AS DOUBLE) AS line, 'l_quantity' AS line_name, false AS line_is_pct
FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1
""")
def q_combo_secondary(spark, d):
    """Bars and a secondary measure from one grouping (no join)."""
    return charts.combo(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", "l_quantity", scale=2)


@register("q_radial", f"""
WITH s AS (SELECT min(l_discount) AS mn, max(l_discount) AS mx,
                  CAST(SUM({dec('l_discount')}) AS DOUBLE) / COUNT(l_discount) AS mean FROM lineitem)
SELECT CASE WHEN mean IS NULL THEN 0.0 WHEN mn >= 0 AND mx <= 1 THEN round(mean * 100.0, 2) ELSE round(mean, 2) END AS value,
       CASE WHEN mean IS NULL THEN 0.0 WHEN mn >= 0 AND mx <= 100 THEN 100.0 ELSE round(mx, 2) END AS max,
       CASE WHEN mean IS NULL THEN '' WHEN mn >= 0 AND mx <= 100 THEN '%' ELSE '' END AS unit
FROM s
""")
def q_radial(spark, d):
    """Gauge of the mean discount (0–1 range → percent)."""
    return charts.radial(table(spark, d, "lineitem"), "l_discount", scale=2)


def _hist_sql(tbl: str, col: str, closed: str) -> str:
    cmp = ">=" if closed == "left" else ">"
    if closed == "left":
        bounds = "CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi"
        first = "e.lo"
    else:
        bounds = ("CASE WHEN mn = mx THEN mn - (CASE WHEN mn = 0 THEN 0.001 ELSE abs(mn) * 0.001 END) ELSE mn END AS lo, "
                  "CASE WHEN mn = mx THEN mx + (CASE WHEN mn = 0 THEN 0.001 ELSE abs(mn) * 0.001 END) ELSE mx END AS hi")
        first = "CASE WHEN p.mn = p.mx THEN e.lo ELSE e.lo - (p.hi - p.lo) * 0.001 END"
    return f"""
WITH v AS (SELECT CAST({col} AS DOUBLE) AS x FROM {tbl} WHERE {col} IS NOT NULL),
s AS (SELECT min(x) AS mn, max(x) AS mx, count(DISTINCT x) AS nd FROM v),
p AS (SELECT mn, mx, least(20, greatest(5, nd)) AS n, {bounds} FROM s WHERE mn IS NOT NULL),
e AS (SELECT i AS bin, i * ((hi - lo) / n) + lo AS lo FROM p, generate_series(0, (SELECT n FROM p) - 1) t(i)),
b AS (SELECT e.bin,
        CASE WHEN e.bin = 0 THEN {first} ELSE e.lo END AS lo,
        CASE WHEN e.bin = p.n - 1 THEN p.hi ELSE (e.bin + 1) * ((p.hi - p.lo) / p.n) + p.lo END AS hi
      FROM e, p),
inner_edges AS (SELECT bin, lo AS edge FROM e WHERE bin >= 1),
c AS (SELECT v.x, (SELECT count(*) FROM inner_edges ie WHERE v.x {cmp} ie.edge) AS bin FROM v)
SELECT CAST(b.bin AS INTEGER) AS bin, b.lo, b.hi, format('{{:.2g}}–{{:.2g}}', b.lo, b.hi) AS label, COALESCE(cnt, 0) AS value
FROM b LEFT JOIN (SELECT bin, count(*) AS cnt FROM c GROUP BY bin) k ON k.bin = b.bin
"""


@register("q_hist", _hist_sql("orders", "o_totalprice", "left"))
def q_hist(spark, d):
    """Numpy-style histogram of order totals."""
    return charts.histogram(table(spark, d, "orders"), "o_totalprice", closed="left")


@register("q_hist_rightclosed", _hist_sql("orders", "o_totalprice", "right"))
def q_hist_rightclosed(spark, d):
    """``pd.cut``-style right-closed histogram of order totals."""
    return charts.histogram(table(spark, d, "orders"), "o_totalprice", closed="right")


@register("q_breakdown", """
WITH g AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS label, o_orderpriority AS series, CAST(count(*) AS DOUBLE) AS value
  FROM orders WHERE o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2),
k AS (SELECT series FROM g GROUP BY 1 ORDER BY sum(value) DESC, series LIMIT 12),
l AS (SELECT label FROM g WHERE series IN (SELECT series FROM k) GROUP BY 1 ORDER BY label DESC)
SELECT l.label, k.series, COALESCE(g.value, 0.0) AS value
FROM l CROSS JOIN k LEFT JOIN g ON g.label = l.label AND g.series = k.series
""")
def q_breakdown(spark, d):
    """C11: monthly order counts by priority, zero-filled."""
    return charts.aggregate(table(spark, d, "orders"), "o_orderdate", agg="count", breakdown="o_orderpriority",
                            grain="month")


@register("q_median_kpi", """
SELECT COALESCE(quantile_cont(o_totalprice, 0.5), 0.0) AS value FROM orders
""")
def q_median_kpi(spark, d):
    """Exact median KPI (distributed selection, no single-task collect)."""
    return charts.kpi(table(spark, d, "orders"), "o_totalprice", "median")


@register("q_kpi_sum", f"""
SELECT COALESCE(CAST(SUM({dec('l_extendedprice')}) AS DOUBLE), 0.0) AS value FROM lineitem
""")
def q_kpi_sum(spark, d):
    """KPI card, total revenue."""
    return charts.kpi(table(spark, d, "lineitem"), "l_extendedprice", "sum", scale=2)


@register("q_top_mean", f"""
SELECT c_mktsegment AS label, CAST(SUM({dec('c_acctbal')}) AS DOUBLE) / COUNT(c_acctbal) AS value
FROM customer WHERE c_mktsegment IS NOT NULL
GROUP BY 1 ORDER BY value DESC, label LIMIT 12
""")
def q_top_mean(spark, d):
    """Grouped top-12 mean account balance by segment."""
    return charts.aggregate(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", agg="mean", top_n=12, scale=2)


@register("q_date_filter", f"""
SELECT strftime(l_shipdate, '%Y-%m-%d') AS label, CAST(SUM({dec('l_extendedprice')}) AS DOUBLE) AS value
FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-03-01' AND l_shipdate < TIMESTAMP '1996-03-31' + INTERVAL 1 DAY
GROUP BY 1 ORDER BY 1
""")
def q_date_filter(spark, d):
    """B4 + C14: a March-1996 window (inclusive end day) at the automatic daily grain."""
    return charts.aggregate(table(spark, d, "lineitem"), "l_shipdate", "l_extendedprice", date_field="l_shipdate",
                            date_from="1996-03-01", date_to="1996-03-31", scale=2)


@register("q_chat_grain", f"""
WITH s AS (SELECT date_diff('day', min(o_orderdate), max(o_orderdate)) AS span FROM orders)
SELECT CASE WHEN s.span <= 60 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN s.span <= 400 THEN strftime(o_orderdate, '%G-W%V')
            WHEN s.span <= 2000 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y') END AS label,
       CAST(SUM({dec('o_totalprice')}) AS DOUBLE) / COUNT(o_totalprice) AS value
FROM orders, s WHERE o_orderdate IS NOT NULL GROUP BY 1 ORDER BY 1
""")
def q_chat_grain(spark, d):
    """Mean order value over time at the chat rule's grain (≤60 d day, ≤400 week, ≤2000 month, else year)."""
    from briskbi.functions.labels import CHAT_GRAIN_LIMITS

    return charts.aggregate(table(spark, d, "orders"), "o_orderdate", "o_totalprice", agg="mean", scale=2,
                            grain_limits=CHAT_GRAIN_LIMITS, last_grain="year")


@register("q_relative_range", f"""
SELECT strftime(o_orderdate, '%Y-%m-%d') AS label, CAST(SUM({dec('o_totalprice')}) AS DOUBLE) AS value
FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-05-04' AND o_orderdate < TIMESTAMP '1998-08-02' + INTERVAL 1 DAY
GROUP BY 1 ORDER BY 1
""")
def q_relative_range(spark, d):
    """B5 + B4: "last 90 days" as of 1998-08-02, daily order value."""
    import datetime as dt

    start, end = charts.relative_range("last_90_days", dt.date(1998, 8, 2))
    return charts.aggregate(table(spark, d, "orders"), "o_orderdate", "o_totalprice", date_field="o_orderdate",
                            date_from=start.isoformat(), date_to=end.isoformat(), grain="day", scale=2)


@register("q_median_by_part", """
WITH g AS (
  SELECT CAST(l_partkey AS VARCHAR) AS label, median(l_extendedprice) AS value
  FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY 1)
SELECT label, coalesce(value, 0.0) AS value FROM g ORDER BY value DESC, label LIMIT 12
""")
def q_median_by_part(spark, d):
    """The twelve parts with the highest median price, medians by selection."""
    return charts.aggregate(table(spark, d, "lineitem"), "l_partkey", "l_extendedprice", agg="median")


@register("q_cumulative_labels", f"""
WITH g AS (
  SELECT CAST(o_custkey AS VARCHAR) AS label, SUM({dec('o_totalprice')}) AS v
  FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1)
SELECT label, CAST(SUM(v) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS value
FROM g
""")
def q_cumulative_labels(spark, d):
    """Running total over customers in label order, all labels, without one window over them."""
    return charts.aggregate(table(spark, d, "orders"), "o_custkey", "o_totalprice", cumulative=True, scale=2)
