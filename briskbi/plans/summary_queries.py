"""Summary, profile, quality and correlation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from briskbi.operators import summaries
from briskbi.plans.registry import register
from briskbi.session import table


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# C18 ----------------------------------------------------------------------
_CUST_NUM = ["c_custkey", "c_nationkey", "c_acctbal"]


@register("q_numeric_summary", _union([
    f"SELECT '{c}' AS column, round(SUM(CAST({c} AS DOUBLE)), 2) AS sum, round(AVG(CAST({c} AS DOUBLE)), 2) AS mean, "
    f"round(MIN(CAST({c} AS DOUBLE)), 2) AS min, round(MAX(CAST({c} AS DOUBLE)), 2) AS max, COUNT({c}) AS count FROM customer"
    for c in _CUST_NUM
]))
def q_numeric_summary(spark, d):
    """Numeric summary of every numeric customer column."""
    return summaries.numeric_summary(table(spark, d, "customer"))


# C19 ----------------------------------------------------------------------
@register("q_top_values", """
WITH kv AS (
  SELECT 'o_orderstatus' AS column, o_orderstatus AS value FROM orders
  UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
c AS (SELECT "column", value, COUNT(*) AS count FROM kv WHERE value IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM c)
SELECT "column", value, count, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10
""")
def q_top_values(spark, d):
    """Top-10 value counts of the text columns of orders."""
    return summaries.top_values(table(spark, d, "orders"))


# C20 ----------------------------------------------------------------------
@register("q_date_range", """
SELECT 'o_orderdate' AS column, MIN(o_orderdate) AS earliest, MAX(o_orderdate) AS latest FROM orders
""")
def q_date_range(spark, d):
    """C20: date range of the first datetime column of orders."""
    return summaries.date_range(table(spark, d, "orders"))


# C21 ----------------------------------------------------------------------
@register("q_ranked", """
WITH g AS (
  SELECT 'c_mktsegment' AS dimension, 'c_acctbal' AS measure, c_mktsegment AS label, SUM(c_acctbal) AS value
  FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment
  UNION ALL
  SELECT 'c_name', 'c_acctbal', c_name, SUM(c_acctbal) FROM customer WHERE c_name IS NOT NULL GROUP BY c_name),
r AS (SELECT *, row_number() OVER (PARTITION BY dimension, measure ORDER BY value DESC, label) AS rank FROM g)
SELECT dimension, measure, label, round(value, 2) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10
""")
def q_ranked(spark, d):
    """Top-10 account-balance sums by segment and by customer name."""
    return summaries.ranked(table(spark, d, "customer"), ["c_acctbal"], ["c_mktsegment", "c_name"])


# C17 ----------------------------------------------------------------------
_ORD_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@register("q_dimensions", "SELECT * FROM (" + _union([
    f"SELECT '{c}' AS column, COUNT(DISTINCT {c}) AS n_distinct, {str(c in ('o_orderstatus', 'o_orderpriority')).lower()} AS is_text FROM orders"
    for c in _ORD_COLS
]) + ") WHERE n_distinct BETWEEN 2 AND 25")
def q_dimensions(spark, d):
    """C17: dimension candidates of orders (2–25 distinct values)."""
    return summaries.pick_dimensions(table(spark, d, "orders"))


# C22 ----------------------------------------------------------------------
_LI_SUMS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _compact_sql(x: str) -> str:
    a = f"abs({x})"
    return (f"CASE WHEN {x} IS NULL THEN NULL ELSE (CASE WHEN {x} < 0 THEN '-' ELSE '' END) || "
            f"CASE WHEN {a} >= 1e9 THEN format('{{:.1f}}', {a} / 1e9) || 'B' "
            f"WHEN {a} >= 1e6 THEN format('{{:.1f}}', {a} / 1e6) || 'M' "
            f"WHEN {a} >= 1e3 THEN format('{{:.1f}}', {a} / 1e3) || 'K' "
            f"ELSE format('{{:.2f}}', {a}) END END")


@register("q_kpi_cards", f"""
WITH cards AS (
  SELECT 'rows' AS name, 'count' AS agg, CAST(COUNT(*) AS DOUBLE) AS value, 1.0e300 AS weight FROM lineitem
  {''.join(f" UNION ALL SELECT '{c}', 'sum', SUM(CAST({c} AS DOUBLE)), abs(SUM(CAST({c} AS DOUBLE))) FROM lineitem" for c in _LI_SUMS)}),
r AS (SELECT *, row_number() OVER (ORDER BY weight DESC, name) AS rank FROM cards)
SELECT name, agg, value, {_compact_sql('value')} AS display, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
""")
def q_kpi_cards(spark, d):
    """Row count + top-4 KPI cards of lineitem with compact numbers."""
    return summaries.kpi_cards(table(spark, d, "lineitem"))


# C24 ----------------------------------------------------------------------
_Z_COLS = ["event_id", "user_id", "value"]


def _zscore_sql() -> str:
    ctes = ", ".join(
        f"s_{c} AS (SELECT AVG(CAST({c} AS DOUBLE)) AS m, STDDEV_SAMP(CAST({c} AS DOUBLE)) AS s, COUNT({c}) AS n FROM events)"
        for c in _Z_COLS)
    parts = []
    for c in _Z_COLS:
        cnt = f"(SELECT COUNT(*) FROM events, s_{c} WHERE abs((CAST({c} AS DOUBLE) - m) / s) > 2.5)"
        parts.append(f"""SELECT '{c}' AS column, {cnt} AS outlier_count, n AS total_rows,
  round({cnt} / n * 100, 2) AS percentage, CAST(2.5 AS DOUBLE) AS threshold, round(m, 2) AS mean, round(s, 2) AS std
FROM s_{c} WHERE n >= 10 AND s <> 0""")
    return f"WITH {ctes}\nSELECT * FROM ({_union(parts)}) WHERE outlier_count > 0"


@register("q_zscore", _zscore_sql())
def q_zscore(spark, d):
    """|z| > 2.5 outlier counts for the numeric event columns."""
    return summaries.zscore_anomalies(table(spark, d, "events"))


# C25 ----------------------------------------------------------------------
_LI_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
           "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@register("q_quality", f"""
WITH n AS (SELECT COUNT(*) AS rows, {' + '.join(f'COUNT(*) FILTER (WHERE {c} IS NULL)' for c in _LI_ALL)} AS nulls FROM lineitem),
d AS (SELECT COALESCE(SUM(k - 1), 0) AS duplicate_rows FROM (SELECT COUNT(*) AS k FROM lineitem GROUP BY ALL_COLS)),
c AS (SELECT rows, CASE WHEN rows * {len(_LI_ALL)} > 0 THEN round((1 - nulls / (rows * {len(_LI_ALL)})) * 100, 1) ELSE 100.0 END AS completeness_pct FROM n)
SELECT c.rows, CAST({len(_LI_ALL)} AS BIGINT) AS columns, CAST(d.duplicate_rows AS BIGINT) AS duplicate_rows, c.completeness_pct,
  round(c.completeness_pct - d.duplicate_rows / greatest(c.rows, 1) * 10, 1) AS quality_score
FROM c, d
""".replace("GROUP BY ALL_COLS", "GROUP BY " + ", ".join(_LI_ALL)))
def q_quality(spark, d):
    """Data-quality report of lineitem."""
    return summaries.quality(table(spark, d, "lineitem"))


@register("q_quality_subset", """
WITH n AS (SELECT COUNT(*) AS rows FROM lineitem),
d AS (SELECT COALESCE(SUM(k - 1), 0) AS duplicate_rows FROM
      (SELECT COUNT(*) AS k FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity))
SELECT n.rows, CAST(3 AS BIGINT) AS columns, CAST(d.duplicate_rows AS BIGINT) AS duplicate_rows, CAST(100.0 AS DOUBLE) AS completeness_pct,
  round(100.0 - d.duplicate_rows / greatest(n.rows, 1) * 10, 1) AS quality_score
FROM n, d
""")
def q_quality_subset(spark, d):
    """C25 on three low-cardinality columns (many duplicate rows)."""
    return summaries.quality(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


# C26 / J5 -----------------------------------------------------------------
@register("q_compare", _union([
    f"""SELECT '{c}' AS column,
  round((SELECT AVG(CAST({c} AS DOUBLE)) FROM orders WHERE o_orderstatus = 'F'), 2) AS ds1_mean,
  round((SELECT AVG(CAST({c} AS DOUBLE)) FROM orders WHERE o_orderstatus = 'O'), 2) AS ds2_mean,
  round((SELECT SUM(CAST({c} AS DOUBLE)) FROM orders WHERE o_orderstatus = 'F'), 2) AS ds1_sum,
  round((SELECT SUM(CAST({c} AS DOUBLE)) FROM orders WHERE o_orderstatus = 'O'), 2) AS ds2_sum"""
    for c in ["o_custkey", "o_orderkey", "o_totalprice"]
]))
def q_compare(spark, d):
    """Compare finished vs open orders on their shared numeric columns."""
    o = table(spark, d, "orders")
    return summaries.compare(o.where(F.col("o_orderstatus") == "F"), o.where(F.col("o_orderstatus") == "O"))


# Q1 -----------------------------------------------------------------------
_EV_TYPES = {"event_id": "numeric", "ts": "datetime", "user_id": "numeric", "event_type": "text",
             "value": "numeric", "props": "text"}


def _ts_text_sql(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN microsecond({x}) % 1000000 = 0 THEN strftime({x}, '%Y-%m-%d %H:%M:%S') "
            f"ELSE strftime({x}, '%Y-%m-%d %H:%M:%S.%f') END")


def _profile_sql() -> str:
    parts = []
    for c, t in _EV_TYPES.items():
        num = t == "numeric"
        dt = t == "datetime"
        txt = t == "text"
        parts.append(f"""SELECT '{c}' AS column, '{t}' AS data_type,
  round(COUNT(*) FILTER (WHERE {c} IS NULL) / greatest(COUNT(*), 1), 4) AS null_ratio,
  round(COUNT(DISTINCT {c}) / greatest(COUNT(*), 1), 4) AS unique_ratio,
  (SELECT list(v ORDER BY n DESC, v) FROM (SELECT CAST({c} AS VARCHAR) AS v, COUNT(*) AS n FROM events WHERE {c} IS NOT NULL
     GROUP BY 1 ORDER BY n DESC, v LIMIT 5)) AS top_5,
  {f'MIN(CAST({c} AS DOUBLE))' if num else 'CAST(NULL AS DOUBLE)'} AS min,
  {f'MAX(CAST({c} AS DOUBLE))' if num else 'CAST(NULL AS DOUBLE)'} AS max,
  {f'round(AVG(CAST({c} AS DOUBLE)), 2)' if num else 'CAST(NULL AS DOUBLE)'} AS mean,
  {f'round(STDDEV_SAMP(CAST({c} AS DOUBLE)), 2)' if num else 'CAST(NULL AS DOUBLE)'} AS std_dev,
  {_ts_text_sql(f'MIN({c})') if dt else 'CAST(NULL AS VARCHAR)'} AS min_date,
  {_ts_text_sql(f'MAX({c})') if dt else 'CAST(NULL AS VARCHAR)'} AS max_date,
  {f'round(COALESCE(AVG(length({c})), 0.0), 1)' if txt else 'CAST(NULL AS DOUBLE)'} AS avg_char_length
FROM events""")
    return _union(parts)


@register("q_profile", _profile_sql())
def q_profile(spark, d):
    """Q1/Q2: column profile of events (types detected, not given)."""
    return summaries.profile(table(spark, d, "events"))


# Q3 / Q6 ------------------------------------------------------------------
_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("q_corr_edges", "SELECT * FROM (" + _union([
    f"SELECT '{a}' AS source, '{b}' AS target, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM lineitem"
    for i, a in enumerate(_LI_NUM) for b in _LI_NUM[i + 1:]
]).replace("SELECT '", "SELECT '", 1) + ") WHERE r IS NOT NULL AND NOT isnan(r) AND abs(r) >= 0.3")
def q_corr_edges(spark, d):
    """Q3: Pearson edges |r| ≥ 0.3 between lineitem numeric columns."""
    return summaries.correlations(table(spark, d, "lineitem"))


# DuckDB query above selects r; rename to the operator's columns.
from briskbi.plans.registry import ORACLE as _OR  # noqa: E402

_OR["q_corr_edges"] = ("SELECT source, target, round(r, 3) + 0.0 AS weight, 'pearson' AS method FROM ("
                       + _OR["q_corr_edges"] + ")")


def _corr_matrix_sql() -> str:
    cols = ", ".join(f"var_samp(CAST({c} AS DOUBLE)) AS v_{c}" for c in _LI_NUM)
    pairs = []
    for a in _LI_NUM:
        for b in _LI_NUM:
            if a == b:
                pairs.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST(1.0 AS DOUBLE) AS r")
            else:
                r = f"round(corr(CAST({min(a, b)} AS DOUBLE), CAST({max(a, b)} AS DOUBLE)), 3) + 0.0"
                pairs.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST({r} AS DOUBLE) AS r FROM lineitem")
    return _union(pairs)


@register("q_corr_matrix", _corr_matrix_sql())
def q_corr_matrix(spark, d):
    """Q6: Pearson matrix of the lineitem columns."""
    return summaries.correlation_matrix(table(spark, d, "lineitem").drop("l_shipdate"))


# Q5 -----------------------------------------------------------------------
@register("q_mi_discrete", """
WITH p AS (SELECT o_orderstatus AS x, o_orderpriority AS y, COUNT(*) AS nxy FROM orders
           WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2),
n AS (SELECT SUM(nxy) AS n FROM p),
px AS (SELECT x, SUM(nxy) AS nx FROM p GROUP BY 1),
py AS (SELECT y, SUM(nxy) AS ny FROM p GROUP BY 1)
SELECT 'o_orderstatus' AS feature, 'o_orderpriority' AS target,
  round(SUM((nxy / n) * ln((nxy * n) / (nx * ny))), 6) AS mi
FROM p JOIN px USING (x) JOIN py USING (y), n
""")
def q_mi_discrete(spark, d):
    """Q5: exact mutual information between order status and priority."""
    return summaries.mutual_info_discrete(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@register("q_rank_features", """
WITH f AS (SELECT 'l_orderkey' AS feature, 'pearson' AS method, round(abs(corr(CAST(l_orderkey AS DOUBLE), CAST(l_extendedprice AS DOUBLE))), 6) AS score FROM lineitem
UNION ALL
SELECT 'l_partkey' AS feature, 'pearson' AS method, round(abs(corr(CAST(l_partkey AS DOUBLE), CAST(l_extendedprice AS DOUBLE))), 6) AS score FROM lineitem
UNION ALL
SELECT 'l_suppkey' AS feature, 'pearson' AS method, round(abs(corr(CAST(l_suppkey AS DOUBLE), CAST(l_extendedprice AS DOUBLE))), 6) AS score FROM lineitem
UNION ALL
SELECT 'l_linenumber' AS feature, 'pearson' AS method, round(abs(corr(CAST(l_linenumber AS DOUBLE), CAST(l_extendedprice AS DOUBLE))), 6) AS score FROM lineitem
UNION ALL
SELECT 'l_quantity' AS feature, 'pearson' AS method, round(abs(corr(CAST(l_quantity AS DOUBLE), CAST(l_extendedprice AS DOUBLE))), 6) AS score FROM lineitem
UNION ALL
SELECT 'l_discount' AS feature, 'pearson' AS method, round(abs(corr(CAST(l_discount AS DOUBLE), CAST(l_extendedprice AS DOUBLE))), 6) AS score FROM lineitem
UNION ALL
SELECT 'l_tax' AS feature, 'pearson' AS method, round(abs(corr(CAST(l_tax AS DOUBLE), CAST(l_extendedprice AS DOUBLE))), 6) AS score FROM lineitem
UNION ALL
SELECT 'l_returnflag' AS feature, 'mutual_info' AS method, round(mi, 6) AS score FROM (
  SELECT round(SUM((nxy / n) * ln((nxy * n) / (nx * ny))), 6) AS mi FROM (
    SELECT x, b, nxy, SUM(nxy) OVER (PARTITION BY x) AS nx, SUM(nxy) OVER (PARTITION BY b) AS ny, SUM(nxy) OVER () AS n FROM (
      SELECT l_returnflag AS x, least(floor((CAST(l_extendedprice AS DOUBLE) - s.mn) / s.w), 9) AS b, COUNT(*) AS nxy
      FROM lineitem, (SELECT min(CAST(l_extendedprice AS DOUBLE)) AS mn,
                             (max(CAST(l_extendedprice AS DOUBLE)) - min(CAST(l_extendedprice AS DOUBLE))) / 10 AS w FROM lineitem) s
      WHERE l_extendedprice IS NOT NULL AND l_returnflag IS NOT NULL GROUP BY 1, 2) c) p) m
UNION ALL
SELECT 'l_linestatus' AS feature, 'mutual_info' AS method, round(mi, 6) AS score FROM (
  SELECT round(SUM((nxy / n) * ln((nxy * n) / (nx * ny))), 6) AS mi FROM (
    SELECT x, b, nxy, SUM(nxy) OVER (PARTITION BY x) AS nx, SUM(nxy) OVER (PARTITION BY b) AS ny, SUM(nxy) OVER () AS n FROM (
      SELECT l_linestatus AS x, least(floor((CAST(l_extendedprice AS DOUBLE) - s.mn) / s.w), 9) AS b, COUNT(*) AS nxy
      FROM lineitem, (SELECT min(CAST(l_extendedprice AS DOUBLE)) AS mn,
                             (max(CAST(l_extendedprice AS DOUBLE)) - min(CAST(l_extendedprice AS DOUBLE))) / 10 AS w FROM lineitem) s
      WHERE l_extendedprice IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2) c) p) m)
SELECT feature, method, score, round(score / max(score) OVER (), 6) AS scaled FROM f
""")
def q_rank_features(spark, d):
    """Q5: rank lineitem columns as predictors of extended price."""
    li = table(spark, d, "lineitem").drop("l_shipdate")
    return summaries.rank_features(li, "l_extendedprice")


# C23 ----------------------------------------------------------------------
@register("q_grouped_means", """
SELECT c_nationkey, AVG(CAST(c_acctbal AS DOUBLE)) AS c_acctbal, AVG(CAST(c_custkey AS DOUBLE)) AS c_custkey
FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1
""")
def q_grouped_means(spark, d):
    """Mean of two metrics for every nation."""
    return summaries.grouped_means(table(spark, d, "customer"), "c_nationkey", ["c_acctbal", "c_custkey"])


# B13 ----------------------------------------------------------------------
@register("q_display_names", r"""
SELECT "column", array_to_string(list_transform(string_split(regexp_replace(trim("column"), '[_\s]+', ' ', 'g'), ' '),
         lambda w: CASE WHEN lower(w) IN ('id', 'kpi', 'url', 'api', 'ip') THEN upper(w)
                        ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ') AS display_name
FROM (SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS "column")
""")
def q_display_names(spark, d):
    """Display names of the profiled lineitem columns (title case, acronyms upper)."""
    from briskbi.functions.labels import title_case_name

    prof = summaries.profile(table(spark, d, "customer"))
    return prof.select("column", title_case_name(F.col("column")).alias("display_name"))


# J3 -----------------------------------------------------------------------
_ORDER_ROLES = {"o_orderkey": "id", "o_totalprice": "measure", "o_orderdate": "date", "o_orderpriority": "dimension",
                "not_a_column": "measure"}


@register("q_profile_roles", """
WITH cols AS (SELECT column_name AS "column",
                CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric'
                     WHEN column_type LIKE 'TIMESTAMP%' THEN 'datetime' ELSE 'text' END AS data_type
              FROM (DESCRIBE orders)),
roles AS (SELECT * FROM (VALUES ('o_orderkey', 'id'), ('o_totalprice', 'measure'), ('o_orderdate', 'date'),
  ('o_orderpriority', 'dimension'), ('not_a_column', 'measure')) t("column", role))
SELECT cols."column", roles.role, cols.data_type FROM cols JOIN roles USING ("column")
""")
def q_profile_roles(spark, d):
    """Roles attached to the profiled order columns (unknown role names are skipped)."""
    prof = summaries.profile(table(spark, d, "orders"))
    return summaries.attach_roles(prof, _ORDER_ROLES).select("column", "role", "data_type")


@register("q_grouped_sums", """
SELECT c_mktsegment, SUM(CAST(c_nationkey AS DOUBLE)) AS c_nationkey, SUM(CAST(c_custkey AS DOUBLE)) AS c_custkey
FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1
""")
def q_grouped_sums(spark, d):
    """Sums by market segment."""
    return summaries.grouped_means(table(spark, d, "customer"), "c_mktsegment", ["c_nationkey", "c_custkey"], agg="sum")


@register("q_null_percentages", """
SELECT 'o_totalprice' AS "column", round(100.0 * count(*) FILTER (WHERE o_orderpriority = '5-LOW') / count(*), 2) AS null_pct FROM orders
""")
def q_null_percentages(spark, d):
    """Share of nulls of each column that has any (prices of low-priority orders blanked)."""
    o = table(spark, d, "orders")
    return summaries.null_percentages(o.withColumn("o_totalprice", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice"))))


@register("q_zscore_rows", """
WITH s AS (SELECT avg(CAST(o_totalprice AS DOUBLE)) AS m, stddev_samp(CAST(o_totalprice AS DOUBLE)) AS d FROM orders)
SELECT o_orderkey, round((o_totalprice - m) / d, 6) AS z FROM orders, s WHERE abs((o_totalprice - m) / d) > 1.7
""")
def q_zscore_rows(spark, d):
    """The orders whose price is more than 1.7 standard deviations from the mean."""
    z = summaries.zscore_rows(table(spark, d, "orders"), "o_totalprice", threshold=1.7)
    return z.select("o_orderkey", F.round("z", 6).alias("z"))


@register("q_corr_edges_low", """
SELECT 'l_quantity' AS source, 'l_extendedprice' AS target, round(corr(l_quantity, l_extendedprice), 3) + 0.0 AS weight, 'pearson' AS method FROM lineitem
UNION ALL
SELECT 'l_extendedprice', 'doubled', round(corr(l_extendedprice, l_extendedprice * 2 + l_quantity), 3) + 0.0, 'pearson' FROM lineitem
UNION ALL
SELECT 'l_quantity', 'doubled', round(corr(l_quantity, l_extendedprice * 2 + l_quantity), 3) + 0.0, 'pearson' FROM lineitem
""")
def q_corr_edges_low(spark, d):
    """Q3: every correlated pair of three columns and a constant one, which has no edge."""
    li = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", (F.col("l_extendedprice") * 2 + F.col("l_quantity")).alias("doubled"), F.lit(7).alias("same"))
    return summaries.correlations(li, min_abs=0.0)


def _category_edge_sql(cat: str, num: str) -> str:
    return f"""
SELECT '{cat}' AS source, '{num}' AS target, round(mi / greatest(1.0, mi), 3) AS weight, 'mutual_info' AS method FROM (
  SELECT round(SUM((nxy / n) * ln((nxy * n) / (nx * ny))), 6) AS mi FROM (
    SELECT nxy, SUM(nxy) OVER (PARTITION BY x) AS nx, SUM(nxy) OVER (PARTITION BY b) AS ny, SUM(nxy) OVER () AS n FROM (
      SELECT {cat} AS x, least(floor((CAST({num} AS DOUBLE) - s.mn) / s.w), 9) AS b, COUNT(*) AS nxy
      FROM lineitem, (SELECT min(CAST({num} AS DOUBLE)) AS mn, (max(CAST({num} AS DOUBLE)) - min(CAST({num} AS DOUBLE))) / 10 AS w FROM lineitem) s
      WHERE {num} IS NOT NULL AND {cat} IS NOT NULL GROUP BY 1, 2) c) p) m"""


@register("q_category_edges", " UNION ALL ".join(_category_edge_sql(c, n) for c in ("l_returnflag", "l_linestatus") for n in ("l_quantity", "l_extendedprice")))
def q_category_edges(spark, d):
    """Q4: mutual information of flags with quantity and price, all pairs in one count."""
    return summaries.category_edges(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"], min_score=0.0)


@register("q_mi_neighbors")
def q_mi_neighbors(spark, d):
    """Q4: nearest-neighbour mutual information of order status and total price."""
    return summaries.mutual_info_neighbors(table(spark, d, "orders"), "o_orderstatus", "o_totalprice")
