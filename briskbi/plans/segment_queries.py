"""Segmentation queries (G1–G11) on orders and lineitem."""

from __future__ import annotations

from briskbi.operators import segment
from briskbi.plans.registry import register
from briskbi.session import table

_RFM_VALUES = ", ".join(f"({r}, {f}, {m}, '{name.replace(chr(39), chr(39) * 2)}')"
                        for (r, f, m), name in segment.RFM_SEGMENT_MAP.items())

_RFM_BASE = f"""
w AS (SELECT o_custkey AS entity, o_orderdate AS d, o_totalprice AS m FROM orders
      WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL),
ref AS (SELECT epoch_us(max(d)) + 86400000000 AS ref_us FROM w),
e AS (SELECT entity, CAST(floor((max(ref.ref_us) - epoch_us(max(d))) / 86400000000) AS BIGINT) AS recency,
             count(d) AS frequency, CAST(SUM(CAST(m AS DECIMAL(38,2))) AS DOUBLE) AS monetary
      FROM w, ref GROUP BY entity),
n AS (SELECT count(*) AS n FROM e),
s AS (SELECT CAST(recency AS DOUBLE) AS v, row_number() OVER (ORDER BY recency) - 1 AS pos FROM e),
pp AS (SELECT CAST(p AS DOUBLE) AS p FROM (VALUES (0.0), (0.2), (0.4), (0.6), (0.8), (1.0)) t(p)),
t AS (SELECT pp.p, (n.n - 1) * pp.p AS pos FROM pp, n),
q AS (SELECT a.v + (b.v - a.v) * (t.pos - floor(t.pos)) AS edge FROM t
      JOIN s a ON a.pos = CAST(floor(t.pos) AS BIGINT) JOIN s b ON b.pos = CAST(ceil(t.pos) AS BIGINT)),
ue AS (SELECT edge, row_number() OVER (ORDER BY edge) - 1 AS i, count(*) OVER () - 1 AS nb FROM (SELECT DISTINCT edge FROM q)),
ie AS (SELECT edge FROM ue WHERE i >= 1 AND i <= nb - 1),
nbv AS (SELECT max(nb) AS nb FROM ue),
r AS (SELECT e.*, (SELECT count(*) FROM ie WHERE ie.edge < CAST(e.recency AS DOUBLE)) AS rbin,
        row_number() OVER (ORDER BY frequency, entity) AS f_rank,
        row_number() OVER (ORDER BY monetary, entity) AS m_rank FROM e),
sc AS (SELECT r.entity, r.recency, r.frequency, r.monetary,
   CAST(CASE nbv.nb WHEN 2 THEN [5, 1][rbin + 1] WHEN 3 THEN [5, 3, 1][rbin + 1] WHEN 4 THEN [5, 4, 2, 1][rbin + 1]
        WHEN 5 THEN [5, 4, 3, 2, 1][rbin + 1] ELSE 3 END AS INTEGER) AS r_score,
   CAST(CASE WHEN n.n <= 1 THEN 3 ELSE greatest(1, ceil(CAST(5.0 AS DOUBLE) * (f_rank - 1) / (n.n - 1))) END AS INTEGER) AS f_score,
   CAST(CASE WHEN n.n <= 1 THEN 3 ELSE greatest(1, ceil(CAST(5.0 AS DOUBLE) * (m_rank - 1) / (n.n - 1))) END AS INTEGER) AS m_score
 FROM r, nbv, n),
map AS (SELECT * FROM (VALUES {_RFM_VALUES}) t(r, f, m, name)),
rfm AS (SELECT sc.*, COALESCE(map.name,
          CASE WHEN (r_score + f_score + m_score) / 3.0 >= 4 THEN 'Loyal Customers'
               WHEN (r_score + f_score + m_score) / 3.0 >= 3 THEN 'Need Attention'
               WHEN (r_score + f_score + m_score) / 3.0 >= 2 THEN 'At Risk' ELSE 'Lost' END) AS segment
        FROM sc LEFT JOIN map ON map.r = sc.r_score AND map.f = sc.f_score AND map.m = sc.m_score)
"""


def _rfm(spark, d):
    return segment.rfm(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice", scale=2)


@register("q_rfm", f"WITH {_RFM_BASE} SELECT * FROM rfm")
def q_rfm(spark, d):
    """RFM scores and segments of customers from their orders."""
    return _rfm(spark, d)


@register("q_rfm_summary", f"""
WITH {_RFM_BASE},
g AS (SELECT segment, count(*) AS size, AVG(recency) AS avg_recency, AVG(frequency) AS avg_frequency,
             CAST(SUM(CAST(monetary AS DECIMAL(38,2))) AS DOUBLE) / count(*) AS avg_monetary FROM rfm GROUP BY segment),
tot AS (SELECT SUM(size) AS total FROM g),
tp AS (SELECT segment, list(CAST(entity AS VARCHAR) ORDER BY rn) AS top_entities FROM
       (SELECT segment, entity, row_number() OVER (PARTITION BY segment ORDER BY monetary DESC, entity) AS rn FROM rfm)
       WHERE rn <= 5 GROUP BY segment)
SELECT g.segment, g.size, g.avg_recency, g.avg_frequency, g.avg_monetary, round(g.size / tot.total * 100, 1) AS percentage,
       tp.top_entities
FROM g, tot LEFT JOIN tp ON tp.segment = g.segment
""")
def q_rfm_summary(spark, d):
    """RFM segment sizes, shares, mean metrics and top-5 customers."""
    return segment.summarize(_rfm(spark, d), "rfm", ["recency", "frequency", "monetary"], "monetary", scale=2)


_ABC_BASE = """
g AS (SELECT l_partkey AS entity, CAST(SUM(CAST(l_extendedprice AS DECIMAL(38,2))) AS DOUBLE) AS total_value
      FROM lineitem WHERE l_partkey IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1),
r AS (SELECT entity, total_value, row_number() OVER (ORDER BY total_value DESC, entity) AS position,
        CAST(SUM(CAST(total_value AS DECIMAL(38,2))) OVER (ORDER BY total_value DESC, entity
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running,
        CAST(SUM(CAST(total_value AS DECIMAL(38,2))) OVER () AS DOUBLE) AS total FROM g),
abc AS (SELECT entity, total_value, round(running / total * 100, 2) AS cumulative_pct, position,
        CASE WHEN round(running / total * 100, 2) <= 80 THEN 'A - High Share'
             WHEN round(running / total * 100, 2) <= 95 THEN 'B - Medium Share' ELSE 'C - Low Share' END AS segment FROM r)
"""


def _abc(spark, d):
    return segment.abc(table(spark, d, "lineitem"), "l_partkey", "l_extendedprice", scale=2)


@register("q_abc", f"WITH {_ABC_BASE} SELECT * FROM abc")
def q_abc(spark, d):
    """ABC classes of parts by revenue with the exact running share."""
    return _abc(spark, d)


@register("q_abc_summary", f"""
WITH {_ABC_BASE},
sg AS (SELECT segment, count(*) AS size, CAST(SUM(CAST(total_value AS DECIMAL(38,2))) AS DOUBLE) AS total_value FROM abc GROUP BY segment),
tot AS (SELECT SUM(size) AS n, CAST(SUM(CAST(total_value AS DECIMAL(38,2))) AS DOUBLE) AS v FROM sg),
tp AS (SELECT segment, list(CAST(entity AS VARCHAR) ORDER BY rn) AS top_entities FROM
       (SELECT segment, entity, row_number() OVER (PARTITION BY segment ORDER BY total_value DESC, entity) AS rn FROM abc)
       WHERE rn <= 5 GROUP BY segment)
SELECT sg.segment, sg.size, sg.total_value, round(sg.size / tot.n * 100, 1) AS percentage,
       sg.total_value / tot.v * 100 AS value_share, tp.top_entities
FROM sg, tot LEFT JOIN tp ON tp.segment = sg.segment
""")
def q_abc_summary(spark, d):
    """ABC class sizes, value sums, shares and top-5 parts."""
    return segment.summarize(_abc(spark, d), "abc", ["total_value"], "total_value", scale=2)


@register("q_abc_pareto", f"""
WITH {_ABC_BASE} SELECT entity, total_value, cumulative_pct, segment FROM abc ORDER BY position LIMIT 40
""")
def q_abc_pareto(spark, d):
    """Entity Pareto (first 40 parts in ABC order)."""
    return segment.entity_pareto(_abc(spark, d))


@register("q_rfm_evidence", f"""
WITH {_RFM_BASE},
g AS (SELECT segment, count(*) AS size, CAST(SUM(CAST(monetary AS DECIMAL(38,2))) AS DOUBLE) / count(*) AS k
      FROM rfm GROUP BY segment),
ev AS (SELECT *, lag(k) OVER (ORDER BY k, segment) AS prev FROM g)
SELECT CAST(SUM(size) AS BIGINT) AS entity_count, COUNT(*) AS segment_count, SUM(size) < 30 AS small_sample,
  COALESCE(list_sort(list(segment) FILTER (WHERE size = 1)), CAST([] AS VARCHAR[])) AS single_entity_segments,
  COALESCE(max(CASE WHEN abs(k - prev) / greatest(greatest(abs(k), abs(prev)), 1e-300) * 100 <= 10 THEN 1 ELSE 0 END), 0) = 1
    AS marginal_separation
FROM ev
""")
def q_rfm_evidence(spark, d):
    """Evidence flags of the RFM segmentation (small sample, close segments)."""
    summ = segment.summarize(_rfm(spark, d), "rfm", ["recency", "frequency", "monetary"], "monetary", scale=2)
    return segment.evidence(summ, "avg_monetary", method="rfm")


@register("q_kmeans")
def q_kmeans(spark, d):
    """K-Means (k = 3..6 by silhouette) on customers' RFM metrics, with a 2-D PCA."""
    rfm = _rfm(spark, d)
    out, _, _ = segment.kmeans(rfm, ["recency", "frequency", "monetary"], entity="entity", starts=3)
    return out


@register("q_scatter_sample", """
SELECT c_custkey, c_acctbal FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR) || '42'), c_custkey LIMIT 500
""")
def q_scatter_sample(spark, d):
    """Repeatable 500-customer scatter sample."""
    return segment.scatter_sample(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
