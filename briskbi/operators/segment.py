"""Entity segmentation: RFM, ABC, K-Means, strategy choice and summaries.

Per-entity tables come from one ``groupBy(entity)``.  Quintile scores and the
ABC cumulative share need a total order over all entities; they use the
range-partitioned ``global_order`` helper instead of an un-partitioned window,
so no task ever holds every entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briskbi.functions.parse import to_number, to_timestamp_mixed
from briskbi.operators.ranking import exact_percentiles, global_order
from briskbi.session import cut_lineage

# ---------------------------------------------------------------------------
# RFM (recency, frequency, monetary) score triple → segment name.
# ---------------------------------------------------------------------------
RFM_SEGMENT_MAP = {
    (5, 5, 5): "Champions",
    (5, 5, 4): "Champions",
    (5, 4, 5): "Champions",
    (5, 4, 4): "Champions",
    (4, 5, 5): "Loyal Customers",
    (4, 5, 4): "Loyal Customers",
    (4, 4, 5): "Loyal Customers",
    (4, 4, 4): "Loyal Customers",
    (5, 3, 5): "Loyal Customers",
    (5, 3, 4): "Loyal Customers",
    (3, 5, 5): "Loyal Customers",
    (5, 5, 3): "Potential Loyalists",
    (5, 4, 3): "Potential Loyalists",
    (4, 5, 3): "Potential Loyalists",
    (4, 4, 3): "Potential Loyalists",
    (5, 5, 2): "Potential Loyalists",
    (5, 4, 2): "Potential Loyalists",
    (5, 5, 1): "New Customers",
    (5, 4, 1): "New Customers",
    (5, 3, 1): "New Customers",
    (4, 5, 1): "New Customers",
    (4, 4, 1): "New Customers",
    (5, 3, 2): "Promising",
    (4, 3, 3): "Promising",
    (4, 3, 2): "Promising",
    (3, 3, 3): "Need Attention",
    (3, 3, 4): "Need Attention",
    (3, 4, 4): "Need Attention",
    (3, 4, 3): "Need Attention",
    (3, 3, 5): "Need Attention",
    (2, 3, 3): "About to Sleep",
    (2, 3, 4): "About to Sleep",
    (2, 2, 3): "About to Sleep",
    (2, 2, 4): "About to Sleep",
    (3, 2, 3): "About to Sleep",
    (1, 3, 3): "At Risk",
    (1, 3, 4): "At Risk",
    (1, 3, 5): "At Risk",
    (1, 4, 4): "At Risk",
    (1, 4, 5): "At Risk",
    (1, 5, 5): "At Risk",
    (2, 5, 5): "At Risk",
    (2, 4, 5): "At Risk",
    (2, 5, 4): "At Risk",
    (1, 5, 4): "At Risk",
    (1, 5, 3): "Can't Lose Them",
    (1, 4, 3): "Can't Lose Them",
    (2, 5, 3): "Can't Lose Them",
    (1, 5, 2): "Hibernating",
    (1, 4, 2): "Hibernating",
    (1, 3, 2): "Hibernating",
    (2, 3, 2): "Hibernating",
    (2, 4, 2): "Hibernating",
    (1, 2, 2): "Lost",
    (1, 1, 1): "Lost",
    (1, 1, 2): "Lost",
    (1, 2, 1): "Lost",
    (2, 1, 1): "Lost",
    (2, 2, 1): "Lost",
    (2, 2, 2): "Lost",
    (1, 1, 3): "Lost",
    (1, 2, 3): "Lost",
    (2, 1, 2): "Lost",
    (2, 1, 3): "Lost",
}
# Fallback by mean score: >= 4, >= 3, >= 2, else.
RFM_MEAN_FALLBACK = [(4, "Loyal Customers"), (3, "Need Attention"), (2, "At Risk")]
RFM_MEAN_LAST = "Lost"
# ABC thresholds on the cumulative share (percent) and their labels.
ABC_LIMITS = [(80, "A - High Share"), (95, "B - Medium Share")]
ABC_LAST = "C - Low Share"
# Segment names treated as "top" and "at risk" by the signals.
TOP_SEGMENTS = ["Champions", "A - High Share"]
RISK_SEGMENTS = ["At Risk", "Can't Lose Them", "Hibernating", "Lost"]
# ---------------------------------------------------------------------------

QUINTILE_PROBS = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


def rfm_label(r: Column, f: Column, m: Column) -> Column:
    """Segment from the map, else from the mean score."""
    key = F.concat_ws(",", r.cast("string"), f.cast("string"), m.cast("string"))
    lookup = F.create_map(*[x for (a, b, c), name in RFM_SEGMENT_MAP.items()
                            for x in (F.lit(f"{a},{b},{c}"), F.lit(name))])
    mean = (r + f + m) / 3.0
    fallback = F.lit(RFM_MEAN_LAST)
    for bound, name in reversed(RFM_MEAN_FALLBACK):
        fallback = F.when(mean >= bound, F.lit(name)).otherwise(fallback)
    return F.coalesce(F.element_at(lookup, key), fallback)


def rank_quintile(rank: Column, n: Column) -> Column:
    """G2 for ordinal ranks 1..n: least k with rank ≤ 1 + (n−1)·k/5; n = 1 → 3."""
    return F.when(n <= 1, F.lit(3)).otherwise(
        F.greatest(F.lit(1), F.ceil(F.lit(5.0) * (rank - 1) / (n - 1))).cast("int"))


def value_quintile(x: Column, edges: list[float], reverse: bool = True) -> Column:
    """G2 for values: ``qcut(q=5)`` with duplicate edges dropped.

    ``edges`` are the six quantiles; with five distinct bins the labels apply
    directly, otherwise bin indices are spread over the labels proportionally
    (Python half-even rounding) and a single bin gets the middle label.
    """
    labels = [5, 4, 3, 2, 1] if reverse else [1, 2, 3, 4, 5]
    uniq = sorted(set(edges))
    nb = len(uniq) - 1
    if nb <= 1:
        return F.lit(labels[2])
    inner = uniq[1:nb]
    bin_ = sum((F.when(F.lit(e) < x, 1).otherwise(0) for e in inner), F.lit(0))
    if nb == 5:
        mapping = labels
    else:
        step = (len(labels) - 1) / (nb - 1)
        mapping = [labels[round(i * step)] for i in range(nb)]
    arr = F.array(*[F.lit(v) for v in mapping])
    return F.element_at(arr, (bin_ + 1).cast("int"))


def rfm(df: DataFrame, entity: str, date: str, monetary: str, scale: int | None = None) -> DataFrame:
    """(entity, recency, frequency, monetary, r_score, f_score, m_score, segment).

    Reference date = newest date + 1 day; recency in whole days; rows with a
    null entity, date or amount are dropped first.
    """
    ts = to_timestamp_mixed(F.col(date), df.schema[date].dataType)
    m = to_number(F.col(monetary), df.schema[monetary].dataType)
    work = df.select(F.col(entity).alias("entity"), ts.alias("d"), m.alias("m")).where(
        F.col("entity").isNotNull() & F.col("d").isNotNull() & F.col("m").isNotNull())
    newest = work.agg(F.max("d").alias("mx")).collect()[0]["mx"]
    if newest is None:
        raise ValueError("RFM needs at least one row with an entity, a date and an amount")
    # Wall-clock arithmetic on timestamp_ntz: independent of the session time zone.
    ref = F.lit(newest.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    msum = F.sum(F.col("m").cast(f"decimal(38,{scale})")).cast("double") if scale is not None else F.sum("m")
    ent = work.groupBy("entity").agg(
        F.floor(F.timestamp_diff("MICROSECOND", F.max("d"), ref) / F.lit(86_400_000_000)).cast("long").alias("recency"),
        F.count("d").alias("frequency"),
        msum.alias("monetary"),
    )
    ent = cut_lineage(ent)  # read by the percentiles, two global orders and the final join
    n = ent.count()
    edges_row = exact_percentiles(ent, [], "recency", QUINTILE_PROBS).collect()[0]
    edges = [float(edges_row[f"p{i}"]) for i in range(len(QUINTILE_PROBS))]
    # F and M: ordinal rank over (metric, entity) then the closed-form quintile.
    f_rank = global_order(ent.select("entity", "frequency"), [F.col("frequency"), F.col("entity")], rank_col="f_rank")
    m_rank = global_order(ent.select("entity", "monetary"), [F.col("monetary"), F.col("entity")], rank_col="m_rank")
    out = (ent.join(f_rank.select("entity", "f_rank"), "entity").join(m_rank.select("entity", "m_rank"), "entity"))
    nn = F.lit(n)
    out = out.select(
        "entity", "recency", "frequency", "monetary",
        value_quintile(F.col("recency").cast("double"), edges, reverse=True).cast("int").alias("r_score"),
        rank_quintile(F.col("f_rank"), nn).alias("f_score"),
        rank_quintile(F.col("m_rank"), nn).alias("m_score"),
    )
    return out.withColumn("segment", rfm_label(F.col("r_score"), F.col("f_score"), F.col("m_score")))


def abc(df: DataFrame, entity: str, value: str, scale: int | None = None) -> DataFrame:
    """(entity, total_value, cumulative_pct, segment) by descending value.

    The running share uses an exact fixed-point running sum over the global
    order (value desc, entity asc), range-partitioned across tasks.  ``scale`` names the
    decimals of money columns; without it amounts are summed as they are and the
    running sum keeps twelve significant decimals of the share.  With a total of 0 every share is 0.
    """
    v = to_number(F.col(value), df.schema[value].dataType)
    g = df.select(F.col(entity).alias("entity"), v.alias("v")).where(F.col("entity").isNotNull() & F.col("v").isNotNull())
    exact = (lambda c: F.sum(c.cast(f"decimal(38,{scale})")).cast("double")) if scale is not None else F.sum
    g = g.groupBy("entity").agg(exact(F.col("v")).alias("total_value"))
    total = g.agg(exact(F.col("total_value")).alias("t")).collect()[0]["t"]
    if total is None:
        raise ValueError("ABC needs at least one row with an entity and an amount")
    if scale is None:  # the running sum is over shares of the total, in fixed point
        shared = g.withColumn("_share", F.col("total_value") / F.lit(total)) if total else g.withColumn("_share", F.lit(0.0))
        ordered = global_order(shared, [F.col("total_value").desc(), F.col("entity").asc()], running_sum="_share",
                               scale=12, rank_col="position", running_col="running")
        pct = F.round(F.col("running") * 100, 2)
    else:
        ordered = global_order(g, [F.col("total_value").desc(), F.col("entity").asc()], running_sum="total_value",
                               scale=scale, rank_col="position", running_col="running")
        pct = F.round(F.col("running") / F.lit(total) * 100, 2) if total else F.lit(0.0)
    seg = F.lit(ABC_LAST)
    for bound, name in reversed(ABC_LIMITS):
        seg = F.when(F.col("cumulative_pct") <= bound, F.lit(name)).otherwise(seg)
    return ordered.select("entity", "total_value", pct.alias("cumulative_pct"), "position").withColumn("segment", seg)


def kmeans(df: DataFrame, cols: list[str], entity: str | None = None, ks=range(3, 7), seed: int = 42,
           max_iter: int = 300, starts: int = 10, min_rows: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Standardised K-Means with the best silhouette over ``ks``, plus a 2-D PCA.

    Each k keeps the cheapest of ``starts`` runs.  Fewer than ``min_rows`` complete
    rows raise an error; no k may exceed the number of rows.

    Returns (assignments, centres, importance): assignments carry ``cluster``,
    ``pc1``, ``pc2``; centres carry the centre vector, k and silhouette;
    importance is each feature's share of the spread (population std) of the centres.
    Cluster ids are ordered by size.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    keep = ([entity] if entity else []) + cols
    base = df.select(*[F.col(c) for c in keep]).dropna(subset=cols)
    for c in cols:
        base = base.withColumn(c, F.col(c).cast("double"))
    vec = VectorAssembler(inputCols=cols, outputCol="raw").transform(base)
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(vec).transform(vec)
    scaled = cut_lineage(scaled)  # read by every run; its files go when nothing refers to it any more
    n = scaled.count()
    if n < min_rows:
        raise ValueError(f"K-Means needs at least {min_rows} complete rows, not {n}")
    best = None
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="cluster_raw", metricName="silhouette")
    for k in [k for k in ks if k <= n]:
        runs = [KMeans(k=k, seed=seed + i, maxIter=max_iter, featuresCol="features", predictionCol="cluster_raw").fit(scaled) for i in range(starts)]
        model = min(runs, key=lambda m: m.summary.trainingCost)
        pred = model.transform(scaled)
        sil = ev.evaluate(pred)
        if best is None or sil > best[0]:
            best = (sil, k, model, pred)
    sil, k, model, pred = best
    pca = PCA(k=2, inputCol="features", outputCol="pc").fit(scaled)
    pred = pca.transform(pred)
    sizes = pred.groupBy("cluster_raw").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("n").desc(), F.col("cluster_raw"))  # ≤ max(ks) rows
    relabel = sizes.withColumn("cluster", F.row_number().over(order) - 1).select("cluster_raw", "cluster")
    arr = F.col("pc")
    from pyspark.ml.functions import vector_to_array

    out = pred.join(F.broadcast(relabel), "cluster_raw").select(
        *keep, "cluster", vector_to_array(arr)[0].alias("pc1"), vector_to_array(arr)[1].alias("pc2"))
    centers = model.clusterCenters()
    rows = [(int(i), [float(x) for x in c]) for i, c in enumerate(centers)]
    cdf = df.sparkSession.createDataFrame(rows, "cluster_raw int, center array<double>")
    cdf = cdf.join(F.broadcast(relabel), "cluster_raw").select("cluster", "center")
    imp = []
    for j, c in enumerate(cols):
        vals = [r[1][j] for r in rows]
        mean = sum(vals) / len(vals)
        imp.append((c, (sum((v - mean) ** 2 for v in vals) / len(vals)) ** 0.5))
    spread = sum(v for _, v in imp)
    imp = [(c, v / spread if spread else 0.0) for c, v in imp]
    imp_df = df.sparkSession.createDataFrame(imp, "feature string, importance double")
    meta = cdf.withColumn("k", F.lit(k)).withColumn("silhouette", F.lit(float(sil)))
    return out, meta, imp_df


def additive_measure(name: str, profile_row: dict | None = None, agg_hint: str | None = None) -> bool:
    """False for rate/ratio/percent/average-like names, a mean hint, or a 0–1 range."""
    low = name.lower()
    if any(k in low for k in ("rate", "ratio", "percent", "pct", "margin", "avg", "mean")):
        return False
    if agg_hint and agg_hint.lower() in ("mean", "avg", "average"):
        return False
    if profile_row and profile_row.get("min") is not None and profile_row.get("max") is not None:
        if profile_row["min"] >= 0 and profile_row["max"] <= 1:
            return False
    return True


def choose_strategy(profile_rows: list[dict], roles: dict[str, str]) -> dict:
    """Id + date + measure → RFM; dimension + additive measure → ABC; else K-Means."""
    by = {r["column"]: r for r in profile_rows}
    ids = [c for c, r in roles.items() if r == "id"]
    dates = [c for c, r in roles.items() if r in ("date", "time")]
    measures = [c for c, r in roles.items() if r == "measure"]
    dims = [c for c, r in roles.items() if r in ("dimension", "category")]
    if ids and dates and measures:
        return {"method": "rfm", "entity_column": ids[0], "date_column": dates[0], "monetary_column": measures[0]}
    additive = [m for m in measures if additive_measure(m, by.get(m))]
    if dims and additive:
        return {"method": "abc", "entity_column": dims[0], "value_column": additive[0]}
    nums = [c for c, r in by.items() if r.get("data_type") == "numeric"]
    return {"method": "kmeans", "numeric_columns": nums}


def _mean(c: str, scale: int | None) -> Column:
    if scale is None:
        return F.avg(c)
    return F.sum(F.col(c).cast(f"decimal(38,{scale})")).cast("double") / F.count(c)


def summarize(seg: DataFrame, method: str, metrics: list[str], top_metric: str, top_k: int = 5,
              scale: int | None = None) -> DataFrame:
    """Per segment size, %, mean metrics (sum + share for ABC) and top entities.

    Top entities use ``row_number() <= top_k`` per segment, which Spark limits
    per partition before the shuffle, so a huge segment is not collected.
    """
    total = F.sum("size").over(Window.partitionBy(F.lit(1)))  # one row per segment
    money = {"monetary", "total_value"}
    if method == "abc":
        tv = F.sum(F.col("total_value").cast(f"decimal(38,{scale})")).cast("double") if scale else F.sum("total_value")
        aggs = [F.count(F.lit(1)).alias("size"), tv.alias("total_value")]
    else:
        aggs = [F.count(F.lit(1)).alias("size")] + [
            (_mean(m, scale) if m in money else F.avg(m)).alias(f"avg_{m}") for m in metrics]
    g = seg.groupBy("segment").agg(*aggs)
    g = g.withColumn("percentage", F.round(F.col("size") / total * 100, 1))
    if method == "abc":
        w1 = Window.partitionBy(F.lit(1))  # one row per segment
        if scale:
            allv = F.sum(F.col("total_value").cast(f"decimal(38,{scale})")).over(w1).cast("double")
        else:
            allv = F.sum("total_value").over(w1)
        g = g.withColumn("value_share", F.col("total_value") / allv * 100)
    w = Window.partitionBy("segment").orderBy(F.col(top_metric).desc(), F.col("entity").asc())
    top = seg.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top_k).groupBy("segment").agg(
        F.sort_array(F.collect_list(F.struct("rn", F.col("entity").cast("string").alias("e")))).alias("t"))
    top = top.select("segment", F.transform("t", lambda s: s["e"]).alias("top_entities"))
    return g.join(top, "segment", "left")


def evidence(summary: DataFrame, key: str, silhouette: float | None = None, method: str = "rfm",
             small_n: int = 30, margin_pct: float = 10.0) -> DataFrame:
    """Small sample, single-entity segments, marginal separation.

    Segments are few (≤ 64), so pairs are compared after sorting by the key:
    for same-signed means the closest relative pair is adjacent.
    """
    s = summary.select("segment", "size", F.col(key).cast("double").alias("k"))
    w = Window.partitionBy(F.lit(1)).orderBy("k", "segment")
    s = s.withColumn("prev", F.lag("k").over(w))
    close = F.abs(F.col("k") - F.col("prev")) / F.greatest(F.greatest(F.abs("k"), F.abs("prev")), F.lit(1e-300)) * 100 <= margin_pct
    out = s.agg(
        F.sum("size").alias("entity_count"), F.count(F.lit(1)).alias("segment_count"),
        F.sort_array(F.collect_list(F.when(F.col("size") == 1, F.col("segment")))).alias("single_entity_segments"),
        F.max(F.when(close, 1).otherwise(0)).alias("close"),
    )
    weak_sil = bool(method == "kmeans" and silhouette is not None and silhouette < 0.25)
    return out.select(
        "entity_count", "segment_count", (F.col("entity_count") < small_n).alias("small_sample"),
        "single_entity_segments", ((F.col("close") == 1) | F.lit(weak_sil)).alias("marginal_separation"))


def scatter_sample(df: DataFrame, key: str, n: int = 500, seed: int = 42) -> DataFrame:
    """Repeatable ``n``-row sample by hash order (a distributed top-k).

    The order is MD5 of ``key || seed`` — any engine with MD5 draws the same sample.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    return df.orderBy(h, F.col(key)).limit(n)


def entity_pareto(abc_df: DataFrame, n: int = 40) -> DataFrame:
    """First ``n`` entities of the ABC order with their cumulative share."""
    return abc_df.orderBy("position").limit(n).select("entity", "total_value", "cumulative_pct", "segment")
