"""Dashboard chart aggregations.

Every chart is one ``groupBy`` on a bucketed x (partial aggregation before the
shuffle); orders and running sums over all labels go over ranges, not through one
window.  The charts of a dashboard share one pass (``build_charts``).  Driver-side
decisions (is x a date? which grain?) come from one tiny statistics row.

Semantics follow the reference's pandas code, with these documented choices:
null x labels are dropped (D1/D3), an all-null group sums to 0 (D2), ties in
value order are broken by label ascending (D7), and the date filter's upper bound
is ``< to + 1 day`` (D17).
"""

from __future__ import annotations

import calendar
import datetime as _dt
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from briskbi.functions.labels import DASHBOARD_GRAIN_LIMITS, bucket_label, grain_for_span
from briskbi.functions.parse import to_number, to_timestamp_mixed
from briskbi.operators.ranking import exact_percentiles, global_order
from briskbi.session import cut_lineage

MAX_PIE_SLICES = 12  # the pie's feature: eleven slices and "Others"
PART_TO_WHOLE = ("pie", "donut", "treemap", "funnel")
CHARTS = ("bar", "line", "combo", "kpi_card", "radial", "histogram", "pareto")
BAR_ALIASES = ("area", "stacked_bar", "area_chart", "horizontal_bar")
AGG_ALIASES = {"sum": "sum", "avg": "mean", "mean": "mean", "average": "mean", "min": "min",
               "max": "max", "median": "median", "count": "count"}


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def measure(df: DataFrame, y: str) -> Column:
    """Numeric view of column ``y`` (typed columns cast, text parsed)."""
    return to_number(F.col(y), dtype_of(df, y))


def is_temporal(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def sum_expr(v: Column, scale: int | None) -> Column:
    """Sum; with ``scale`` the sum is accumulated exactly as a decimal."""
    if scale is None:
        return F.sum(v)
    return F.sum(v.cast(f"decimal(38,{scale})")).cast("double")


def value_agg(v: Column | None, agg: str, scale: int | None = None) -> Column:
    agg = AGG_ALIASES.get(agg, "sum")
    if agg == "count" or v is None:
        return F.count(F.lit(1))
    if agg == "mean":
        if scale is None:
            return F.avg(v)
        return sum_expr(v, scale) / F.count(v)
    if agg == "min":
        return F.min(v)
    if agg == "max":
        return F.max(v)
    if agg == "median":
        return F.median(v)
    return sum_expr(v, scale)


# ---------------------------------------------------------------------------
# Filters (B4, B5)
# ---------------------------------------------------------------------------

def filter_dates(df: DataFrame, col: str, start=None, end=None) -> DataFrame:
    """Keep rows whose ``col`` falls in the inclusive day range [start, end]."""
    ts = to_timestamp_mixed(F.col(col), dtype_of(df, col))
    cond = ts.isNotNull()
    if start is not None:
        cond = cond & (ts >= F.lit(str(start)).cast("timestamp_ntz"))
    if end is not None:
        cond = cond & (ts < F.lit(str(end)).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
    return df.where(cond)


def relative_range(preset: str, as_of: _dt.date) -> tuple[_dt.date | None, _dt.date | None]:
    """(start, end) of a relative preset with an explicit ``as_of`` day."""
    if preset in ("last7", "last_7_days"):
        return as_of - _dt.timedelta(days=7), as_of
    if preset in ("last30", "last_30_days"):
        return as_of - _dt.timedelta(days=30), as_of
    if preset in ("last90", "last_90_days"):
        return as_of - _dt.timedelta(days=90), as_of
    if preset in ("last12m", "last_12_months"):
        y, m = as_of.year, as_of.month - 12
        if m <= 0:
            y, m = y - 1, m + 12
        day = min(as_of.day, calendar.monthrange(y, m)[1])
        return _dt.date(y, m, day), as_of
    if preset in ("ytd", "year_to_date"):
        return _dt.date(as_of.year, 1, 1), as_of
    return None, None


def value_filter(df: DataFrame, question: str, min_len: int = 3) -> DataFrame:
    """Filter on the longest categorical value contained in the question.

    String columns are unpivoted to (column, value); values of any column that occur in
    the lower-cased question are candidates, found before anything is shuffled; the longest
    wins (column name breaks ties).
    """
    text_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text_cols:
        return df
    q = question.lower()
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in text_cols])).alias("kv")
    ).select("kv.column", F.trim(F.col("kv.value")).alias("value")).where(F.col("value").isNotNull())
    cands = (
        long.where((F.length("value") >= min_len) & F.lit(q).contains(F.lower(F.col("value"))))
        .distinct()
        .orderBy(F.length("value").desc(), F.col("column"), F.col("value"))
        .limit(1)
        .collect()
    )
    if not cands:
        return df
    c, v = cands[0]["column"], cands[0]["value"]
    return df.where(F.lower(F.trim(F.col(c))) == v.lower())


# ---------------------------------------------------------------------------
# x bucketing
# ---------------------------------------------------------------------------

@dataclass
class XBucket:
    df: DataFrame          # input with a ``label`` column (nulls removed)
    is_date: bool
    grain: str | None = None
    stats: dict = field(default_factory=dict)


def bucket_x(df: DataFrame, x: str, grain: str | None = None, grain_limits=DASHBOARD_GRAIN_LIMITS,
             last_grain: str = "year", parse_share: float | None = None) -> XBucket:
    """Attach ``label``: a time bucket when x is a date, else x as text.

    A string x counts as a date when more than ``parse_share`` of its rows parse
    (0.5 with an explicit grain, 0.7 otherwise — the reference's thresholds).
    The automatic grain is chosen from the span of the parsed values.
    """
    dt = dtype_of(df, x)
    ts = to_timestamp_mixed(F.col(x), dt)
    needs_stats = (not is_temporal(dt) and isinstance(dt, T.StringType)) or grain is None
    stats = {}
    if needs_stats and (is_temporal(dt) or isinstance(dt, T.StringType)):
        row = df.agg(
            F.count(F.lit(1)).alias("n"),
            F.count(ts).alias("n_ts"),
            F.min(ts).alias("lo"),
            F.max(ts).alias("hi"),
        ).collect()[0]
        stats = row.asDict()
    is_date = is_temporal(dt)
    if isinstance(dt, T.StringType) and stats.get("n"):
        share = stats["n_ts"] / stats["n"]
        is_date = share > (parse_share if parse_share is not None else (0.5 if grain else 0.7))
    if is_date:
        if grain is None:
            if stats.get("n_ts", 0) < 2 or stats.get("lo") is None:
                grain = "day"
            else:
                grain = grain_for_span((stats["hi"] - stats["lo"]).days, grain_limits, last_grain)
        out = df.where(ts.isNotNull()).withColumn("label", bucket_label(ts, grain))
        return XBucket(out, True, grain, stats)
    out = df.where(F.col(x).isNotNull()).withColumn("label", F.col(x).cast("string"))
    return XBucket(out, False, None, stats)


def _order_cols(sort: str, is_date: bool, cumulative: bool) -> list[Column]:
    if is_date or cumulative:
        return [F.col("label").asc()]
    if sort == "value_asc":
        return [F.col("value").asc(), F.col("label").asc()]
    if sort == "label_asc":
        return [F.col("label").asc()]
    if sort == "label_desc":
        return [F.col("label").desc()]
    return [F.col("value").desc(), F.col("label").asc()]


# ---------------------------------------------------------------------------
# Interactive chart builder (C10, C11, C12, C2 via kpi)
# ---------------------------------------------------------------------------

def aggregate(df: DataFrame, x: str, y: str | None = None, agg: str = "sum", breakdown: str | None = None,
              grain: str | None = None, top_n: int = 12, sort: str = "value_desc", cumulative: bool = False,
              date_field: str | None = None, date_from=None, date_to=None, chart_type: str = "bar",
              scale: int | None = None, grain_limits=DASHBOARD_GRAIN_LIMITS, last_grain: str = "year") -> DataFrame:
    """Single series → (label, value); with ``breakdown`` → (label, series, value).

    Dates (and cumulative charts) keep every bucket in label order; other x keep
    the ``top_n`` buckets in ``sort`` order, which is the chart's feature.
    """
    top_n = max(1, int(top_n or 12))
    chart_type = chart_type.lower().replace("-", "_")
    if chart_type == "horizontal_bar" and y is not None:
        x, y = corrected_bar_axes(df, x, y)
    if date_field and (date_from or date_to):
        df = filter_dates(df, date_field, date_from, date_to)
    use_count = AGG_ALIASES.get(agg, "sum") == "count" or y is None
    xb = bucket_x(df, x, grain, grain_limits, last_grain)
    work = xb.df
    v = None if use_count else measure(work, y)
    if breakdown and chart_type not in PART_TO_WHOLE:
        return _breakdown(work, xb.is_date, breakdown, v, agg, top_n, cumulative, scale)
    if v is not None and AGG_ALIASES.get(agg, "sum") == "median":
        # By selection: no group's values are gathered.  Labels without a number stay, with 0.
        middle = exact_percentiles(work.select("label", v.alias("_y")), ["label"], "_y", [0.5], ["value"])
        g = work.select("label").distinct().join(middle, "label", "left").select("label", F.coalesce("value", F.lit(0.0)).alias("value"))
    else:
        g = work.groupBy("label").agg(F.coalesce(value_agg(v, agg, scale), F.lit(0.0)).cast("double").alias("value"))
    if cumulative and not xb.is_date:
        # As many labels as the data has: a running sum over ranges, in fixed point.
        places = CUMULATIVE_PLACES if scale is None else scale
        g = global_order(g, [F.col("label").asc()], running_sum="value", scale=places, running_col="_cum").select("label", F.col("_cum").alias("value"))
    g = g.orderBy(*_order_cols(sort, xb.is_date, cumulative))
    if not (xb.is_date or cumulative):
        g = g.limit(top_n)
    if cumulative and xb.is_date:
        # One row per calendar bucket.
        w = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, 0)
        g = g.withColumn("value", _running(F.col("value"), w, scale))
    if chart_type in PART_TO_WHOLE:
        g = g.withColumnRenamed("label", "name")
    return g


#: Decimals of a running sum over text labels whose scale is not given.
CUMULATIVE_PLACES = 6


def _running(v: Column, w: Window, scale: int | None) -> Column:
    if scale is None:
        return F.sum(v).over(w)
    return F.sum(v.cast(f"decimal(38,{scale})")).over(w).cast("double")


def _breakdown(work: DataFrame, is_date: bool, breakdown: str, v: Column | None, agg: str, top_n: int,
               cumulative: bool, scale: int | None) -> DataFrame:
    """C11: long (label, series, value) table, zero-filled, top ``top_n`` series."""
    work = work.where(F.col(breakdown).isNotNull()).withColumn("series", F.col(breakdown).cast("string"))
    g = work.groupBy("label", "series").agg(F.coalesce(value_agg(v, agg, scale), F.lit(0.0)).cast("double").alias("value"))
    # Series totals → top_n keys (a chart's series, safe to broadcast).
    totals = g.groupBy("series").agg(sum_expr(F.col("value"), scale).alias("total"))
    keep = totals.orderBy(F.col("total").desc(), F.col("series").asc()).limit(top_n).select("series")
    g = g.join(F.broadcast(keep), "series", "left_semi")
    # x order: chronological, or by row total; every label stays.
    rows = g.groupBy("label").agg(sum_expr(F.col("value"), scale).alias("row_total"))
    if is_date or cumulative:
        labels = rows.orderBy(F.col("label").desc())
    else:
        labels = rows.orderBy(F.col("row_total").desc(), F.col("label").asc())
    # Zero fill: labels × ≤ top_n series; the kept keys are a
    # bounded list, so each label row is expanded in place (no join).
    keys = [r["series"] for r in keep.collect()]
    grid = labels.select("label", F.explode(F.array(*[F.lit(k) for k in keys] or [F.lit(None).cast("string")])).alias("series"))
    out = grid.join(g, ["label", "series"], "left").select(
        "label", "series", F.coalesce(F.col("value"), F.lit(0.0)).alias("value")
    )
    if cumulative:
        w = Window.partitionBy("series").orderBy("label").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("value", _running(F.col("value"), w, scale))
    return out


def kpi(df: DataFrame, y: str | None, agg: str = "sum", scale: int | None = None) -> DataFrame:
    """One-row (value) KPI; count counts non-null; empty input → 0."""
    if y is None:
        return df.sparkSession.range(1).select(F.lit(0.0).alias("value"))
    a = AGG_ALIASES.get(agg, "sum")
    if a == "count":
        return df.agg(F.count(F.col(y)).cast("double").alias("value"))
    v = measure(df, y)
    if a == "median":
        med = exact_percentiles(df.select(v.alias("_y")), [], "_y", [0.5], ["value"])  # one row
        return med.select(F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    return df.agg(F.coalesce(value_agg(v, a, scale), F.lit(0.0)).cast("double").alias("value"))


# ---------------------------------------------------------------------------
# Fixed chart kinds of the chart cache
# ---------------------------------------------------------------------------

def time_text(c: Column) -> Column:
    """Timestamp as text the way pandas prints it: date only at midnight."""
    midnight = F.date_format(c, "HH:mm:ss.SSSSSS") == "00:00:00.000000"
    return F.when(midnight, F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))


def _label(df: DataFrame, x: str) -> Column:
    return time_text(F.col(x)) if is_temporal(dtype_of(df, x)) else F.col(x).cast("string")


def _total(v: Column | None, scale: int | None) -> Column:
    return F.coalesce(value_agg(v, "sum", scale), F.lit(0.0)).cast("double")


def _grouped(df: DataFrame, x: str, y: str | None, scale: int | None) -> DataFrame:
    """(label, value): group by x as the cache does: sum(y) or row count; value fill 0."""
    work = df.where(F.col(x).isNotNull()).withColumn("label", _label(df, x))
    return work.groupBy("label").agg(_total(None if y is None else measure(work, y), scale).alias("value"))


DATE_LABEL_SHARE = 0.7


def _chronological(g: DataFrame, dt: T.DataType) -> list[Column] | None:
    """Order of text labels that are dates (more than ``DATE_LABEL_SHARE`` of them parse); others come last."""
    if not isinstance(dt, T.StringType):
        return None
    t = to_timestamp_mixed(F.col("label"))
    row = g.agg(F.count(F.lit(1)).alias("n"), F.count(t).alias("dates")).first()
    if not row["n"] or row["dates"] / row["n"] <= DATE_LABEL_SHARE:
        return None
    return [t.asc_nulls_last(), F.col("label").asc()]


def bar(df: DataFrame, x: str, y: str | None = None, scale: int | None = None, limit: int | None = None) -> DataFrame:
    """bar/line/area: sum or count by x; dates chronological else value desc; all groups, or the first ``limit``."""
    return _bar(_grouped(df, x, y, scale), dtype_of(df, x), limit)


def _bar(g: DataFrame, dt: T.DataType, limit: int | None = None) -> DataFrame:
    out = g.orderBy(*(_chronological(g, dt) or _order_cols("value_desc", is_temporal(dt), False)))
    return out if limit is None else out.limit(limit)


def pie(df: DataFrame, x: str, y: str | None = None, scale: int | None = None) -> DataFrame:
    """C4: positive slices by value; above 12 slices → top 11 + ``Others``."""
    return _pie(_grouped(df, x, y, scale), scale)


def _pie(g: DataFrame, scale: int | None) -> DataFrame:
    g = g.where(F.col("value") > 0).withColumnRenamed("label", "name")
    order = [F.col("value").desc(), F.col("name").asc()]
    head = g.orderBy(*order).limit(MAX_PIE_SLICES)
    w = Window.orderBy(*order)
    head = head.withColumn("rn", F.row_number().over(w))  # ≤ 12 rows
    top = head.where(F.col("rn") < MAX_PIE_SLICES).select("name")
    rest = g.join(F.broadcast(top), "name", "left_anti").agg(
        sum_expr(F.col("value"), scale).alias("value"), F.count(F.lit(1)).alias("n_rest")
    )
    others = rest.select(F.lit("Others").alias("name"), "value", F.lit(MAX_PIE_SLICES).alias("rn"),
                         F.lit(True).alias("is_others"), "n_rest")
    both = head.select("name", "value", "rn", F.lit(False).alias("is_others"), F.lit(None).cast("long").alias("n_rest")).unionByName(others)
    wall = Window.partitionBy(F.lit(1))  # ≤ 13 rows
    both = both.withColumn("overflow", F.max("n_rest").over(wall) > 1)
    keep = F.when(F.col("overflow"), (F.col("rn") < MAX_PIE_SLICES) | F.col("is_others")).otherwise(~F.col("is_others"))
    return both.where(keep).select("name", "value")


def combo(df: DataFrame, x: str, y: str, y2: str | None = None, scale: int | None = None, limit: int | None = None) -> DataFrame:
    """bars = sum(y); line = sum(y2) by the same label, else growth % vs previous; all labels, or the first ``limit``.

    The previous label comes from a range-partitioned order, not from one window over all labels.
    """
    work = df.where(F.col(x).isNotNull()).withColumn("label", _label(df, x))
    aggs = [_total(measure(work, c), scale).alias(name) for c, name in ((y, "value"), (y2, "line2")) if c]
    return _combo(work.groupBy("label").agg(*aggs), dtype_of(df, x), y2, limit)  # both measures in one pass, no join


def _combo(g: DataFrame, dt: T.DataType, y2: str | None, limit: int | None = None) -> DataFrame:
    order = _chronological(g, dt) or _order_cols("value_desc", is_temporal(dt), False)
    if limit is not None:
        g = g.orderBy(*order).limit(limit)
    zero = y2 is None or g.agg(F.coalesce(F.sum(F.abs("line2")), F.lit(0.0)).alias("s")).first()["s"] == 0
    if zero:
        ranked = global_order(g, order, rank_col="_r")
        before = ranked.select((F.col("_r") + 1).alias("_r"), F.col("value").alias("_prev"))
        g = ranked.join(before, "_r", "left")
    else:
        g = g.withColumn("_prev", F.lit(None).cast("double"))
    prev = F.col("_prev")
    growth = F.when(prev.isNull() | (prev == 0), F.lit(0.0)).otherwise(F.round((F.col("value") - prev) / prev * 100.0, 2))
    if y2:
        all_zero = F.lit(zero)
        line = F.when(all_zero, growth).otherwise(F.col("line2"))
        name = F.when(all_zero, F.lit("Growth %")).otherwise(F.lit(y2))
        is_pct = all_zero
    else:
        line, name, is_pct = growth, F.lit("Growth %"), F.lit(True)
    return g.select("label", "value", line.alias("line"), name.alias("line_name"), is_pct.alias("line_is_pct"))


def radial(df: DataFrame, y: str, scale: int | None = None) -> DataFrame:
    """Gauge of the mean; 0–1 → percent of 100, 0–100 → of 100, else of max."""
    v = measure(df, y)
    return _radial(df.agg(F.min(v).alias("mn"), F.max(v).alias("mx"), value_agg(v, "mean", scale).alias("mean")))


def _radial(s: DataFrame) -> DataFrame:
    unit01 = (F.col("mn") >= 0) & (F.col("mx") <= 1)
    unit100 = (F.col("mn") >= 0) & (F.col("mx") <= 100)
    return s.select(
        F.when(F.col("mean").isNull(), F.lit(0.0))
        .when(unit01, F.round(F.col("mean") * 100.0, 2))
        .otherwise(F.round(F.col("mean"), 2)).alias("value"),
        F.when(F.col("mean").isNull(), F.lit(0.0)).when(unit01 | unit100, F.lit(100.0))
        .otherwise(F.round(F.col("mx"), 2)).alias("max"),
        F.when(F.col("mean").isNull(), F.lit("")).when(unit01 | unit100, F.lit("%")).otherwise(F.lit("")).alias("unit"),
    )


def _bin_stats(v: Column, df: DataFrame) -> tuple[float | None, float | None, int]:
    """min, max and distinct count; exact distinct only when the sketch is small."""
    row = df.agg(F.min(v).alias("mn"), F.max(v).alias("mx"), F.approx_count_distinct(v).alias("nd")).collect()[0]
    nd = int(row["nd"] or 0)
    if nd < 40:  # only a few distinct values: the exact count is a tiny aggregation
        nd = int(df.agg(F.count_distinct(v).alias("nd")).collect()[0]["nd"])
    return row["mn"], row["mx"], nd


def histogram_edges(mn: float, mx: float, n: int, closed: str = "left") -> list[float]:
    """Bin edges exactly as numpy ``linspace`` (``i·step + start``) builds them.

    ``closed="left"``: ``np.histogram`` (constant column → [v−0.5, v+0.5]).
    ``closed="right"``: ``pd.cut`` (lowest edge lowered by 0.1 % of the range;
    a constant column widens by 0.1 % of |v|, or 0.001 at zero).
    """
    if closed == "left":
        lo, hi = (mn - 0.5, mx + 0.5) if mn == mx else (float(mn), float(mx))
    elif mn == mx:
        adj = abs(mn) * 0.001 if mn != 0 else 0.001
        lo, hi = mn - adj, mx + adj
    else:
        lo, hi = float(mn), float(mx)
    step = (hi - lo) / n
    edges = [i * step + lo for i in range(n)] + [hi]
    if closed == "right" and mn != mx:
        edges[0] = lo - (hi - lo) * 0.001
    return edges


def histogram(df: DataFrame, x: str, closed: str = "left") -> DataFrame:
    """C7 (numpy, last bin closed) and C8 (``pd.cut``, right-closed) histograms.

    Output (bin, lo, hi, label ``lo–hi`` with two significant digits, value) for bins = min(20, max(5, distinct)); empty bins
    count 0 (D19).  The bin of a value is the number of inner edges it passes,
    compared against the literal edges, so values on an edge land where numpy /
    pandas put them.
    """
    v = measure(df, x)
    edges = _edges(df, v, closed)
    counts = df.where(v.isNotNull()).groupBy(_bin(v, edges, closed).alias("bin")).agg(F.count(F.lit(1)).alias("value"))
    return _histogram(counts, edges)


def _edges(df: DataFrame, v: Column, closed: str = "left") -> list[float]:
    """Edges of the bins of ``v``; none without values."""
    mn, mx, nd = _bin_stats(v, df)
    return [] if mn is None else histogram_edges(float(mn), float(mx), min(20, max(5, nd)), closed)


def _bin(v: Column, edges: list[float], closed: str = "left") -> Column:
    """Number of inner edges that a value passes; null for null."""
    passed = [F.when(v >= F.lit(e) if closed == "left" else v > F.lit(e), 1).otherwise(0) for e in edges[1:-1]]
    return F.when(v.isNotNull(), sum(passed[1:], passed[0]) if passed else F.lit(0)).cast("int")


def _histogram(counts: DataFrame, edges: list[float]) -> DataFrame:
    """The bins of ``edges`` with their (bin, value) counts, empty ones too."""
    spark, n = counts.sparkSession, len(edges) - 1
    if n < 1:
        return spark.createDataFrame([], "bin int, lo double, hi double, label string, value long")
    rows = [(i, edges[i], edges[i + 1], f"{edges[i]:.2g}–{edges[i + 1]:.2g}") for i in range(n)]
    bins = spark.createDataFrame(rows, "bin int, lo double, hi double, label string")  # ≤ 20 rows
    return bins.join(F.broadcast(counts), "bin", "left").select(
        "bin", "lo", "hi", "label", F.coalesce(F.col("value"), F.lit(0)).alias("value")
    )


def pareto(df: DataFrame, x: str, y: str, scale: int | None = None, limit: int | None = None) -> DataFrame:
    """Positive sums by descending value, cumulative % of the whole total (round 2).

    The first ``limit`` labels, or all; shares are always of everything.  The running
    sum is over a range-partitioned order.
    """
    return _pareto(_grouped(df, x, y, scale), scale, limit)


def _pareto(g: DataFrame, scale: int | None, limit: int | None = None) -> DataFrame:
    g = g.where(F.col("value") > 0)
    order = [F.col("value").desc(), F.col("label").asc()]
    total = g.agg(sum_expr(F.col("value"), scale).alias("t")).collect()[0]["t"]
    if scale is None:
        ordered = global_order(g.withColumn("_share", F.try_divide(F.col("value"), F.lit(total))), order, running_sum="_share", scale=12, rank_col="_r", running_col="_cum")
        share = F.col("_cum") * 100.0
    else:
        ordered = global_order(g, order, running_sum="value", scale=scale, rank_col="_r", running_col="_cum")
        share = F.try_divide(F.col("_cum"), F.lit(total)) * 100.0
    if limit is not None:
        ordered = ordered.where(F.col("_r") <= limit)
    return ordered.select("label", "value", F.round(share, 2).alias("cumulative"))


# ---------------------------------------------------------------------------
# Column tests
# ---------------------------------------------------------------------------

def resolve_column(columns: list[str], hint: str | None) -> str | None:
    """Column named by a hint: exact (case-insensitive) → longest containment →
    largest token overlap; ``"… by X"`` phrases use X."""
    if not hint:
        return None
    h = hint.strip().lower()
    m = re.search(r"\bby\s+([a-z0-9_ ]+)$", h)
    if m:
        h = m.group(1).strip()
    norm = {c: c.lower() for c in columns}
    for c, n in norm.items():
        if n == h or n == h.replace(" ", "_"):
            return c
    hits = [c for c, n in norm.items() if n in h or h.replace(" ", "_") in n]
    if hits:
        return max(hits, key=lambda c: (len(c), c))
    words = set(re.split(r"[\s_]+", h)) - {""}
    best = max(columns, key=lambda c: (len(words & set(norm[c].split("_"))), -len(c)), default=None)
    if best is not None and words & set(norm[best].split("_")):
        return best
    return None


def is_numeric_column(df: DataFrame, c: str, share: float = 0.9) -> bool:
    """Numeric type, or at least ``share`` of non-null values parse."""
    dt = dtype_of(df, c)
    if isinstance(dt, T.NumericType):
        return True
    row = df.agg(F.count(F.col(c)).alias("nn"), F.count(to_number(F.col(c), dt)).alias("ok")).collect()[0]
    return bool(row["nn"]) and row["ok"] / row["nn"] >= share


def corrected_bar_axes(df: DataFrame, x: str, y: str) -> tuple[str, str]:
    """Swap (x, y) when x is numeric and y is not."""
    if x in df.columns and y in df.columns and is_numeric_column(df, x) and not is_numeric_column(df, y):
        return y, x
    return x, y


def build_charts(df: DataFrame, specs: list[dict], scale: int | None = None) -> dict[str, DataFrame]:
    """Every chart of a dashboard from one pass over ``df``.

    One GROUPING SETS aggregate sums all measures for all x axes, the bins of histograms and the
    whole table; its cells (one per axis and label) are checkpointed, and each chart reads its own
    axis' cells.  Histograms need the range of their column first, one more pass each.
    Keys are ``type|x|y|y2`` like the reference cache; a chart given twice is built once.
    """
    wanted = {}
    for s in specs:
        kind = s.get("chart_type", "").lower().replace("-", "_")
        x, y, y2 = s.get("x_axis"), s.get("y_axis"), s.get("y_axis_secondary")
        key = f"{kind}|{x}|{y}|{y2}"
        if kind == "horizontal_bar" and y:
            x, y = corrected_bar_axes(df, x, y)
        if kind in ("kpi_card", "radial"):
            x, y = None, y or x
        if kind in CHARTS or kind in BAR_ALIASES or kind in PART_TO_WHOLE:
            wanted[key] = (kind, x, y, y2)
    if not wanted:
        return {}
    edges = {x: _edges(df, measure(df, x)) for kind, x, _, _ in wanted.values() if kind == "histogram"}
    axes = {x: _label(df, x) for kind, x, _, _ in wanted.values() if x and kind != "histogram"}
    bins = {x: _bin(measure(df, x), e).cast("string") for x, e in edges.items()}
    labels = [*axes.values(), *bins.values()]
    place = {**{x: i for i, x in enumerate(axes)}, **{("bins", x): len(axes) + i for i, x in enumerate(bins)}}
    ys = list(dict.fromkeys(c for _, _, y, y2 in wanted.values() for c in (y, y2) if c))
    at = {c: i for i, c in enumerate(ys)}
    names = [f"_axis{i}" for i in range(len(labels))]
    flat = df.select(*[c.alias(n) for c, n in zip(labels, names, strict=True)], *[measure(df, c).alias(f"_y{i}") for c, i in at.items()])
    sums = [a for i in at.values() for v in [F.col(f"_y{i}")]
            for a in (_total(v, scale).alias(f"sum{i}"), F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}"), value_agg(v, "mean").alias(f"mean{i}"))]
    which = F.coalesce(*[F.when(F.grouping(n) == 0, F.lit(i)) for i, n in enumerate(names)], F.lit(-1)) if names else F.lit(-1)
    grouped = flat.groupingSets([[F.col(n)] for n in names] + [[]], *names) if names else flat.groupBy()
    cells = cut_lineage(grouped.agg(which.alias("_axis"), F.count(F.lit(1)).cast("double").alias("_rows"), *sums).withColumn("label", F.coalesce(*names, F.lit(None).cast("string"))).drop(*names))
    whole = cells.where("_axis = -1")

    def slices(axis, **columns: Column) -> DataFrame:
        return cells.where((F.col("_axis") == place[axis]) & F.col("label").isNotNull()).select("label", *[c.alias(n) for n, c in columns.items()])

    def value(y: str | None) -> Column:
        return F.col(f"sum{at[y]}") if y else F.col("_rows")

    out: dict[str, DataFrame] = {}
    for key, (kind, x, y, y2) in wanted.items():
        if kind == "kpi_card":
            out[key] = whole.agg(F.coalesce(F.max(value(y)) if y else F.lit(0.0), F.lit(0.0)).alias("value"))
        elif kind == "radial":
            out[key] = _radial(whole.agg(*[F.max(f"{stat}{at[y]}").alias(name) for stat, name in (("min", "mn"), ("max", "mx"), ("mean", "mean"))]))
        elif kind == "histogram":
            counts = slices(("bins", x), value=F.col("_rows").cast("long"))
            out[key] = _histogram(counts.select(F.col("label").cast("int").alias("bin"), "value"), edges[x])
        elif kind == "combo":
            out[key] = _combo(slices(x, value=value(y), **({"line2": value(y2)} if y2 else {})), dtype_of(df, x), y2)
        elif kind == "pareto":
            out[key] = _pareto(slices(x, value=value(y)), scale)
        elif kind in PART_TO_WHOLE:
            out[key] = _pie(slices(x, value=value(y)), scale)
        else:
            out[key] = _bar(slices(x, value=value(y)), dtype_of(df, x))
    return out
