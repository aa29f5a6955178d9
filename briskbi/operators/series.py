"""Time-series preparation for many series at once.

A *series frame* is ``(keys…, ts, y, n_obs, features…)`` with one row per time
bucket.  ``keys=[]`` collapses everything into one series (the reference's
behaviour).  Per-series decisions (frequency, coarsening) are column
expressions computed from a per-series statistics table, so any number of
series is handled by the same plan; windows partitioned by the series keys run
only after the point cap (≤ ``max_points`` buckets per series, H9).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from briskbi.functions.parse import to_number, to_timestamp_mixed
from briskbi.operators.ranking import exact_percentiles, global_order

# Fixed values of the reference's series preparation.
FREQ_SEASON = {"D": 7, "W": 52, "MS": 12, "QS": 4}
COARSER = {"D": "W", "W": "MS", "MS": "QS"}
MAX_DAILY_SPAN_BEFORE_WEEKLY = 1500
MAX_POINTS = 1200
IQR_FACTOR = 3.0
LOG_CV_THRESHOLD = 0.5
LOG_MIN_VALUE = 1e-9
READY_TIME_SHARE = 0.8
READY_TARGET_SHARE = 0.6
MIN_USABLE_ROWS = 3


def _keys(keys: Sequence[str] | None) -> list[str]:
    return list(keys or [])


def _part(keys: list[str]) -> Window:
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))


# ---------------------------------------------------------------------------
# T1 readiness
# ---------------------------------------------------------------------------

def check(df: DataFrame, ts: str, y: str, keys: Sequence[str] | None = None) -> DataFrame:
    """Per series time parse share ≥ 0.8, target numeric share ≥ 0.6, ≥ 3 usable rows."""
    keys = _keys(keys)
    t = to_timestamp_mixed(F.col(ts), df.schema[ts].dataType)
    v = to_number(F.col(y), df.schema[y].dataType)
    g = (df.dropna(subset=keys) if keys else df).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.try_divide(F.count(t), F.count(F.lit(1))), F.lit(0.0)).alias("time_share"),
        (F.count(v) / F.greatest(F.count(F.col(y)), F.lit(1))).alias("target_share"),
        F.count(F.when(t.isNotNull() & v.isNotNull(), 1)).alias("usable_rows"),
    )
    reason = (F.when(F.col("time_share") < READY_TIME_SHARE, F.lit("time_column_not_parseable"))
              .when(F.col("target_share") < READY_TARGET_SHARE, F.lit("target_not_numeric"))
              .when(F.col("usable_rows") < MIN_USABLE_ROWS, F.lit("not_enough_rows")))
    return g.withColumn("reason", reason).withColumn("ready", F.col("reason").isNull())


# ---------------------------------------------------------------------------
# T2 frequency
# ---------------------------------------------------------------------------

def freq_from_median_gap(days: Column, n_dates: Column) -> Column:
    return (F.when(n_dates < 3, F.lit("D")).when(days.isNull(), F.lit("D"))
            .when(days <= 1.5, F.lit("D")).when(days <= 8, F.lit("W"))
            .when(days <= 31, F.lit("MS")).otherwise(F.lit("QS")))


def detect_freq(df: DataFrame, ts: str, keys: Sequence[str] | None = None) -> DataFrame:
    """Frequency per series from the median gap between distinct timestamps.

    Gaps inside a day come from a window over (series, day); the gap across days
    from each day's first and last timestamp, one row per series and day.  So no
    window holds more than a day of a series, or its days.  Calendar inference
    is replaced by the median-gap rule.  Rows with a null key or time are left out.
    """
    keys = _keys(keys)
    t = to_timestamp_mixed(F.col(ts), df.schema[ts].dataType)
    dates = df.select(*keys, t.alias("t")).dropna().distinct().withColumn("_day", F.to_date("t"))
    micros = lambda a, b: F.timestamp_diff("MICROSECOND", a, b) / 86_400_000_000.0
    inner = dates.withColumn("gap", micros(F.lag("t").over(Window.partitionBy(*keys, "_day").orderBy("t")), F.col("t")))
    days = dates.groupBy(*keys, "_day").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n"))
    across = days.withColumn("gap", micros(F.lag("hi").over(_part(keys).orderBy("_day")), F.col("lo")))
    gaps = inner.select(*keys, "gap").unionByName(across.select(*keys, "gap")).where(F.col("gap").isNotNull())
    med = gaps.groupBy(*keys).agg(F.percentile("gap", 0.5).alias("median_gap_days"))
    counts = days.groupBy(*keys).agg(F.sum("n").alias("n_dates"))
    if keys:
        out = counts.join(med, keys, "left")
    else:
        out = counts.select(F.coalesce("n_dates", F.lit(0)).alias("n_dates"), F.lit(None).cast("double").alias("median_gap_days")).unionByName(
            med.select(F.lit(None).cast("long").alias("n_dates"), "median_gap_days")).agg(
            F.max("n_dates").alias("n_dates"), F.max("median_gap_days").alias("median_gap_days"))
    return out.withColumn("freq", freq_from_median_gap(F.col("median_gap_days"), F.col("n_dates")))


# ---------------------------------------------------------------------------
# T3–T5 buckets, resample, gaps, coarsening
# ---------------------------------------------------------------------------

def bucket(t: Column, freq: str | Column) -> Column:
    """Bucket timestamp for a frequency (D floor, W Sunday end, MS/QS period start).

    ``W`` follows pandas ``W-SUN``: right-closed weeks labelled by their Sunday
    midnight, so a Sunday at 10:00 belongs to the following Sunday (D13).
    """
    day = F.to_date(t)
    at_midnight = F.date_trunc("day", t) == t
    start = F.when(at_midnight, day).otherwise(F.date_add(day, 1))
    sunday = F.date_add(start, (F.lit(6) - F.weekday(start)) % 7)
    exprs = {
        "D": F.date_trunc("day", t).cast("timestamp_ntz"),
        "W": sunday.cast("timestamp_ntz"),
        "MS": F.date_trunc("month", t).cast("timestamp_ntz"),
        "QS": F.date_trunc("quarter", t).cast("timestamp_ntz"),
    }
    if isinstance(freq, str):
        return exprs[freq].cast("timestamp_ntz")
    out = exprs["QS"]
    for f in ("MS", "W", "D"):
        out = F.when(freq == f, exprs[f]).otherwise(out)
    return out.cast("timestamp_ntz")


def n_buckets(lo: Column, hi: Column, freq: str) -> Column:
    """Number of buckets of ``freq`` between the buckets of lo and hi (inclusive)."""
    a, b = bucket(lo, freq), bucket(hi, freq)
    if freq == "D":
        return F.datediff(b, a) + 1
    if freq == "W":
        return (F.datediff(b, a) / 7).cast("long") + 1
    months = F.round(F.months_between(b, a)).cast("long")
    return months + 1 if freq == "MS" else (months / 3).cast("long") + 1


def bucket_grid(b0: Column, b1: Column, freq: Column) -> Column:
    """Every bucket timestamp from b0 to b1 at the row's frequency (an array)."""
    seq = lambda step: F.sequence(b0, b1, F.expr(step))
    return (F.when(freq == "D", seq("INTERVAL 1 DAY")).when(freq == "W", seq("INTERVAL 7 DAYS"))
            .when(freq == "MS", seq("INTERVAL 1 MONTH")).otherwise(seq("INTERVAL 3 MONTHS")))


def choose_freq(stats: DataFrame, detected: Column, forced: str | None, max_points: int = MAX_POINTS) -> DataFrame:
    """T5: per series frequency after the daily→weekly rule and the point cap.

    A forced frequency is kept; otherwise a daily series spanning more than
    1500 days becomes weekly, then D→W→MS→QS until it has ≤ ``max_points``
    buckets.
    """
    if forced:
        return stats.withColumn("freq", F.lit(forced))
    span = F.datediff(F.to_date("t_max"), F.to_date("t_min"))
    f0 = F.when((detected == "D") & (span > MAX_DAILY_SPAN_BEFORE_WEEKLY), F.lit("W")).otherwise(detected)
    stats = stats.withColumn("freq0", f0)
    nb = {f: n_buckets(F.col("t_min"), F.col("t_max"), f) for f in ("D", "W", "MS", "QS")}
    order = ["D", "W", "MS", "QS"]
    chosen = F.lit("QS")
    for i in reversed(range(len(order))):
        f = order[i]
        # from freq0 == f: first of f, coarser… with ≤ max_points buckets
        pick = F.lit("QS")
        for g in reversed(order[i:]):
            pick = F.when(nb[g] <= max_points, F.lit(g)).otherwise(pick)
        chosen = F.when(F.col("freq0") == f, pick).otherwise(chosen)
    return stats.withColumn("freq", chosen).drop("freq0")


def resample(df: DataFrame, ts: str, y: str, keys: Sequence[str] | None = None, freq: str | None = None,
             features: Sequence[str] = (), policy: str = "drop", max_points: int = MAX_POINTS,
             scale: int | None = None, keep_newest: int | None = None) -> DataFrame:
    """Bucket, aggregate (target sum, numeric features mean, text mode,
    observation count), fill or drop empty buckets; ``max_points`` only chooses the
    frequency, ``keep_newest`` (off by default) keeps that many buckets.  Rows with a null
    series key are no series and are dropped, here and in ``check``.  Output ``(keys…, freq, ts, y, n_obs, features…)``.
    """
    if policy not in ("drop", "zero"):
        raise ValueError(f"policy must be 'drop' or 'zero', not {policy!r}")
    keys = _keys(keys)
    t = to_timestamp_mixed(F.col(ts), df.schema[ts].dataType)
    v = to_number(F.col(y), df.schema[y].dataType)
    base = df.select(*keys, t.alias("t"), v.alias("v"), *features).where(F.col("t").isNotNull() & F.col("v").isNotNull())
    base = base.dropna(subset=keys) if keys else base
    raw = base
    by_day = not features  # sums and counts of a day (and of its midnight, which weeks treat apart) are all a period needs
    if by_day:
        midnight = F.date_trunc("day", F.col("t")) == F.col("t")
        total = F.sum(F.col("v").cast(f"decimal(38,{scale})")) if scale is not None else F.sum("v")
        base = base.groupBy(*keys, F.to_date("t").alias("_day"), midnight.alias("_midnight")).agg(
            F.min("t").alias("t"), F.max("t").alias("_last"), total.alias("v"), F.count(F.lit(1)).alias("_n"))
    else:
        base = base.withColumns({"_last": F.col("t"), "_n": F.lit(1)})
    stats = base.groupBy(*keys).agg(F.min("t").alias("t_min"), F.max("_last").alias("t_max"))
    if freq is None:
        fr = detect_freq(raw.select(*keys, "t"), "t", keys)
        stats = stats.join(fr.select(*keys, "freq"), keys) if keys else stats.withColumn(
            "freq", F.lit(fr.collect()[0]["freq"]))
        stats = choose_freq(stats.withColumnRenamed("freq", "freq_detected"), F.col("freq_detected"), None, max_points)
        stats = stats.drop("freq_detected")
    else:
        stats = choose_freq(stats, F.lit(freq), freq, max_points)
    if keys:
        joined = base.join(stats.select(*keys, "freq"), keys)
    else:
        joined = base.withColumn("freq", F.lit(stats.collect()[0]["freq"]))
    joined = joined.withColumn("ts", bucket(F.col("t"), F.col("freq")))
    num_feats = [f for f in features if isinstance(df.schema[f].dataType, T.NumericType)]
    txt_feats = [f for f in features if f not in num_feats]
    ysum = F.sum(F.col("v").cast(f"decimal(38,{scale})")).cast("double") if scale is not None else F.sum("v")
    aggs = [ysum.alias("y"), F.sum("_n").alias("n_obs")]
    aggs += [F.avg(F.col(f).cast("double")).alias(f) for f in num_feats]
    aggs += [F.mode(F.col(f), True).alias(f) for f in txt_feats]
    g = joined.groupBy(*keys, "freq", "ts").agg(*aggs)
    if policy == "zero":
        span = stats.select(*keys, "freq", bucket(F.col("t_min"), F.col("freq")).alias("b0"),
                            bucket(F.col("t_max"), F.col("freq")).alias("b1"))
        grid = span.select(*keys, "freq", F.explode(bucket_grid(F.col("b0"), F.col("b1"), F.col("freq"))).alias("ts"))
        g = grid.join(g, [*keys, "freq", "ts"], "left").select(
            *keys, "freq", "ts", F.coalesce(F.col("y"), F.lit(0.0)).alias("y"),
            F.coalesce(F.col("n_obs"), F.lit(0)).alias("n_obs"), *features)
    if keep_newest is None:
        return g
    w = Window.partitionBy(*keys).orderBy(F.col("ts").desc()) if keys else Window.orderBy(F.col("ts").desc())
    return g.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep_newest).drop("_rn")


def fill_features(frame: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Forward then backward fill of feature columns in time order; then 0 / Unknown."""
    keys = _keys(keys)
    fwd = _part(keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    bwd = _part(keys).orderBy("ts").rowsBetween(0, Window.unboundedFollowing)
    for f in features:
        filled = F.coalesce(F.last(f, True).over(fwd), F.first(f, True).over(bwd))
        dflt = F.lit(0.0) if isinstance(frame.schema[f].dataType, T.NumericType) else F.lit("Unknown")
        frame = frame.withColumn(f, F.coalesce(filled, dflt))
    return frame


# ---------------------------------------------------------------------------
# T6 outlier capping, T7 log test
# ---------------------------------------------------------------------------

def sorted_quantile(sorted_arr: Column, p: float) -> Column:
    """Linear-interpolated quantile of a sorted array: v[⌊h⌋] + (v[⌈h⌉] − v[⌊h⌋])·(h − ⌊h⌋), h = (n−1)·p."""
    n = F.size(sorted_arr)
    h = (n - 1) * F.lit(float(p))
    lo = F.element_at(sorted_arr, (F.floor(h) + 1).cast("int"))
    hi = F.element_at(sorted_arr, (F.ceil(h) + 1).cast("int"))
    return lo + (hi - lo) * (h - F.floor(h))


def _quartiles(frame: DataFrame, keys: list[str], col: str) -> DataFrame:
    # One row per bucket of a series: the array grows with its calendar span, not with its rows.
    arr = F.sort_array(F.collect_list(F.col(col).cast("double")))
    g = frame.groupBy(*keys).agg(arr.alias("_a"))
    return g.select(*keys, sorted_quantile(F.col("_a"), 0.25).alias("q1"), sorted_quantile(F.col("_a"), 0.75).alias("q3"))


def _clip(frame: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    q = _quartiles(frame, keys, col)
    if keys:
        j = frame.join(q, keys)
    else:
        row = q.collect()[0]
        j = frame.withColumn("q1", F.lit(row["q1"])).withColumn("q3", F.lit(row["q3"]))
    iqr = F.col("q3") - F.col("q1")
    lo = F.col("q1") - IQR_FACTOR * iqr
    hi = F.col("q3") + IQR_FACTOR * iqr
    capped = F.when(iqr < 1e-9, F.col(col)).otherwise(F.least(F.greatest(F.col(col), lo), hi))
    return j.withColumn(out, capped).drop("q1", "q3")


def cap_outliers(frame: DataFrame, keys: Sequence[str] | None = None, col: str = "y") -> DataFrame:
    """IQR ×3 clip per series, applied twice (second pass on the clipped values).

    Adds ``y_raw`` (before) and ``is_anomaly``/``direction`` for changed points.
    """
    keys = _keys(keys)
    f1 = _clip(frame.withColumn("y_raw", F.col(col)), keys, col, "_c1")
    f2 = _clip(f1, keys, "_c1", "_c2")
    changed = F.abs(F.col("y_raw") - F.col(col)) > 1e-6
    return (f2.withColumn(col, F.col("_c2")).drop("_c1", "_c2")
            .withColumn("is_anomaly", changed)
            .withColumn("direction", F.when(changed & (F.col("y_raw") > F.col(col)), F.lit("upper"))
                        .when(changed, F.lit("lower"))))


def anomalies(capped: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """T6 anomaly list: (keys…, date, original_value, capped_value, direction)."""
    keys = _keys(keys)
    return capped.where("is_anomaly").select(
        *keys, F.to_date("ts").alias("date"), F.round("y_raw", 4).alias("original_value"),
        F.round("y", 4).alias("capped_value"), "direction")


def log_test(frame: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Per series, log transform when n ≥ 10, all y > 0, cv ≥ 0.5 and the
    log-space linear-trend residual sum of squares is below the raw one."""
    keys = _keys(keys)
    w = _part(keys).orderBy("ts")
    f = frame.withColumn("_x", (F.row_number().over(w) - 1).cast("double")).withColumn("_ly", F.log(F.col("y")))

    def rss(yc: str) -> Column:
        # Residual sum of squares of a least-squares line: Syy - Sxy^2 / Sxx.
        n = F.count(F.col(yc))
        sxx = F.var_pop("_x") * n
        syy = F.var_pop(yc) * n
        sxy = F.covar_pop("_x", yc) * n
        return syy - sxy * sxy / sxx

    g = f.groupBy(*keys).agg(
        F.count("y").alias("n"), F.min("y").alias("ymin"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"),
        rss("y").alias("rss_raw"), rss("_ly").alias("rss_log"))
    use = ((F.col("n") >= 10) & (F.col("ymin") > 0) & (F.col("mean") > 0)
           & (F.col("std") / F.col("mean") >= LOG_CV_THRESHOLD) & (F.col("rss_log") < F.col("rss_raw")))
    return g.select(*keys, F.coalesce(use, F.lit(False)).alias("use_log"))


def season_length(freq: Column) -> Column:
    """D 7, W 52, MS 12, QS 4."""
    m = F.create_map(*[x for k, v in FREQ_SEASON.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, freq), F.lit(1))


def prepare(df: DataFrame, ts: str, y: str, keys: Sequence[str] | None = None, freq: str | None = None,
            features: Sequence[str] = (), policy: str = "drop", max_points: int = MAX_POINTS,
            scale: int | None = None, log_transform: bool = True, materialize: bool = True) -> DataFrame:
    """T3–T8 composed: resample, fill features, cap outliers, log test, season length.

    Output ``(keys…, freq, season, ts, pos, y, y_raw, is_anomaly, direction, use_log,
    features…)`` with ``pos`` = 0-based time index within the series.  When
    ``use_log`` the target is ``log(max(y, 1e-9))``.  Without keys a constant
    ``series`` key is added (one total series, as the reference).
    """
    keys = _keys(keys)
    if not keys:
        df = df.withColumn("series", F.lit("all"))
        keys = ["series"]
    fr = resample(df, ts, y, keys, freq, features, policy, max_points, scale)
    if materialize:
        # The bucketed series (one row per period) feeds the two clip
        # passes and the log test; write it once instead of re-aggregating.
        from briskbi.session import cut_lineage

        fr = cut_lineage(fr)
    fr = fill_features(fr, keys, list(features)).drop("n_obs")
    fr = cap_outliers(fr, keys)
    if log_transform:
        fr = fr.join(log_test(fr, keys), keys)
    else:
        fr = fr.withColumn("use_log", F.lit(False))
    fr = fr.withColumn("y", F.when(F.col("use_log"), F.log(F.greatest(F.col("y"), F.lit(LOG_MIN_VALUE)))).otherwise(F.col("y")))
    w = _part(keys).orderBy("ts")
    out = fr.withColumn("pos", (F.row_number().over(w) - 1).cast("int")).withColumn("season", season_length(F.col("freq")))
    if materialize:
        # One row per period of a series; every model and fold reads it again.
        from briskbi.session import cut_lineage

        out = cut_lineage(out)
    return out


# ---------------------------------------------------------------------------
# W5–W9, W11, W12 features
# ---------------------------------------------------------------------------

def _ewm(y: str, w: Window, span_cap: int, depth: int = 166) -> Column:
    """Pandas ``ewm(span=min(cap, n), adjust=True)`` over the past rows.

    Weights (1−α)^i over the last ``depth`` past values; (11/13)^166 < 1e-12, so
    the truncation is below double noise for spans ≤ 12.
    """
    hist = F.reverse(F.collect_list(F.col(y)).over(w.rowsBetween(-depth, -1)))
    n = F.count(F.col(y)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    span = F.least(F.lit(span_cap), n).cast("double")
    alpha = F.lit(2.0) / (span + 1)
    num = F.aggregate(F.transform(hist, lambda v, i: v * F.pow(1 - alpha, i)), F.lit(0.0), lambda a, b: a + b)
    den = F.aggregate(F.transform(hist, lambda v, i: F.pow(1 - alpha, i)), F.lit(0.0), lambda a, b: a + b)
    return num / den


def lag_features(frame: DataFrame, keys: Sequence[str] | None = None, season: int | None = None) -> DataFrame:
    """Past-only features of the tree models; 0 when history is short."""
    keys = _keys(keys)
    w = _part(keys).orderBy("ts")
    past = F.count(F.col("y")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = frame.withColumn("_n", past)

    def lag(k: int) -> Column:
        return F.when(F.col("_n") >= k, F.lag("y", k).over(w)).otherwise(F.lit(0.0))

    seas = F.lit(season) if season else F.col("season")
    out = out.withColumn("lag_1", lag(1)).withColumn("lag_2", lag(2)).withColumn("lag_3", lag(3))
    out = out.withColumn("lag_7", lag(7)).withColumn("lag_14", lag(14)).withColumn("lag_21", lag(21))
    if season:
        out = out.withColumn("lag_season", lag(season))
    else:
        # season varies per series: pick from a bounded past array
        hist = F.reverse(F.collect_list("y").over(w.rowsBetween(-52, -1)))
        out = out.withColumn("lag_season", F.when(F.col("_n") >= seas, F.element_at(hist, seas)).otherwise(F.lit(0.0)))
    n = F.col("_n")
    l1, l2, l7, l14 = F.col("lag_1"), F.col("lag_2"), F.col("lag_7"), F.col("lag_14")
    out = out.withColumn("diff_1", F.when(n >= 2, l1 - l2).otherwise(F.lit(0.0)))
    out = out.withColumn("pct_change_1", F.when((n >= 2) & (F.abs(l2) > 1e-9), (l1 - l2) / F.abs(l2)).otherwise(F.lit(0.0)))
    out = out.withColumn("pct_change_7", F.when((n >= 7) & (F.abs(l7) > 1e-9), (l1 - l7) / F.abs(l7)).otherwise(F.lit(0.0)))
    out = out.withColumn("pct_change_14", F.when((n >= 14) & (F.abs(l14) > 1e-9), (l1 - l14) / F.abs(l14)).otherwise(F.lit(0.0)))
    for k in (3, 7, 14, 30):
        out = out.withColumn(f"rolling_mean_{k}", F.when(n >= k, F.avg("y").over(w.rowsBetween(-k, -1))).otherwise(F.lit(0.0)))
    for k in (3, 7):
        out = out.withColumn(f"rolling_std_{k}", F.when(n >= k, F.stddev_samp("y").over(w.rowsBetween(-k, -1))).otherwise(F.lit(0.0)))
    out = out.withColumn("ewm_5", F.when(n >= 2, _ewm("y", w, 5)).otherwise(l1))
    out = out.withColumn("ewm_12", F.when(n >= 2, _ewm("y", w, 12)).otherwise(l1))
    out = out.withColumn("ewm_diff", F.col("ewm_5") - F.col("ewm_12"))
    out = out.withColumn("_x", F.row_number().over(w).cast("double"))
    out = out.withColumn("trend_slope_7", F.when(n >= 7, F.regr_slope(F.col("y"), F.col("_x")).over(w.rowsBetween(-7, -1)))
                         .otherwise(F.lit(0.0)))
    return calendar_features(out.drop("_n", "_x"), "ts")


def calendar_features(frame: DataFrame, ts: str = "ts") -> DataFrame:
    """Month, quarter, weekday (Monday = 0), weekend, month start/end, day of
    year and yearly / weekly sine-cosine terms."""
    t = F.col(ts)
    wd = F.weekday(t)
    doy = F.dayofyear(t)
    two_pi = 2 * 3.141592653589793
    return (frame.withColumn("month", F.month(t)).withColumn("quarter", F.quarter(t)).withColumn("weekday", wd)
            .withColumn("is_weekend", (wd >= 5).cast("int"))
            .withColumn("is_month_start", (F.dayofmonth(t) == 1).cast("int"))
            .withColumn("is_month_end", (F.to_date(t) == F.last_day(t)).cast("int"))
            .withColumn("day_of_year", doy)
            .withColumn("sin_yearly", F.sin(F.lit(two_pi) * doy / 365.25))
            .withColumn("cos_yearly", F.cos(F.lit(two_pi) * doy / 365.25))
            .withColumn("sin_weekly", F.sin(F.lit(two_pi) * wd / 7))
            .withColumn("cos_weekly", F.cos(F.lit(two_pi) * wd / 7)))


def naive_scale(frame: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Mean |y_t − y_{t−1}| per series, floored at 1e-9 (MASE denominator)."""
    keys = _keys(keys)
    w = _part(keys).orderBy("ts")
    d = frame.withColumn("_d", F.abs(F.col("y") - F.lag("y").over(w)))
    return d.groupBy(*keys).agg(F.greatest(F.coalesce(F.avg("_d"), F.lit(1e-9)), F.lit(1e-9)).alias("naive_mae"))


# ---------------------------------------------------------------------------
# T27 future frame, T28 split
# ---------------------------------------------------------------------------

def future(frame: DataFrame, keys: Sequence[str] | None = None, horizon: int = 30,
           features: Sequence[str] = ()) -> DataFrame:
    """Next ``horizon`` timestamps per series, features held at their last value."""
    keys = _keys(keys)
    last = frame.groupBy(*keys).agg(F.max_by(F.struct("ts", "freq", *features), F.col("ts")).alias("l"))
    steps = F.sequence(F.lit(1), F.lit(horizon))
    out = last.select(*keys, "l.*", F.explode(steps).alias("step"))
    nxt = (F.when(F.col("freq") == "D", F.date_add(F.col("ts"), F.col("step")))
           .when(F.col("freq") == "W", F.date_add(F.col("ts"), F.col("step") * 7))
           .when(F.col("freq") == "MS", F.add_months(F.col("ts"), F.col("step")))
           .otherwise(F.add_months(F.col("ts"), F.col("step") * 3)))
    return out.withColumn("ts", nxt.cast("timestamp_ntz")).select(*keys, "step", "ts", *features)


def chronological_split(frame: DataFrame, keys: Sequence[str] | None = None,
                        fractions: tuple[float, float] = (0.70, 0.15)) -> DataFrame:
    """Label rows train / validation / test by time position (70/15/15)."""
    keys = _keys(keys)
    w = _part(keys).orderBy("ts")
    n = F.count(F.lit(1)).over(_part(keys))
    pos = F.row_number().over(w) - 1
    a, b = fractions
    cut1 = F.floor(n * a)
    cut2 = F.floor(n * (a + b))
    return frame.withColumn("split", F.when(pos < cut1, F.lit("train")).when(pos < cut2, F.lit("validation"))
                            .otherwise(F.lit("test")))
