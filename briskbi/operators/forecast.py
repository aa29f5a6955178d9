"""Forecasting by model competition over many series.

Baselines (naive, seasonal naive) are backtested with joins on the fold table,
so no Python runs for them.  Holt-Winters (``ets``) and a Fourier least-squares
seasonal regression (``fourier_ls``, a different algorithm from the
reference's additive model) run per series in ``groupBy(keys).applyInPandas``;
each group is one prepared series, bounded by the point cap.  Selection,
ensembling, intervals, confidence and diagnosis are column expressions and
windows over the small per-(series, model) metrics table.

All functions take the series keys of a prepared frame; ``series.prepare``
adds a constant ``series`` key when the caller forecasts one total series.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briskbi.operators import series as S
from briskbi.operators.boosting import LagTable

# Fixed values of the reference's model competition.
MODEL_MIN_HISTORY = {"naive": 3, "seasonal_naive": 6, "ets": 10, "fourier_ls": 20, "boost_lag": 30, "gbt_lag": 30}
MODEL_ORDER = ["naive", "seasonal_naive", "ets", "fourier_ls", "boost_lag", "gbt_lag"]
# Candidates without a choice of the caller's.  gbt_lag learns one model across all series; it is asked for by name.
MODE_MODELS = {"fast": MODEL_ORDER[:3], "accurate": MODEL_ORDER[:5]}
SELECTION_METRICS = ["mae", "rmse", "wape", "mase"]
PRIMARY_METRIC = "mae"
ENSEMBLE_MAX_GAP = 0.25
INTERVAL_CLIP = (0.05, 0.95)
COVERAGE_Z = {0.80: 1.282, 0.90: 1.645, 0.95: 1.960}
MAD_TO_STD = 1.4826
HORIZON_POWER = 0.20
WAPE_SANE_MAX = 2.0
FIT_RATIO_LIMITS = [(0.70, "check_leakage"), (1.20, "healthy"), (1.50, "mild_overfit"), (2.00, "overfit")]
FIT_RATIO_LAST = "severe_overfit"
TEST_SPLIT_RATIO = 0.30
TOURNAMENT_MIN_CANDIDATES = 4
TOURNAMENT_KEEP_TOP = 3
TOURNAMENT_ALWAYS_KEEP = ("naive", "seasonal_naive")


def adaptive_folds(n: Column) -> Column:
    """5 folds below 150 points, 3 up to 600, 2 up to 1200, else 1."""
    return F.when(n < 150, 5).when(n <= 600, 3).when(n <= 1200, 2).otherwise(1)


def min_history(model: str, season: Column) -> Column:
    """Per-model minimum history; seasonal naive needs two seasons."""
    base = F.lit(MODEL_MIN_HISTORY.get(model, 3))
    return F.greatest(base, season * 2) if model == "seasonal_naive" else base


def plan(stats: DataFrame, model: str, horizon: int) -> DataFrame:
    """(backtest horizon, folds) per series for ``model``; 0 folds = cannot plan."""
    mh = min_history(model, F.col("season"))
    avail = F.col("n") - mh
    desired = adaptive_folds(F.col("n"))
    maxh = F.floor(avail / desired)
    h = F.greatest(F.lit(1), F.when(maxh >= 1, F.least(F.lit(horizon), maxh)).otherwise(F.least(F.lit(horizon), avail)))
    folds = F.greatest(F.lit(1), F.least(desired, F.floor(avail / h)))
    return stats.withColumn("model", F.lit(model)).withColumn("min_hist", mh).withColumn(
        "bt_h", F.when(avail > 0, h).otherwise(0).cast("int")).withColumn(
        "folds", F.when(avail > 0, folds).otherwise(0).cast("int"))


def _series_stats(prep: DataFrame, keys: list[str]) -> DataFrame:
    return prep.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("season").alias("season"),
                                   F.first("use_log").alias("use_log"),
                                   (F.min("y_raw") >= 0).alias("non_negative"))


def _fold_rows(plans: DataFrame) -> DataFrame:
    f = plans.where(F.col("folds") > 0).select("*", F.explode(F.sequence(F.lit(0), F.col("folds") - 1)).alias("fold"))
    test_end = F.col("n") - (F.col("folds") - F.col("fold") - 1) * F.col("bt_h")
    return f.withColumn("test_start", test_end - F.col("bt_h")).withColumn("test_end", test_end)


def _baseline_predictions(prep: DataFrame, folds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model, fold, pos, y_true, pred) for naive / seasonal naive test points."""
    pts = prep.select(*keys, "pos", "y")
    test = folds.join(pts, keys).where((F.col("pos") >= F.col("test_start")) & (F.col("pos") < F.col("test_end")))
    i = F.col("pos") - F.col("test_start")
    last_pos = F.col("test_start") - 1
    src = F.when(F.col("model") == "naive", last_pos).otherwise(
        F.when(F.col("test_start") < F.col("season"), last_pos).otherwise(
            F.col("test_start") - F.col("season") + (i % F.col("season"))))
    test = test.withColumn("src_pos", src)
    lookup = pts.select(*keys, F.col("pos").alias("src_pos"), F.col("y").alias("pred"))
    return test.join(lookup, [*keys, "src_pos"]).select(*keys, "model", "fold", "pos", F.col("y").alias("y_true"), "pred")


def _train_scale(prep: DataFrame, folds: DataFrame, keys: list[str]) -> DataFrame:
    """W11 per fold: mean |Δy| over the training part, floored at 1e-9."""
    w = Window.partitionBy(*keys).orderBy("pos")
    d = prep.select(*keys, "pos", "use_log", "y").withColumn(
        "yv", F.when(F.col("use_log"), F.exp("y")).otherwise(F.col("y")))
    d = d.withColumn("ad", F.abs(F.col("yv") - F.lag("yv").over(w)))
    j = folds.select(*keys, "model", "fold", "test_start").join(d.select(*keys, "pos", "ad"), keys).where(
        (F.col("pos") >= 1) & (F.col("pos") < F.col("test_start")))
    return j.groupBy(*keys, "model", "fold").agg(F.greatest(F.coalesce(F.avg("ad"), F.lit(1e-9)), F.lit(1e-9)).alias("naive_mae"))


def fold_metrics(preds: DataFrame, keys: list[str]) -> DataFrame:
    """T17 per fold: MAE, RMSE, WAPE (0 when Σ|y| ≤ 1e-9), MASE (∞ when scale ≤ 1e-9)."""
    e = F.col("y_true") - F.col("pred")
    g = preds.groupBy(*keys, "model", "fold").agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(F.abs(e)).alias("sae"), F.sum(F.abs("y_true")).alias("say"), F.first("naive_mae").alias("naive_mae"))
    return g.select(*keys, "model", "fold", "mae", "rmse",
                    F.when(F.col("say") > 1e-9, F.col("sae") / F.col("say")).otherwise(F.lit(0.0)).alias("wape"),
                    F.when(F.col("naive_mae") > 1e-9, F.col("mae") / F.col("naive_mae")).otherwise(F.lit(float("inf"))).alias("mase"))


def _finish_preds(preds: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Invert the log transform and apply the non-negative clamp (T22).  Points of a failed fit (null) are left out."""
    j = preds.where(F.col("pred").isNotNull()).join(stats.select(*keys, "use_log", "non_negative"), keys)
    inv = lambda c: F.when(F.col("use_log"), F.exp(c)).otherwise(c)
    pred = inv(F.col("pred"))
    pred = F.when(F.col("non_negative"), F.greatest(F.lit(0.0), pred)).otherwise(pred)
    return j.withColumn("y_true", inv(F.col("y_true"))).withColumn("pred", pred).drop("use_log", "non_negative")


# ---------------------------------------------------------------------------
# Grouped-map models (per series, numpy)
# ---------------------------------------------------------------------------

#: Halvings of the step when smoothing parameters are fitted after the grid.
SMOOTHING_ROUNDS = 4


def _smooth(y: np.ndarray, season: int, alpha: np.ndarray, beta: np.ndarray, gamma: np.ndarray, use_trend: bool, use_season: bool) -> tuple[np.ndarray, ...]:
    """(squared error, level, trend, seasonal) of additive smoothing, one entry per setting: a single pass over time."""
    n = len(y)
    level = np.full(len(alpha), y[0], float)
    trend = np.full(len(alpha), (y[1] - y[0]) if (use_trend and n > 1) else 0.0)
    width = season if use_season else 1
    seasonal = np.zeros((width, len(alpha)))
    if use_season:
        seasonal += (y[:season] - y[:season].mean())[:, None]
    sse = np.zeros(len(alpha))
    for t in range(1, n):
        now = seasonal[t % width]
        ahead = level + trend
        sse += (y[t] - ahead - now) ** 2
        new_level = alpha * (y[t] - now) + (1 - alpha) * ahead
        if use_trend:
            trend = beta * (new_level - level) + (1 - beta) * trend
        if use_season:
            seasonal[t % width] = gamma * (y[t] - new_level) + (1 - gamma) * now
        level = new_level
    return np.where(np.isnan(sse), np.inf, sse), level, trend, seasonal


def _holt_winters(y: np.ndarray, season: int, horizon: int, rounds: int = SMOOTHING_ROUNDS) -> np.ndarray:
    """Additive Holt-Winters: trend when n ≥ 10, season when n ≥ 2 seasons.

    The best setting of a grid is fitted further by a pattern search within [0, 1]: all steps from it
    are tried at once, then the step is halved, so the error is never above the grid's.
    """
    n = len(y)
    use_trend = n >= 10
    use_season = season > 1 and n >= 2 * season
    grid = np.array([0.1, 0.3, 0.5, 0.7, 0.9])
    free = np.array([True, use_trend, use_season])
    trial = np.stack([x.ravel() for x in np.meshgrid(grid, grid if use_trend else [0.0], grid[:3] if use_season else [0.0], indexing="ij")])
    moves = np.stack([x.ravel() for x in np.meshgrid(*[[-1.0, 0.0, 1.0] if f else [0.0] for f in free], indexing="ij")])
    best, step = None, 0.1
    for _ in range(rounds + 1):
        sse, level, trend, seasonal = _smooth(y, season, *trial, use_trend, use_season)
        i = int(np.argmin(sse))
        if best is None or sse[i] < best[0]:
            best = sse[i], trial[:, i], level[i], trend[i], seasonal[:, i].copy()
        trial = np.clip(best[1][:, None] + step * moves, 0.0, 1.0)
        step /= 2
    _, _, level, trend, seasonal = best
    steps = np.arange(1, horizon + 1)
    out = level + steps * trend
    if use_season:
        out = out + seasonal[(n - 1 + steps) % season]
    return out.astype(float)


_PERIODS = {"D": [(365.25, 3), (7.0, 2)], "W": [(52.1775, 3)], "MS": [(12.0, 2)], "QS": [(4.0, 1)]}


def _fourier_design(t: np.ndarray, freq: str) -> np.ndarray:
    cols = [np.ones_like(t), t]
    for period, k in _PERIODS.get(freq, []):
        for j in range(1, k + 1):
            cols += [np.sin(2 * np.pi * j * t / period), np.cos(2 * np.pi * j * t / period)]
    return np.column_stack(cols)


def _fourier_ls(y: np.ndarray, freq: str, horizon: int) -> np.ndarray:
    """Trend + Fourier seasonal terms fitted by least squares."""
    n = len(y)
    t = np.arange(n, dtype=float)
    x = _fourier_design(t, freq)
    coef, *_ = np.linalg.lstsq(x, y, rcond=None)
    tf = np.arange(n, n + horizon, dtype=float)
    return _fourier_design(tf, freq) @ coef


def _fit_predict(model: str, y: np.ndarray, season: int, freq: str, horizon: int) -> np.ndarray:
    if model == "ets":
        return _holt_winters(y, season, horizon)
    if model == "fourier_ls":
        return _fourier_ls(y, freq, horizon)
    raise ValueError(f"Unsupported model: {model}")


class _Series:
    """One prepared series inside its task: every grouped model learns from a prefix of it."""

    def __init__(self, pdf: pd.DataFrame, models: Sequence[str], features: Sequence[str], known: Sequence[str], window: int | None):
        pdf = pdf.sort_values("pos")
        self.meta, self.window = pdf.iloc[0], window
        self.season, self.freq = int(self.meta["season"]), str(self.meta["freq"])
        y = pdf["y"].to_numpy(dtype=float)
        self.y = y[~np.isnan(y)]  # periods after the last value are future ones
        self.lags = LagTable(pdf, self.season, features, known) if "boost_lag" in models else None

    def predict(self, model: str, start: int, horizon: int, quantiles: Sequence[float] = ()) -> np.ndarray:
        """(horizon, 1 + quantiles) from the periods before ``start``; quantiles a model lacks, and failed fits, are NaN."""
        out = np.full((horizon, 1 + len(quantiles)), np.nan)
        try:
            if model == "boost_lag":
                return self.lags.forecast(start, horizon, quantiles, self.window)
            begin = max(0, start - self.window) if self.window else 0
            out[:, 0] = _fit_predict(model, self.y[begin:start], self.season, self.freq, horizon)
        except (ValueError, np.linalg.LinAlgError):
            pass
        return out


def _tested(one: _Series, keys: list[str], model: str, fold: int, start: int, horizon: int) -> pd.DataFrame:
    return pd.DataFrame({**{k: [one.meta[k]] * horizon for k in keys}, "model": model, "fold": fold, "pos": np.arange(start, start + horizon),
                         "y_true": one.y[start : start + horizon], "pred": one.predict(model, start, horizon)[:, 0]})


def _grouped_backtest(keys: list[str], models: list[str], features: Sequence[str], known: Sequence[str], window: int | None):
    """applyInPandas body: the folds planned for the models of one series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        plans = {m: tuple(pdf[[f"plan_{m}_h", f"plan_{m}_folds"]].iloc[0]) for m in models}
        plans = {m: (int(h), int(f)) for m, (h, f) in plans.items() if not (pd.isna(h) or pd.isna(f)) and f > 0}
        one = _Series(pdf, list(plans), features, known, window)
        n = len(one.y)
        out = [_tested(one, keys, m, fold, n - (folds - fold) * h, h) for m, (h, folds) in plans.items() for fold in range(folds)]
        return pd.concat(out) if out else pd.DataFrame(columns=[*keys, "model", "fold", "pos", "y_true", "pred"])

    return run


def _grouped_holdout(keys: list[str], features: Sequence[str], known: Sequence[str], window: int | None):
    """applyInPandas body: the grouped models of a series on its holdout window."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = list(pdf["_models"].iloc[0])
        one = _Series(pdf, asked, features, known, window)
        return pd.concat([_tested(one, keys, m, 0, int(one.meta["_start"]), int(one.meta["_h"])) for m in asked])

    return run


def backtest(prep: DataFrame, keys: Sequence[str] | None = None, horizon: int = 30,
             models: Sequence[str] | None = None, screen_folds: int | None = None,
             keep: DataFrame | None = None, features: Sequence[str] = (), known: Sequence[str] = (),
             train_window: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rolling-origin backtest of each model on each series.

    ``features`` are exogenous columns of ``prep`` for ``boost_lag``, those in ``known`` are known ahead;
    grouped models learn from the last ``train_window`` periods before a fold (all without it).

    Returns (metrics, predictions): metrics per (keys, model) with status, folds,
    backtest horizon and fold-averaged MAE/RMSE/WAPE/MASE; predictions per test
    point (for residuals and intervals).
    """
    keys = list(keys or [])
    models = list(models or ["naive", "seasonal_naive"])
    stats = _series_stats(prep, keys)
    plans = None
    for m in models:
        p = plan(stats, m, horizon)
        if screen_folds is not None:
            p = p.withColumn("folds", F.when(F.col("folds") > 0, F.least(F.col("folds"), F.lit(screen_folds))).otherwise(0))
        plans = p if plans is None else plans.unionByName(p)
    if keep is not None:  # T16: only the (series, model) pairs kept by the screen
        plans = plans.join(keep.select(*keys, "model"), [*keys, "model"], "left_semi")
    folds = _fold_rows(plans)
    base_models = [m for m in models if m in ("naive", "seasonal_naive")]
    py_models = [m for m in models if m not in base_models and m != "gbt_lag"]
    preds = None
    if base_models:
        preds = _baseline_predictions(prep, folds.where(F.col("model").isin(*base_models)), keys)
    if py_models:
        wide = plans.where(F.col("model").isin(*py_models)).groupBy(*keys).pivot("model", py_models).agg(
            F.first("bt_h").alias("h"), F.first("folds").alias("folds"))
        for m in py_models:
            wide = wide.withColumnRenamed(f"{m}_h", f"plan_{m}_h").withColumnRenamed(f"{m}_folds", f"plan_{m}_folds")
        grp = prep.select(*keys, "pos", "ts", "y", "season", "freq", *features).join(wide, keys)
        schema = ", ".join([f"{k} {prep.schema[k].dataType.simpleString()}" for k in keys]
                           + ["model string", "fold int", "pos int", "y_true double", "pred double"])
        py = grp.groupBy(*keys).applyInPandas(_grouped_backtest(keys, py_models, features, known, train_window), schema)
        preds = py if preds is None else preds.unionByName(py)
    if "gbt_lag" in models and folds.where(F.col("model") == "gbt_lag").limit(1).count():
        g = gbt_backtest_preds(prep, folds, keys)
        preds = g if preds is None else preds.unionByName(g)
    scale = _train_scale(prep, folds, keys)
    preds = _finish_preds(preds, stats, keys)
    preds = preds.join(scale, [*keys, "model", "fold"])
    fm = fold_metrics(preds, keys)
    agg = fm.groupBy(*keys, "model").agg(F.count(F.lit(1)).alias("folds_done"),
                                         *[F.avg(m).alias(m) for m in SELECTION_METRICS])
    sane = (F.col("mae").isNotNull() & ~F.isnan("mae") & (F.abs("mae") < float("inf"))
            & ~F.isnan("rmse") & (F.abs("rmse") < float("inf")) & ~F.isnan("wape") & (F.col("wape") <= WAPE_SANE_MAX))
    res = plans.select(*keys, "model", "bt_h", "folds", "min_hist").join(agg, [*keys, "model"], "left")
    status = (F.when(F.col("folds") <= 0, F.lit("failed")).when(F.col("folds_done").isNull(), F.lit("failed"))
              .when(sane, F.lit("ok")).otherwise(F.lit("failed")))
    error = (F.when(F.col("folds") <= 0, F.lit("cannot_plan_backtest_with_available_history"))
             .when(F.col("folds_done").isNull(), F.lit("insufficient_train_rows_in_backtest"))
             .when(~sane, F.lit("divergent_predictions_detected")))
    res = res.select(*keys, "model", status.alias("status"), error.alias("error"),
                     F.coalesce(F.col("folds_done"), F.lit(0)).alias("folds"), F.col("bt_h").alias("backtest_horizon"),
                     *SELECTION_METRICS)
    return res, preds


# ---------------------------------------------------------------------------
# T16, T19, T20, W4 selection
# ---------------------------------------------------------------------------

def _model_index() -> Column:
    m = F.create_map(*[x for i, name in enumerate(MODEL_ORDER) for x in (F.lit(name), F.lit(i))])
    return F.coalesce(F.element_at(m, F.col("model")), F.lit(len(MODEL_ORDER)))


def rank_models(metrics: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rank successful models 1..N per metric, average, best = lowest (avg rank, MAE).

    Ties within a metric keep the candidate order.  Adds ``avg_rank``,
    ``is_best`` and ``winner_<metric>`` (the per-metric winner).
    """
    keys = list(keys or [])
    ok = metrics.where(F.col("status") == "ok").withColumn("_mi", _model_index())
    for m in SELECTION_METRICS:
        w = Window.partitionBy(*keys).orderBy(F.col(m), F.col("_mi"))
        ok = ok.withColumn(f"rank_{m}", F.row_number().over(w))
    ok = ok.withColumn("avg_rank", sum((F.col(f"rank_{m}") for m in SELECTION_METRICS[1:]), F.col(f"rank_{SELECTION_METRICS[0]}")) / len(SELECTION_METRICS))
    wb = Window.partitionBy(*keys).orderBy("avg_rank", PRIMARY_METRIC, "_mi")
    ok = ok.withColumn("is_best", F.row_number().over(wb) == 1)
    part = Window.partitionBy(*keys)
    for m in SELECTION_METRICS:
        ok = ok.withColumn(f"winner_{m}", F.first(F.when(F.col(f"rank_{m}") == 1, F.col("model")), True).over(part))
    return ok.drop("_mi")


def tournament_keep(screen: DataFrame, keys: Sequence[str] | None = None, n_candidates: int = 0) -> DataFrame:
    """With more than 4 candidates, keep the best 3 by screened WAPE plus the baselines."""
    keys = list(keys or [])
    if n_candidates <= TOURNAMENT_MIN_CANDIDATES:
        return screen.select(*keys, "model")
    ok = screen.where(F.col("status") == "ok").withColumn("_mi", _model_index())
    w = Window.partitionBy(*keys).orderBy("wape", "_mi")
    ranked = ok.where(~F.col("model").isin(*TOURNAMENT_ALWAYS_KEEP)).withColumn("_r", F.row_number().over(w))
    top = ranked.where(F.col("_r") <= TOURNAMENT_KEEP_TOP).select(*keys, "model")
    base = screen.where(F.col("model").isin(*TOURNAMENT_ALWAYS_KEEP)).select(*keys, "model")
    return top.unionByName(base)


def select(ranked: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Winner, ensemble partner and confidence per series."""
    keys = list(keys or [])
    best = ranked.where("is_best").select(*keys, F.col("model").alias("best_model"), F.col("mae").alias("best_mae"),
                                          *[f"winner_{m}" for m in SELECTION_METRICS])
    others = ranked.join(best, keys).where(F.col("model") != F.col("best_model"))
    w = Window.partitionBy(*keys).orderBy("mae", F.col("model"))
    runner = others.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select(
        *keys, F.col("model").alias("runner_model"), F.col("mae").alias("runner_mae"))
    naive = ranked.where(F.col("model") == "naive").select(*keys, F.col("mae").alias("naive_mae"))
    out = best.join(runner, keys, "left").join(naive, keys, "left")
    gap = F.try_divide(F.col("runner_mae") - F.col("best_mae"), F.col("best_mae"))
    partner = F.when(F.col("best_mae").isNotNull() & (F.col("best_mae") >= 1e-12) & (gap <= ENSEMBLE_MAX_GAP), F.col("runner_model"))
    improvement = F.when(F.col("naive_mae") > 1e-12, (F.col("naive_mae") - F.col("best_mae")) / F.col("naive_mae") * 100)
    conf = (F.when(improvement.isNull(), F.lit("medium")).when(improvement >= 20, F.lit("high"))
            .when(improvement >= 0, F.lit("medium")).otherwise(F.lit("low")))
    return out.withColumn("ensemble_partner", partner).withColumn("improvement_pct", improvement).withColumn("confidence", conf)


# ---------------------------------------------------------------------------
# T21–T26 intervals, constraints, diagnosis, warnings, accuracy
# ---------------------------------------------------------------------------

def interval_widths(preds: DataFrame, keys: Sequence[str] | None, horizon: int, coverage: float = 0.80) -> DataFrame:
    """Half-widths z·1.4826·MAD·step^0.2 from clipped backtest residuals; none → ±1.

    Residuals per series are bounded by folds × horizon, so exact per-series
    percentiles are cheap.
    """
    keys = list(keys or [])
    z = COVERAGE_Z.get(round(coverage, 2), 1.282)
    r = preds.select(*keys, (F.col("y_true") - F.col("pred")).alias("r"))
    lo, hi = INTERVAL_CLIP
    q = r.groupBy(*keys).agg(F.percentile("r", lo).alias("clo"), F.percentile("r", hi).alias("chi"))
    c = r.join(q, keys).withColumn("r", F.least(F.greatest(F.col("r"), F.col("clo")), F.col("chi")))
    c = c.join(c.groupBy(*keys).agg(F.median("r").alias("med")), keys)
    mad = c.groupBy(*keys).agg(F.median(F.abs(F.col("r") - F.col("med"))).alias("mad"))
    std = F.greatest(F.col("mad") * MAD_TO_STD, F.lit(1e-9))
    steps = mad.select(*keys, std.alias("robust_std"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return steps.withColumn("half_width", F.lit(z) * F.col("robust_std") * F.pow(F.col("step").cast("double"), HORIZON_POWER))


def apply_constraints(fc: DataFrame, non_negative: Column) -> DataFrame:
    """Clamp at 0 for non-negative targets; repair brackets so lower ≤ value ≤ upper."""
    v = F.when(non_negative, F.greatest(F.col("value"), F.lit(0.0))).otherwise(F.col("value"))
    lo = F.when(non_negative, F.greatest(F.col("lower"), F.lit(0.0))).otherwise(F.col("lower"))
    hi = F.when(non_negative, F.greatest(F.col("upper"), F.lit(0.0))).otherwise(F.col("upper"))
    return fc.withColumn("value", v).withColumn("lower", F.least(lo, F.col("value"))).withColumn("upper", F.greatest(hi, F.col("value")))


def fit_diagnosis(ratio: Column) -> Column:
    """Test MAE / CV MAE → check_leakage, healthy, mild_overfit, overfit, severe_overfit."""
    out = F.lit(FIT_RATIO_LAST)
    for bound, name in reversed(FIT_RATIO_LIMITS):
        cmp = ratio < bound if name == "check_leakage" else ratio <= bound
        out = F.when(cmp, F.lit(name)).otherwise(out)
    return F.when(ratio.isNull(), F.lit(None)).otherwise(out)


def quality_warnings(fc: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Repetitive forecast (< 60 % distinct over ≥ 10 steps) and wide intervals."""
    keys = list(keys or [])
    g = fc.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.round("value", 2)).alias("nd"),
        F.avg(F.greatest(F.col("upper") - F.col("lower"), F.lit(0.0))).alias("mean_width"),
        F.avg(F.abs("value")).alias("mean_level"))
    rep = (F.col("n") >= 10) & (F.col("nd") / F.col("n") < 0.6)
    wide = (F.col("mean_level") > 1e-9) & (F.col("mean_width") / F.col("mean_level") > 1.0)
    return g.select(*keys, rep.alias("repetitive"), wide.alias("wide_intervals"))


def accuracy(pred: DataFrame, actual: DataFrame, keys: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Join forecasts to actuals on (keys, ts); per-row errors and MAE/RMSE/MAPE/WAPE."""
    keys = list(keys or [])
    j = pred.select(*keys, "ts", F.col("value").alias("predicted")).join(
        actual.select(*keys, "ts", F.col("y").alias("actual")), [*keys, "ts"])
    rows = j.withColumn("abs_error", F.abs(F.col("actual") - F.col("predicted"))).withColumn(
        "pct_error", F.when(F.col("actual") != 0, F.abs(F.col("actual") - F.col("predicted")) / F.abs("actual") * 100))
    summ = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("abs_error").alias("mae"),
        F.sqrt(F.avg(F.col("abs_error") * F.col("abs_error"))).alias("rmse"), F.avg("pct_error").alias("mape"),
        F.try_divide(F.sum("abs_error"), F.sum(F.abs("actual"))).alias("wape"))
    return rows, summ


def holdout(prep: DataFrame, keys: Sequence[str] | None, horizon: int, models: Sequence[str],
            features: Sequence[str] = (), known: Sequence[str] = (), train_window: int | None = None) -> DataFrame:
    """The newest 30 % of the points are the test part, its first ``horizon`` points are scored."""
    keys = list(keys or [])
    stats = _series_stats(prep, keys)
    # The test part is the rounded share (halves to even), so 11 points train on 8.
    test_start = (F.col("n") - F.bround(F.col("n") * F.lit(TEST_SPLIT_RATIO))).cast("int")
    plans = None
    for m in models:
        p = stats.withColumn("model", F.lit(m)).withColumn("folds", F.lit(1)).withColumn(
            "bt_h", F.least(F.lit(horizon), F.col("n") - test_start)).withColumn("min_hist", min_history(m, F.col("season")))
        plans = p if plans is None else plans.unionByName(p)
    folds = plans.withColumn("fold", F.lit(0)).withColumn("test_start", test_start).withColumn(
        "test_end", test_start + F.col("bt_h")).where(F.col("test_start") >= F.col("min_hist"))
    base = [m for m in models if m in ("naive", "seasonal_naive")]
    numpy_models = [m for m in models if m not in base and m != "gbt_lag"]
    parts = []
    if base:
        parts.append(_baseline_predictions(prep, folds.where(F.col("model").isin(*base)), keys))
    if numpy_models:
        asked = folds.where(F.col("model").isin(*numpy_models)).groupBy(*keys).agg(
            F.collect_list("model").alias("_models"), F.first("test_start").alias("_start"), F.first("bt_h").alias("_h"))
        schema = ", ".join([f"{k} {prep.schema[k].dataType.simpleString()}" for k in keys]
                           + ["model string", "fold int", "pos int", "y_true double", "pred double"])
        grouped = prep.select(*keys, "pos", "ts", "y", "season", "freq", *features).join(asked, keys).groupBy(*keys)
        parts.append(grouped.applyInPandas(_grouped_holdout(keys, features, known, train_window), schema))
    if "gbt_lag" in models and folds.where(F.col("model") == "gbt_lag").limit(1).count():
        parts.append(gbt_backtest_preds(prep, folds, keys))
    preds = reduce(DataFrame.unionByName, parts)
    preds = _finish_preds(preds, stats, keys).join(_train_scale(prep, folds, keys), [*keys, "model", "fold"])
    return fold_metrics(preds, keys).drop("fold")


def forecast_baseline(prep: DataFrame, keys: Sequence[str] | None, model: str, horizon: int) -> DataFrame:
    """T10/T11 refit on the full history: naive repeats the last value, seasonal naive the last season."""
    keys = list(keys or [])
    fut = S.future(prep, keys, horizon)
    stats = _series_stats(prep, keys)
    f = fut.join(stats, keys)
    i = F.col("step") - 1
    if model == "naive":
        src = F.col("n") - 1
    else:
        src = F.when(F.col("n") < F.col("season"), F.col("n") - 1).otherwise(F.col("n") - F.col("season") + (i % F.col("season")))
    f = f.withColumn("pos", src.cast("int"))
    vals = prep.select(*keys, "pos", F.col("y").alias("value"))
    out = f.join(vals, [*keys, "pos"]).withColumn(
        "value", F.when(F.col("use_log"), F.exp("value")).otherwise(F.col("value")))
    return out.select(*keys, "step", "ts", "value", "non_negative")


def _final_python(prep: DataFrame, keys: list[str], asked: DataFrame, horizon: int, coverage: float,
                  features: Sequence[str], known_ahead: DataFrame | None, train_window: int | None) -> DataFrame:
    """Refit the grouped models that ``asked`` names per series; (keys, model, step, value, lower, upper)."""
    tails = ((1 - coverage) / 2, (1 + coverage) / 2)
    known = [c for c in features if known_ahead is not None and c in known_ahead.columns]
    at = F.col("ts").cast("timestamp_ntz").alias("ts")
    ahead = S.future(prep, keys, horizon, features)
    if known:
        given = known_ahead.select(*keys, at, *[F.col(c).alias(f"_{c}") for c in known])
        ahead = ahead.join(given, [*keys, "ts"], "left")
        for c in known:
            ahead = ahead.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c)))
    last = prep.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("season").alias("season"), F.first("freq").alias("freq"))
    ahead = ahead.join(last, keys).select(*keys, (F.col("n") + F.col("step") - 1).cast("int").alias("pos"), at,
                                          F.lit(None).cast("double").alias("y"), "season", "freq", *features)
    rows = prep.select(*keys, "pos", at, "y", "season", "freq", *features).unionByName(ahead)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        models = list(pdf["_models"].iloc[0])
        one = _Series(pdf.drop(columns="_models"), models, features, known, train_window)
        out = []
        for m in models:
            if len(one.y) >= MODEL_MIN_HISTORY.get(m, 3):
                got = one.predict(m, len(one.y), horizon, tails)
                out.append(pd.DataFrame({**{k: [one.meta[k]] * horizon for k in keys}, "model": m, "step": np.arange(1, horizon + 1),
                                         "value": got[:, 0], "lower": got.min(1), "upper": got.max(1)}).dropna(subset=["value"]))
        return pd.concat(out) if out else pd.DataFrame(columns=[*keys, "model", "step", "value", "lower", "upper"])

    schema = ", ".join([f"{k} {prep.schema[k].dataType.simpleString()}" for k in keys]
                       + ["model string", "step int", "value double", "lower double", "upper double"])
    made = rows.join(asked, keys).groupBy(*keys).applyInPandas(run, schema)
    return made.select(*keys, "model", "step", "value", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("lower", "upper")])


def run(df: DataFrame, ts: str, y: str, keys: Sequence[str] | None = None, horizon: int = 30, mode: str = "fast",
        models: Sequence[str] | None = None, freq: str | None = None, policy: str = "drop",
        features: Sequence[str] = (), scale: int | None = None, coverage: float = 0.80,
        known_ahead: DataFrame | None = None, train_window: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Forecast every series: prepare → backtest → rank → ensemble → intervals.

    ``features`` are exogenous columns: those that ``known_ahead`` (keys, ts, columns) holds for future periods
    are read there, the others stay at their last value.  Where ``boost_lag`` wins, the interval
    comes from its quantile trees; else from the residuals of the backtest (T21).

    Returns (forecasts, log): forecasts ``(keys…, step, ts, value, lower, upper,
    model)``; log one row per (series, model) with metrics, holdout diagnosis,
    the winner, partner and confidence.  ``mode='fast'`` uses the cheap models.
    """
    from briskbi.session import cut_lineage

    prep = S.prepare(df, ts, y, keys, freq, features, policy, scale=scale)  # checkpointed
    keys = list(keys or ["series"])
    models = list(models or MODE_MODELS["fast" if mode == "fast" else "accurate"])
    known = [c for c in features if known_ahead is not None and c in known_ahead.columns]
    learned = {"features": list(features), "known": known, "train_window": train_window}
    keep = None
    if len(models) > TOURNAMENT_MIN_CANDIDATES:
        # A one-fold screen, then the full backtest for the best 3 + baselines.
        screen, _ = backtest(prep, keys, horizon, models, screen_folds=1, **learned)
        keep = cut_lineage(tournament_keep(screen, keys, len(models)))
    metrics, preds = backtest(prep, keys, horizon, models, keep=keep, **learned)
    # Read by several branches below: written once (reliable checkpoint).
    metrics, preds = cut_lineage(metrics), cut_lineage(preds)
    ranked = rank_models(metrics, keys)
    sel = cut_lineage(select(ranked, keys))
    used = {r[0] for c in ("best_model", "ensemble_partner") for r in sel.select(c).distinct().collect()}  # model names

    stats = _series_stats(prep, keys)

    def scaled(df: DataFrame) -> DataFrame:
        df = df.join(stats.select(*keys, "use_log"), keys)
        for c in ("value", "lower", "upper"):
            made = F.col(c) if c in df.columns else F.lit(None).cast("double")
            df = df.withColumn(c, F.when(F.col("use_log"), F.exp(made)).otherwise(made))
        return df.select(*keys, "model", "step", "value", "lower", "upper")

    # Only models that won, or are a winner's partner, are fitted again.
    none = F.lit(None).cast("double")
    parts = [forecast_baseline(prep, keys, m, horizon).select(*keys, F.lit(m).alias("model"), "step", "value", none.alias("lower"), none.alias("upper"))
             for m in ("naive", "seasonal_naive") if m in used]
    if "gbt_lag" in used:
        parts.append(scaled(gbt_forecast(prep, keys, horizon)))
    grouped = [m for m in models if m in used and m not in ("naive", "seasonal_naive", "gbt_lag")]
    if grouped:
        chosen_models = F.filter(F.array("best_model", "ensemble_partner"), lambda m: m.isin(*grouped))
        asked = sel.select(*keys, chosen_models.alias("_models")).where(F.size("_models") > 0)
        parts.append(scaled(_final_python(prep, keys, asked, horizon, coverage, features, known_ahead, train_window)))
    allf = reduce(DataFrame.unionByName, parts) if parts else scaled(forecast_baseline(prep, keys, "naive", horizon).withColumn("model", F.lit("naive")))
    chosen = allf.join(sel.select(*keys, "best_model", "ensemble_partner"), keys).where(
        (F.col("model") == F.col("best_model")) | (F.col("model") == F.col("ensemble_partner")))
    fc = chosen.groupBy(*keys, "step").agg(F.avg("value").alias("value"),
                                          F.first("best_model").alias("best_model"),
                                          F.max(F.when(F.col("model") == F.col("best_model"), F.col("lower") - F.col("value"))).alias("down"),
                                          F.max(F.when(F.col("model") == F.col("best_model"), F.col("upper") - F.col("value"))).alias("up"),
                                          F.first("ensemble_partner").alias("partner"))
    fc = fc.withColumn("model", F.when(F.col("partner").isNotNull(), F.concat_ws("+", "best_model", "partner"))
                       .otherwise(F.col("best_model"))).drop("best_model", "partner")
    best_preds = preds.join(sel.select(*keys, F.col("best_model").alias("model")), [*keys, "model"])
    widths = interval_widths(best_preds, keys, horizon, coverage)
    fc = fc.join(widths.select(*keys, "step", "half_width"), [*keys, "step"], "left").withColumn(
        "half_width", F.coalesce(F.col("half_width"), F.lit(1.0)))
    fc = fc.withColumn("lower", F.col("value") + F.coalesce("down", -F.col("half_width"))).withColumn(
        "upper", F.col("value") + F.coalesce("up", "half_width"))
    fut = S.future(prep, keys, horizon)
    fc = fc.join(stats.select(*keys, "non_negative"), keys).join(fut.select(*keys, "step", "ts"), [*keys, "step"])
    fc = apply_constraints(fc, F.col("non_negative")).select(*keys, "step", "ts", "value", "lower", "upper", "model")

    test = holdout(prep, keys, horizon, models, **learned)  # every candidate gets a test error
    log = ranked.join(test.select(*keys, "model", F.col("mae").alias("test_mae")), [*keys, "model"], "left")
    log = log.withColumn("fit_ratio", F.round(F.try_divide(F.col("test_mae"), F.col("mae")), 3)).withColumn(
        "fit_diagnosis", fit_diagnosis(F.try_divide(F.col("test_mae"), F.col("mae"))))
    log = log.join(sel.select(*keys, "best_model", "ensemble_partner", "improvement_pct", "confidence"), keys)
    log = log.join(quality_warnings(fc, keys), keys, "left")
    return fc, log


# ---------------------------------------------------------------------------
# One global boosted-tree model on lag features (direct multi-horizon)
# ---------------------------------------------------------------------------

GBT_LAG_FEATURES = ["lag_1", "lag_2", "lag_3", "lag_7", "lag_14", "lag_21", "lag_season", "diff_1", "pct_change_1",
                    "pct_change_7", "pct_change_14", "rolling_mean_3", "rolling_mean_7", "rolling_mean_14",
                    "rolling_mean_30", "rolling_std_3", "rolling_std_7", "ewm_5", "ewm_12", "ewm_diff", "trend_slope_7"]
GBT_CALENDAR = ["month", "quarter", "weekday", "is_weekend", "is_month_start", "is_month_end", "day_of_year",
                "sin_yearly", "cos_yearly", "sin_weekly", "cos_weekly"]


def _next_ts(ts: Column, freq: Column, k: Column) -> Column:
    return (F.when(freq == "D", F.date_add(ts, k)).when(freq == "W", F.date_add(ts, k * 7))
            .when(freq == "MS", F.add_months(ts, k)).otherwise(F.add_months(ts, k * 3))).cast("timestamp_ntz")


def _origins(prep: DataFrame, keys: list[str], extend: bool) -> DataFrame:
    """Past-only lag features for every origin position (plus the first future one)."""
    base = prep.select(*keys, "pos", "ts", "y", "season", "freq")
    if extend:
        last = base.groupBy(*keys).agg(F.max_by(F.struct("pos", "ts", "season", "freq"), F.col("pos")).alias("l"))
        nxt = last.select(*keys, (F.col("l.pos") + 1).alias("pos"), _next_ts(F.col("l.ts"), F.col("l.freq"), F.lit(1)).alias("ts"),
                          F.lit(None).cast("double").alias("y"), F.col("l.season").alias("season"), F.col("l.freq").alias("freq"))
        base = base.unionByName(nxt)
    f = S.lag_features(base, keys)
    return f.select(*keys, F.col("pos").alias("origin"), "ts", "freq", *GBT_LAG_FEATURES)


def _examples(origins: DataFrame, prep: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """(origin, h) → target at origin + h − 1 with the target time's calendar features."""
    ex = origins.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    ex = ex.withColumn("pos", F.col("origin") + F.col("h") - 1).withColumn(
        "target_ts", _next_ts(F.col("ts"), F.col("freq"), F.col("h") - 1))
    ex = S.calendar_features(ex, "target_ts")
    tgt = prep.select(*keys, "pos", F.col("y").alias("label"))
    return ex.join(tgt, [*keys, "pos"], "left").na.fill(0.0, subset=GBT_LAG_FEATURES)


def _gbt_fit(train: DataFrame, seed: int = 42):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    cols = GBT_LAG_FEATURES + GBT_CALENDAR + ["h"]
    asm = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")
    gbt = GBTRegressor(featuresCol="features", labelCol="label", predictionCol="pred", maxIter=30, maxDepth=5, seed=seed)
    return Pipeline(stages=[asm, gbt]).fit(train.withColumn("h", F.col("h").cast("double")))


def gbt_backtest_preds(prep: DataFrame, folds: DataFrame, keys: list[str]) -> DataFrame:
    """Backtest predictions of ``gbt_lag``: one global model per fold index, trained
    only on targets before each series' test window, predicting from its start."""
    from briskbi.session import cut_lineage

    fl = folds.where(F.col("model") == "gbt_lag")
    max_h = max([r[0] for r in fl.agg(F.max("bt_h")).collect() if r[0]] or [1])
    ex = cut_lineage(_examples(_origins(prep, keys, False), prep, keys, int(max_h)))
    out = None
    for (fold,) in fl.select("fold").distinct().orderBy("fold").collect():
        f = fl.where(F.col("fold") == fold).select(*keys, "fold", "test_start", "bt_h", "test_end")
        j = ex.join(f, keys)
        train = j.where((F.col("pos") < F.col("test_start")) & F.col("label").isNotNull() & (F.col("origin") >= 1))
        test = j.where((F.col("origin") == F.col("test_start")) & (F.col("h") <= F.col("bt_h")))
        model = _gbt_fit(train)
        p = model.transform(test.withColumn("h", F.col("h").cast("double"))).select(
            *keys, F.lit("gbt_lag").alias("model"), F.col("fold").cast("int").alias("fold"), F.col("pos").cast("int").alias("pos"),
            F.col("label").alias("y_true"), F.col("pred"))
        out = p if out is None else out.unionByName(p)
    return out


def gbt_forecast(prep: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """Refit on all history; forecast steps 1..horizon from the first future origin."""
    origins = _origins(prep, keys, True)
    ex = _examples(origins, prep, keys, horizon)
    n = prep.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    ex = ex.join(n, keys)
    train = ex.where(F.col("label").isNotNull() & (F.col("origin") >= 1) & (F.col("origin") < F.col("n")))
    model = _gbt_fit(train)
    fut = ex.where(F.col("origin") == F.col("n"))
    return model.transform(fut.withColumn("h", F.col("h").cast("double"))).select(
        *keys, F.lit("gbt_lag").alias("model"), F.col("h").cast("int").alias("step"), F.col("pred").alias("value"))
