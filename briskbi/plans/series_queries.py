"""Series and forecasting queries (T1–T28, W4–W12) on events and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from briskbi.operators import forecast, series
from briskbi.plans.registry import register
from briskbi.session import table

_D = "CAST(86400000000 AS DOUBLE)"


def _q(arr: str, p: float) -> str:
    """DuckDB twin of ``series.sorted_quantile``."""
    h = f"((len({arr}) - 1) * CAST({p} AS DOUBLE))"
    lo = f"{arr}[CAST(floor({h}) AS BIGINT) + 1]"
    hi = f"{arr}[CAST(ceil({h}) AS BIGINT) + 1]"
    return f"({lo} + ({hi} - {lo}) * ({h} - floor({h})))"


def _bucket(t: str, f: str) -> str:
    start = f"(CASE WHEN {t} = date_trunc('day', {t}) THEN CAST({t} AS DATE) ELSE CAST({t} AS DATE) + 1 END)"
    return (f"(CASE {f} WHEN 'D' THEN date_trunc('day', {t}) "
            f"WHEN 'W' THEN CAST({start} + CAST((7 - isodow({start})) % 7 AS INTEGER) AS TIMESTAMP) "
            f"WHEN 'MS' THEN date_trunc('month', {t}) ELSE date_trunc('quarter', {t}) END)")


def _prep_sql(tbl: str, key: str, ts: str, val: str, freq: str | None = None, policy: str = "drop",
              cap: bool = True, log: bool = True) -> str:
    """CTEs ending in ``prep(key, freq, season, ts, pos, y, y_raw, use_log)``."""
    if freq:
        fsel = f"SELECT {key}, '{freq}' AS freq FROM base GROUP BY {key}"
    else:
        fsel = f"""SELECT s.{key},
  CASE WHEN f0 = 'D' AND date_diff('day', CAST(t_min AS DATE), CAST(t_max AS DATE)) > 1500 THEN 'W' ELSE f0 END AS freq
FROM (SELECT c.{key}, CASE WHEN n_dates < 3 OR med IS NULL THEN 'D' WHEN med <= 1.5 THEN 'D' WHEN med <= 8 THEN 'W'
             WHEN med <= 31 THEN 'MS' ELSE 'QS' END AS f0
      FROM (SELECT {key}, count(*) AS n_dates FROM dd GROUP BY {key}) c
      LEFT JOIN (SELECT {key}, quantile_cont(gap, 0.5) AS med FROM gaps GROUP BY {key}) m ON m.{key} = c.{key}) x
JOIN (SELECT {key}, min(t) AS t_min, max(t) AS t_max FROM base GROUP BY {key}) s ON s.{key} = x.{key}"""
    zero = ""
    src = "agg"
    if policy == "zero":
        zero = f""",
rng AS (SELECT {key}, freq, min(ts) AS b0, max(ts) AS b1 FROM agg GROUP BY {key}, freq),
grid AS (SELECT {key}, freq, unnest(generate_series(b0, b1, CASE freq WHEN 'D' THEN INTERVAL 1 DAY WHEN 'W' THEN INTERVAL 7 DAY
           WHEN 'MS' THEN INTERVAL 1 MONTH ELSE INTERVAL 3 MONTH END)) AS ts FROM rng),
filled AS (SELECT g.{key}, g.freq, g.ts, COALESCE(a.y, 0.0) AS y, COALESCE(a.n_obs, 0) AS n_obs
           FROM grid g LEFT JOIN agg a ON a.{key} = g.{key} AND a.ts = g.ts)"""
        src = "filled"
    capq = f"""
q1 AS (SELECT {key}, list_sort(list(y)) AS a FROM capin GROUP BY {key}),
c1 AS (SELECT c.*, CASE WHEN {_q('a', 0.75)} - {_q('a', 0.25)} < 1e-9 THEN c.y ELSE
          least(greatest(c.y, {_q('a', 0.25)} - 3.0 * ({_q('a', 0.75)} - {_q('a', 0.25)})),
                {_q('a', 0.75)} + 3.0 * ({_q('a', 0.75)} - {_q('a', 0.25)})) END AS yc1
       FROM capin c JOIN q1 USING ({key})),
q2 AS (SELECT {key}, list_sort(list(yc1)) AS a FROM c1 GROUP BY {key}),
c2 AS (SELECT c1.*, CASE WHEN {_q('a', 0.75)} - {_q('a', 0.25)} < 1e-9 THEN c1.yc1 ELSE
          least(greatest(c1.yc1, {_q('a', 0.25)} - 3.0 * ({_q('a', 0.75)} - {_q('a', 0.25)})),
                {_q('a', 0.75)} + 3.0 * ({_q('a', 0.75)} - {_q('a', 0.25)})) END AS ycap
       FROM c1 JOIN q2 USING ({key})),""" if cap else """
c2 AS (SELECT *, y AS ycap FROM capin),"""
    logq = f"""
lx AS (SELECT c2.*, CAST(row_number() OVER (PARTITION BY {key} ORDER BY ts) - 1 AS DOUBLE) AS x, ln(ycap) AS ly FROM c2),
lt AS (SELECT {key},
   (count(*) >= 10 AND min(ycap) > 0 AND avg(ycap) > 0 AND stddev_samp(ycap) / avg(ycap) >= 0.5 AND
    (var_pop(ly) * count(*) - (covar_pop(x, ly) * count(*)) * (covar_pop(x, ly) * count(*)) / (var_pop(x) * count(*))) <
    (var_pop(ycap) * count(*) - (covar_pop(x, ycap) * count(*)) * (covar_pop(x, ycap) * count(*)) / (var_pop(x) * count(*)))) AS use_log
   FROM lx GROUP BY {key}),""" if log else f"""
lt AS (SELECT {key}, false AS use_log FROM c2 GROUP BY {key}),"""
    return f"""
base AS (SELECT {key}, {ts} AS t, {val} AS v FROM {tbl} WHERE {ts} IS NOT NULL AND {val} IS NOT NULL),
dd AS (SELECT DISTINCT {key}, t FROM base),
gaps AS (SELECT {key}, (epoch_us(t) - epoch_us(lag(t) OVER (PARTITION BY {key} ORDER BY t))) / {_D} AS gap FROM dd),
fr AS ({fsel}),
agg AS (SELECT b.{key}, fr.freq, {_bucket('b.t', 'fr.freq')} AS ts, CAST(SUM(CAST(b.v AS DECIMAL(38,2))) AS DOUBLE) AS y,
               count(*) AS n_obs FROM base b JOIN fr USING ({key}) GROUP BY ALL){zero},
capin AS (SELECT {key}, freq, ts, y, n_obs FROM {src}),{capq}{logq}
prep AS (SELECT c2.{key}, c2.freq, CASE c2.freq WHEN 'D' THEN 7 WHEN 'W' THEN 52 WHEN 'MS' THEN 12 ELSE 4 END AS season, c2.ts,
           CAST(row_number() OVER (PARTITION BY c2.{key} ORDER BY c2.ts) - 1 AS INTEGER) AS pos,
           CASE WHEN lt.use_log THEN ln(greatest(c2.ycap, 1e-9)) ELSE c2.ycap END AS y, c2.y AS y_raw, lt.use_log,
           abs(c2.y - c2.ycap) > 1e-6 AS is_anomaly
         FROM c2 JOIN lt USING ({key}))"""


# T1 -----------------------------------------------------------------------
@register("q_check", """
SELECT o_orderpriority, COUNT(*) AS rows, COUNT(o_orderdate) / COUNT(*) AS time_share,
  COUNT(o_totalprice) / greatest(COUNT(o_totalprice), 1) AS target_share,
  COUNT(*) FILTER (WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL) AS usable_rows,
  CAST(NULL AS VARCHAR) AS reason, true AS ready
FROM orders GROUP BY 1
""")
def q_check(spark, d):
    """Forecast readiness per order priority."""
    return series.check(table(spark, d, "orders"), "o_orderdate", "o_totalprice", ["o_orderpriority"])


# T2 -----------------------------------------------------------------------
@register("q_freq", f"""
WITH dd AS (SELECT DISTINCT o_custkey, o_orderdate AS t FROM orders WHERE o_orderdate IS NOT NULL),
g AS (SELECT o_custkey, (epoch_us(t) - epoch_us(lag(t) OVER (PARTITION BY o_custkey ORDER BY t))) / {_D} AS gap FROM dd),
c AS (SELECT o_custkey, count(*) AS n_dates FROM dd GROUP BY 1),
m AS (SELECT o_custkey, quantile_cont(gap, 0.5) AS median_gap_days FROM g WHERE gap IS NOT NULL GROUP BY 1)
SELECT c.o_custkey, c.n_dates, m.median_gap_days,
  CASE WHEN n_dates < 3 OR median_gap_days IS NULL THEN 'D' WHEN median_gap_days <= 1.5 THEN 'D'
       WHEN median_gap_days <= 8 THEN 'W' WHEN median_gap_days <= 31 THEN 'MS' ELSE 'QS' END AS freq
FROM c LEFT JOIN m USING (o_custkey)
""")
def q_freq(spark, d):
    """Order frequency per customer from the median gap."""
    return series.detect_freq(table(spark, d, "orders"), "o_orderdate", ["o_custkey"])


# T3 -----------------------------------------------------------------------
@register("q_resample", f"""
WITH {_prep_sql('events', 'event_type', 'ts', 'value', cap=False, log=False)}
SELECT event_type, freq, ts, y, n_obs FROM capin
""")
def q_resample(spark, d):
    """Daily value sums per event type (frequency detected)."""
    return series.resample(table(spark, d, "events"), "ts", "value", ["event_type"], scale=2)


# T4 -----------------------------------------------------------------------
@register("q_gap_zero", f"""
WITH {_prep_sql('orders', 'o_orderpriority', 'o_orderdate', 'o_totalprice', freq='D', policy='zero', cap=False, log=False)}
SELECT o_orderpriority, freq, ts, y, n_obs FROM capin
""")
def q_gap_zero(spark, d):
    """T4/T5: daily order value per priority, empty days as 0, every day."""
    return series.resample(table(spark, d, "orders"), "o_orderdate", "o_totalprice", ["o_orderpriority"], freq="D",
                           policy="zero", scale=2)


# T6 -----------------------------------------------------------------------
@register("q_iqr_cap", f"""
WITH {_prep_sql('orders', 'o_orderpriority', 'o_orderdate', 'o_totalprice', freq='D', policy='zero', log=False)}
SELECT o_orderpriority, ts, y AS y_raw, ycap AS y, abs(y - ycap) > 1e-6 AS is_anomaly FROM c2
""")
def q_iqr_cap(spark, d):
    """IQR×3 capping (twice) of daily order value per priority."""
    fr = series.resample(table(spark, d, "orders"), "o_orderdate", "o_totalprice", ["o_orderpriority"], freq="D",
                         policy="zero", scale=2)
    return series.cap_outliers(fr, ["o_orderpriority"]).select("o_orderpriority", "ts", "y_raw", "y", "is_anomaly")


def _prep_events(spark, d):
    return series.prepare(table(spark, d, "events"), "ts", "value", ["event_type"], scale=2)


# T7/T8 --------------------------------------------------------------------
@register("q_prepare", f"""
WITH {_prep_sql('events', 'event_type', 'ts', 'value')}
SELECT event_type, freq, season, ts, pos, y, y_raw, use_log, is_anomaly FROM prep
""")
def q_prepare(spark, d):
    """Prepared daily event series (capping, log test, season length)."""
    return _prep_events(spark, d).select("event_type", "freq", "season", "ts", "pos", "y", "y_raw", "use_log", "is_anomaly")


# T10/T11/T15/T17 ------------------------------------------------------------
_BT_H = 7


def _backtest_sql(key: str) -> str:
    return f"""
stats AS (SELECT {key}, count(*) AS n, max(season) AS season, bool_and(use_log) AS use_log, min(y_raw) >= 0 AS non_negative
          FROM prep GROUP BY {key}),
mods AS (SELECT * FROM (VALUES ('naive'), ('seasonal_naive')) t(model)),
pl AS (SELECT s.*, m.model, CASE WHEN m.model = 'seasonal_naive' THEN greatest(6, 2 * s.season) ELSE 3 END AS min_hist FROM stats s, mods m),
pl2 AS (SELECT *, n - min_hist AS avail, CASE WHEN n < 150 THEN 5 WHEN n <= 600 THEN 3 WHEN n <= 1200 THEN 2 ELSE 1 END AS desired FROM pl),
pl3 AS (SELECT *, greatest(1, CASE WHEN floor(avail / desired) >= 1 THEN least({_BT_H}, floor(avail / desired))
                                 ELSE least({_BT_H}, avail) END) AS h FROM pl2),
pl4 AS (SELECT *, CAST(CASE WHEN avail > 0 THEN h ELSE 0 END AS INTEGER) AS bt_h,
               CAST(CASE WHEN avail > 0 THEN greatest(1, least(desired, floor(avail / h))) ELSE 0 END AS INTEGER) AS folds FROM pl3),
fo AS (SELECT *, unnest(range(folds)) AS fold FROM pl4 WHERE folds > 0),
fo2 AS (SELECT *, n - (folds - fold - 1) * bt_h AS test_end, n - (folds - fold - 1) * bt_h - bt_h AS test_start FROM fo),
tst AS (SELECT f.{key}, f.model, f.fold, f.test_start, f.season, p.pos, p.y FROM fo2 f JOIN prep p
        ON p.{key} = f.{key} AND p.pos >= f.test_start AND p.pos < f.test_end),
src AS (SELECT *, CASE WHEN model = 'naive' THEN test_start - 1 WHEN test_start < season THEN test_start - 1
                       ELSE test_start - season + ((pos - test_start) % season) END AS src_pos FROM tst),
pr AS (SELECT s.{key}, s.model, s.fold, s.pos, s.y AS y_true0, p.y AS pred0 FROM src s JOIN prep p ON p.{key} = s.{key} AND p.pos = s.src_pos),
fin AS (SELECT pr.{key}, pr.model, pr.fold, pr.pos,
          CASE WHEN st.use_log THEN exp(y_true0) ELSE y_true0 END AS y_true,
          CASE WHEN st.non_negative THEN greatest(0.0, CASE WHEN st.use_log THEN exp(pred0) ELSE pred0 END)
               ELSE CASE WHEN st.use_log THEN exp(pred0) ELSE pred0 END END AS pred
        FROM pr JOIN stats st USING ({key})),
dif AS (SELECT {key}, pos, abs(yv - lag(yv) OVER (PARTITION BY {key} ORDER BY pos)) AS ad FROM
        (SELECT {key}, pos, CASE WHEN use_log THEN exp(y) ELSE y END AS yv FROM prep)),
sc AS (SELECT f.{key}, f.model, f.fold, greatest(COALESCE(avg(d.ad), 1e-9), 1e-9) AS naive_mae FROM fo2 f JOIN dif d
       ON d.{key} = f.{key} AND d.pos >= 1 AND d.pos < f.test_start GROUP BY ALL),
fm AS (SELECT fin.{key}, fin.model, fin.fold, avg(abs(y_true - pred)) AS mae, sqrt(avg((y_true - pred) * (y_true - pred))) AS rmse,
          CASE WHEN sum(abs(y_true)) > 1e-9 THEN sum(abs(y_true - pred)) / sum(abs(y_true)) ELSE 0.0 END AS wape,
          CASE WHEN max(sc.naive_mae) > 1e-9 THEN avg(abs(y_true - pred)) / max(sc.naive_mae) ELSE CAST('inf' AS DOUBLE) END AS mase
       FROM fin JOIN sc USING ({key}, model, fold) GROUP BY ALL),
fagg AS (SELECT {key}, model, count(*) AS folds_done, avg(mae) AS mae, avg(rmse) AS rmse, avg(wape) AS wape, avg(mase) AS mase
        FROM fm GROUP BY ALL),
bt AS (SELECT p.{key}, p.model,
          CASE WHEN p.folds <= 0 OR a.folds_done IS NULL THEN 'failed'
               WHEN isfinite(a.mae) AND isfinite(a.rmse) AND NOT isnan(a.wape) AND a.wape <= 2.0 THEN 'ok' ELSE 'failed' END AS status,
          CASE WHEN p.folds <= 0 THEN 'cannot_plan_backtest_with_available_history'
               WHEN a.folds_done IS NULL THEN 'insufficient_train_rows_in_backtest'
               WHEN NOT (isfinite(a.mae) AND isfinite(a.rmse) AND NOT isnan(a.wape) AND a.wape <= 2.0) THEN 'divergent_predictions_detected'
               END AS error,
          COALESCE(a.folds_done, 0) AS folds, p.bt_h AS backtest_horizon, a.mae, a.rmse, a.wape, a.mase
       FROM pl4 p LEFT JOIN fagg a USING ({key}, model))"""


def _metrics6(df):
    return df.select(*[F.round(c, 6).alias(c) if c in forecast.SELECTION_METRICS else F.col(c) for c in df.columns])


@register("q_backtest", f"""
WITH {_prep_sql('events', 'event_type', 'ts', 'value')}, {_backtest_sql('event_type')}
SELECT event_type, model, status, error, folds, backtest_horizon,
       round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(wape, 6) AS wape, round(mase, 6) AS mase FROM bt
""")
def q_backtest(spark, d):
    """Rolling-origin backtest of naive and seasonal naive per event type."""
    m, _ = forecast.backtest(_prep_events(spark, d), ["event_type"], _BT_H, ["naive", "seasonal_naive"])
    return _metrics6(m)


def _holdout_sql(key: str) -> str:
    chain = _backtest_sql(key)
    scored = chain[chain.index("tst AS"):chain.index("fagg AS")].rstrip().rstrip(",")
    return f"""
stats AS (SELECT {key}, count(*) AS n, max(season) AS season, bool_and(use_log) AS use_log, min(y_raw) >= 0 AS non_negative
          FROM prep GROUP BY {key}),
mods AS (SELECT * FROM (VALUES ('naive'), ('seasonal_naive')) t(model)),
ho AS (SELECT s.*, m.model, 0 AS fold, CAST(n - round_even(n * 0.3, 0) AS INTEGER) AS test_start,
         CASE WHEN m.model = 'seasonal_naive' THEN greatest(6, 2 * s.season) ELSE 3 END AS min_hist FROM stats s, mods m),
fo2 AS (SELECT *, least({_BT_H}, n - test_start) AS bt_h, test_start + least({_BT_H}, n - test_start) AS test_end
        FROM ho WHERE test_start >= min_hist),
{scored}"""


@register("q_holdout", f"""
WITH {_prep_sql('events', 'event_type', 'ts', 'value')}, {_holdout_sql('event_type')}
SELECT event_type, model, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(wape, 6) AS wape, round(mase, 6) AS mase FROM fm
""")
def q_holdout(spark, d):
    """Holdout errors of the baselines on the first points of each series' newest 30 %."""
    h = forecast.holdout(_prep_events(spark, d), ["event_type"], _BT_H, ["naive", "seasonal_naive"])
    return _metrics6(h.select("event_type", "model", *forecast.SELECTION_METRICS))


@register("q_rank_models", f"""
WITH {_prep_sql('events', 'event_type', 'ts', 'value')}, {_backtest_sql('event_type')},
ok AS (SELECT *, CASE model WHEN 'naive' THEN 0 WHEN 'seasonal_naive' THEN 1 ELSE 9 END AS mi FROM bt WHERE status = 'ok'),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY mae, mi) AS rank_mae,
          row_number() OVER (PARTITION BY event_type ORDER BY rmse, mi) AS rank_rmse,
          row_number() OVER (PARTITION BY event_type ORDER BY wape, mi) AS rank_wape,
          row_number() OVER (PARTITION BY event_type ORDER BY mase, mi) AS rank_mase FROM ok),
a AS (SELECT *, (rank_mae + rank_rmse + rank_wape + rank_mase) / 4.0 AS avg_rank FROM r)
SELECT event_type, model, CAST(rank_mae AS INTEGER) AS rank_mae, CAST(rank_rmse AS INTEGER) AS rank_rmse,
       CAST(rank_wape AS INTEGER) AS rank_wape, CAST(rank_mase AS INTEGER) AS rank_mase, avg_rank,
       row_number() OVER (PARTITION BY event_type ORDER BY avg_rank, mae, mi) = 1 AS is_best
FROM a
""")
def q_rank_models(spark, d):
    """Average-rank model selection per event type."""
    m, _ = forecast.backtest(_prep_events(spark, d), ["event_type"], _BT_H, ["naive", "seasonal_naive"])
    r = forecast.rank_models(m, ["event_type"])
    return r.select("event_type", "model", *[F.col(f"rank_{x}").cast("int").alias(f"rank_{x}") for x in forecast.SELECTION_METRICS],
                    "avg_rank", "is_best")


# W5–W7, W12 ---------------------------------------------------------------
_LAGS = [1, 2, 3, 7, 14, 21]


def _lag_sql() -> str:
    w = "OVER (PARTITION BY event_type ORDER BY ts)"
    n = f"(count(y) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
    cols = [f"CASE WHEN {n} >= {k} THEN lag(y, {k}) {w} ELSE 0.0 END AS lag_{k}" for k in _LAGS]
    cols.append(f"CASE WHEN {n} >= 7 THEN lag(y, 7) {w} ELSE 0.0 END AS lag_season")
    for k in (3, 7, 14, 30):
        cols.append(f"round(CASE WHEN {n} >= {k} THEN avg(y) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) ELSE 0.0 END, 6) AS rolling_mean_{k}")
    for k in (3, 7):
        cols.append(f"round(CASE WHEN {n} >= {k} THEN stddev_samp(y) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) ELSE 0.0 END, 6) AS rolling_std_{k}")
    base = ", ".join(cols)
    return f"""
WITH {_prep_sql('events', 'event_type', 'ts', 'value')},
f AS (SELECT event_type, ts, y, {n} AS n_past, {base} FROM prep)
SELECT event_type, ts, y, lag_1, lag_2, lag_3, lag_7, lag_14, lag_21, lag_season,
  CASE WHEN n_past >= 2 THEN lag_1 - lag_2 ELSE 0.0 END AS diff_1,
  round(CASE WHEN n_past >= 2 AND abs(lag_2) > 1e-9 THEN (lag_1 - lag_2) / abs(lag_2) ELSE 0.0 END, 6) AS pct_change_1,
  round(CASE WHEN n_past >= 7 AND abs(lag_7) > 1e-9 THEN (lag_1 - lag_7) / abs(lag_7) ELSE 0.0 END, 6) AS pct_change_7,
  round(CASE WHEN n_past >= 14 AND abs(lag_14) > 1e-9 THEN (lag_1 - lag_14) / abs(lag_14) ELSE 0.0 END, 6) AS pct_change_14,
  rolling_mean_3, rolling_mean_7, rolling_mean_14, rolling_mean_30, rolling_std_3, rolling_std_7,
  month(ts) AS month, quarter(ts) AS quarter, isodow(ts) - 1 AS weekday, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend,
  CAST(day(ts) = 1 AS INTEGER) AS is_month_start, CAST(CAST(ts AS DATE) = last_day(ts) AS INTEGER) AS is_month_end,
  dayofyear(ts) AS day_of_year
FROM f"""


_LAG_COLS = (["event_type", "ts", "y"] + [f"lag_{k}" for k in _LAGS] + ["lag_season", "diff_1"]
             + ["pct_change_1", "pct_change_7", "pct_change_14"]
             + [f"rolling_mean_{k}" for k in (3, 7, 14, 30)] + ["rolling_std_3", "rolling_std_7"]
             + ["month", "quarter", "weekday", "is_weekend", "is_month_start", "is_month_end", "day_of_year"])
_ROUND6 = {"pct_change_1", "pct_change_7", "pct_change_14", "rolling_mean_3", "rolling_mean_7", "rolling_mean_14",
           "rolling_mean_30", "rolling_std_3", "rolling_std_7"}


@register("q_lag_features", _lag_sql())
def q_lag_features(spark, d):
    """Past-only lag, rolling, change and calendar features per event type."""
    f = series.lag_features(_prep_events(spark, d), ["event_type"])
    return f.select(*[F.round(c, 6).alias(c) if c in _ROUND6 else F.col(c) for c in _LAG_COLS])


def _ewm_sql() -> str:
    part = "PARTITION BY event_type ORDER BY ts"
    tau = "CAST(6.283185307179586 AS DOUBLE)"

    def ewm(a: str) -> str:
        num = f"list_sum(list_transform(h, lambda v, i: v * pow(1 - {a}, i - 1)))"
        den = f"list_sum(list_transform(h, lambda v, i: pow(1 - {a}, i - 1)))"
        return f"CASE WHEN n >= 2 THEN {num} / {den} ELSE l1 END"

    return f"""
WITH {_prep_sql('events', 'event_type', 'ts', 'value')},
f AS (SELECT event_type, ts, y,
        count(y) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n,
        list_reverse(list(y) OVER ({part} ROWS BETWEEN 166 PRECEDING AND 1 PRECEDING)) AS h,
        regr_slope(y, x) OVER ({part} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS slope,
        lag(y, 1) OVER ({part}) AS lag1
      FROM (SELECT *, CAST(row_number() OVER ({part}) AS DOUBLE) AS x FROM prep)),
e AS (SELECT *, CASE WHEN n >= 1 THEN lag1 ELSE 0.0 END AS l1,
        CAST(2.0 AS DOUBLE) / (least(5, n) + 1) AS a5, CAST(2.0 AS DOUBLE) / (least(12, n) + 1) AS a12 FROM f),
g AS (SELECT *, {ewm('a5')} AS ewm_5, {ewm('a12')} AS ewm_12 FROM e)
SELECT event_type, ts, round(ewm_5, 6) AS ewm_5, round(ewm_12, 6) AS ewm_12, round(ewm_5 - ewm_12, 6) AS ewm_diff,
  round(CASE WHEN n >= 7 THEN slope ELSE 0.0 END, 6) AS trend_slope_7,
  round(sin({tau} * dayofyear(ts) / CAST(365.25 AS DOUBLE)), 6) AS sin_yearly,
  round(cos({tau} * dayofyear(ts) / CAST(365.25 AS DOUBLE)), 6) AS cos_yearly,
  round(sin({tau} * (isodow(ts) - 1) / CAST(7 AS DOUBLE)), 6) AS sin_weekly,
  round(cos({tau} * (isodow(ts) - 1) / CAST(7 AS DOUBLE)), 6) AS cos_weekly
FROM g"""


@register("q_ewm_slope", _ewm_sql())
def q_ewm_slope(spark, d):
    """Exponentially weighted means, 7-point slope and sine-cosine terms (6 decimals)."""
    f = series.lag_features(_prep_events(spark, d), ["event_type"])
    cols = ["ewm_5", "ewm_12", "ewm_diff", "trend_slope_7", "sin_yearly", "cos_yearly", "sin_weekly", "cos_weekly"]
    return f.select("event_type", "ts", *[F.round(c, 6).alias(c) for c in cols])


# T27 ----------------------------------------------------------------------
@register("q_future", f"""
WITH {_prep_sql('events', 'event_type', 'ts', 'value')}
SELECT event_type, CAST(s AS INTEGER) AS step, CAST(max(ts) + s * INTERVAL 1 DAY AS TIMESTAMP) AS ts
FROM prep, range(1, 15) t(s) GROUP BY event_type, s
""")
def q_future(spark, d):
    """Next 14 daily timestamps per event type."""
    return series.future(_prep_events(spark, d), ["event_type"], 14)


# T28 ----------------------------------------------------------------------
@register("q_split", f"""
WITH g AS (SELECT date_trunc('day', o_orderdate) AS ts, CAST(SUM(CAST(o_totalprice AS DECIMAL(38,2))) AS DOUBLE) AS y
           FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM g)
SELECT ts, y, CASE WHEN pos < floor(n * 0.7) THEN 'train' WHEN pos < floor(n * CAST(0.85 AS DOUBLE)) THEN 'validation'
                   ELSE 'test' END AS split FROM r
""")
def q_split(spark, d):
    """Chronological 70/15/15 split of daily revenue."""
    o = table(spark, d, "orders").where(F.col("o_orderdate").isNotNull())
    g = o.groupBy(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("ts")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(38,2)")).cast("double").alias("y"))
    return series.chronological_split(g.withColumn("series", F.lit("all")), ["series"]).select("ts", "y", "split")


# T26 ----------------------------------------------------------------------
@register("q_accuracy", f"""
WITH {_prep_sql('events', 'event_type', 'ts', 'value')},
n AS (SELECT event_type, count(*) AS n FROM prep GROUP BY 1),
tr AS (SELECT p.* FROM prep p JOIN n USING (event_type) WHERE p.pos < n.n - 7),
last AS (SELECT event_type, max_by(y, ts) AS v, max(ts) AS t FROM tr GROUP BY 1),
pr AS (SELECT event_type, t + s * INTERVAL 1 DAY AS ts, v AS predicted FROM last, range(1, 8) r(s)),
j AS (SELECT pr.event_type, pr.ts, pr.predicted, p.y AS actual FROM pr JOIN prep p USING (event_type, ts))
SELECT event_type, count(*) AS n, round(avg(abs(actual - predicted)), 6) AS mae,
       round(sqrt(avg(abs(actual - predicted) * abs(actual - predicted))), 6) AS rmse,
       round(avg(CASE WHEN actual <> 0 THEN abs(actual - predicted) / abs(actual) * 100 END), 6) AS mape,
       round(sum(abs(actual - predicted)) / sum(abs(actual)), 6) AS wape
FROM j GROUP BY 1
""")
def q_accuracy(spark, d):
    """Naive forecast of the last 7 days vs actuals per event type."""
    prep = _prep_events(spark, d)
    n = F.count(F.lit(1)).over(Window.partitionBy("event_type"))
    train = prep.withColumn("_n", n).where(F.col("pos") < F.col("_n") - 7).drop("_n")
    pred = forecast.forecast_baseline(train, ["event_type"], "naive", 7)
    _, summ = forecast.accuracy(pred, prep, ["event_type"])
    return summ.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "mape", "wape")])


# T10–T25 end to end -------------------------------------------------------
@register("q_forecast")
def q_forecast(spark, d):
    """Fast-mode forecast (naive, seasonal naive, Holt-Winters) of daily value per event type."""
    fc, _ = forecast.run(table(spark, d, "events"), "ts", "value", ["event_type"], horizon=7, mode="fast", scale=2)
    return fc


@register("q_forecast_log")
def q_forecast_log(spark, d):
    """Per-series model log with holdout diagnosis and confidence."""
    _, log = forecast.run(table(spark, d, "events"), "ts", "value", ["event_type"], horizon=7,
                          models=["naive", "seasonal_naive", "fourier_ls"], scale=2)
    return log.select("event_type", "model", "mae", "rmse", "wape", "mase", "avg_rank", "is_best", "test_mae",
                      "fit_diagnosis", "best_model", "ensemble_partner", "confidence", "repetitive", "wide_intervals")


@register("q_forecast_gbt")
def q_forecast_gbt(spark, d):
    """Weekly order value per priority with the global boosted-tree lag model in the competition."""
    fc, _ = forecast.run(table(spark, d, "orders"), "o_orderdate", "o_totalprice", ["o_orderpriority"], horizon=14,
                         models=["naive", "seasonal_naive", "gbt_lag"], freq="W", scale=2)
    return fc


@register("q_forecast_boost")
def q_forecast_boost(spark, d):
    """Weekly order value per priority by boosted trees with 10/90 bounds, the number of orders as a held column."""
    orders = table(spark, d, "orders").withColumn("n_orders", F.lit(1.0))
    fc, _ = forecast.run(orders, "o_orderdate", "o_totalprice", ["o_orderpriority"], horizon=14,
                         models=["naive", "boost_lag"], freq="W", features=["n_orders"], scale=2)
    return fc
