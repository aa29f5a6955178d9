"""Boosted trees of a series: splits against brute force, quantile coverage, exogenous columns."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from briskbi.operators import boosting, forecast
from briskbi.operators import series as S


def test_first_split_is_the_best_one():
    rng = np.random.default_rng(1)
    for quantile in (None, 0.9):
        x = rng.integers(0, 12, (60, 3)).astype(float)
        y = np.where(x[:, 1] > 6, 5.0, 0.0) + rng.normal(0, 1, 60)
        made = boosting.boost(x, y, quantile, trees=1, depth=1, rate=1.0, least=5)
        rest = y - (y.mean() if quantile is None else np.quantile(y, quantile))
        slope = rest if quantile is None else np.where(rest > 0, quantile, quantile - 1)
        tried = []
        for f in range(3):
            for cut in np.unique(x[:, f]):
                left = x[:, f] <= cut
                if min(left.sum(), (~left).sum()) >= 5:
                    tried.append((slope[left].sum() ** 2 / left.sum() + slope[~left].sum() ** 2 / (~left).sum(), f, cut))
        best = max(tried)
        left = x[:, made.feature[0, 0]] <= made.limit[0, 0]
        got = slope[left].sum() ** 2 / left.sum() + slope[~left].sum() ** 2 / (~left).sum()
        assert got == pytest.approx(best[0])
        refill = (lambda v: v.mean()) if quantile is None else (lambda v: np.quantile(v, quantile))
        assert made.leaf[0] == pytest.approx([refill(rest[left]), refill(rest[~left])])
        assert made.predict(x) == pytest.approx(made.base + np.where(left, made.leaf[0, 0], made.leaf[0, 1]))


def test_quantiles_cover_their_share():
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, (3000, 2))
    y = 10 * x[:, 0] + rng.normal(0, 1 + 2 * x[:, 1], 3000)
    fresh = rng.uniform(0, 1, (3000, 2))
    seen = 10 * fresh[:, 0] + rng.normal(0, 1 + 2 * fresh[:, 1], 3000)
    low, high = (boosting.boost(x, y, q).predict(fresh) for q in (0.1, 0.9))
    assert abs(np.mean(seen < low) - 0.1) < 0.04 and abs(np.mean(seen > high) - 0.1) < 0.04
    wide = high - low
    assert wide[fresh[:, 1] > 0.8].mean() > 1.5 * wide[fresh[:, 1] < 0.2].mean()  # the bounds follow the noise


def _prep(spark, n, price=None):
    days = [dt.datetime(2022, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    rng = np.random.default_rng(3)
    price = price if price is not None else rng.uniform(0, 10, n + 14)
    rows = [(f"s{k}", days[i], float(50 + 8 * price[i] + k + rng.normal(0, 1)), float(price[i]), "odd" if i % 2 else "even") for i in range(n) for k in range(2)]
    return spark.createDataFrame(rows, "shop string, day timestamp_ntz, y double, price double, kind string"), price, days


def test_past_features_equal_the_window_version(spark):
    df, _, _ = _prep(spark, 80)
    prep = S.prepare(df, "day", "y", ["shop"], "D")
    rows = S.lag_features(prep, ["shop"]).where("shop = 's0'").orderBy("pos").toPandas()
    y = rows["y"].to_numpy()
    for i in (0, 1, 2, 6, 7, 20, 40, 79):
        assert boosting.past_features(y[:i], 7) == pytest.approx(rows.loc[i, forecast.GBT_LAG_FEATURES].astype(float).tolist(), abs=1e-8)
    assert boosting.calendar(rows["ts"]) == pytest.approx(rows[forecast.GBT_CALENDAR].astype(float).to_numpy())


def test_bounds_exogenous_columns_and_repeatability(spark):
    df, price, days = _prep(spark, 200)
    horizon = 10
    ahead = spark.createDataFrame([(f"s{k}", days[-1] + dt.timedelta(days=i + 1), float(price[200 + i])) for i in range(horizon) for k in range(2)], "shop string, ts timestamp_ntz, price double")
    truth = np.array([50 + 8 * price[200 + i] for i in range(horizon)])

    def run(known):
        fc, log = forecast.run(df, "day", "y", ["shop"], horizon=horizon, models=["naive", "boost_lag"], freq="D", features=["price", "kind"], known_ahead=known)
        return fc.orderBy("shop", "step").toPandas(), log

    told, log = run(ahead)
    again, _ = run(ahead)
    pd.testing.assert_frame_equal(told, again)
    held, _ = run(None)
    assert set(log.where("is_best").select("model").toPandas()["model"]) == {"boost_lag"}
    error = lambda fc: np.abs(fc[fc.shop == "s0"]["value"].to_numpy() - truth).mean()
    assert error(told) < 6 < error(held)
    one = told[told.shop == "s0"]
    assert (one.lower <= one.value).all() and (one.value <= one.upper).all()
    assert not np.allclose(one.upper - one.value, one.value - one.lower)  # quantile trees, not a symmetric width
    inside = (truth >= one.lower.to_numpy()) & (truth <= one.upper.to_numpy())
    assert inside.mean() >= 0.5


def test_training_window_and_failed_fits(spark):
    df, _, _ = _prep(spark, 60)
    level = df.withColumn("y", F.when(F.col("day") < "2022-02-01", 1000.0).otherwise(10.0))
    prep = S.prepare(level, "day", "y", ["shop"], "D", log_transform=False)
    late, _ = forecast.backtest(prep, ["shop"], 5, ["fourier_ls"], screen_folds=1, train_window=12)
    whole, _ = forecast.backtest(prep, ["shop"], 5, ["fourier_ls"], screen_folds=1)
    assert late.agg(F.max("mae")).first()[0] < 1e-6 < whole.agg(F.max("mae")).first()[0]
    short, _ = forecast.backtest(prep, ["shop"], 5, ["boost_lag"], screen_folds=1, train_window=4)
    assert {r.status for r in short.collect()} == {"failed"}
    with pytest.raises(ValueError):
        boosting.LagTable(prep.where("shop = 's0'").orderBy("pos").toPandas().head(8), 7).forecast(8, 3)
