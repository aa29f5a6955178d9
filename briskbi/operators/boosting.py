"""Boosted trees of one series with quantile bounds and exogenous columns.

A prepared series has one row per period (1,200 at most), so its trees are fitted inside the
grouped task that holds it; Spark deals the series out.  The expected value comes from trees on the
squared loss, the bounds from trees on the pinball loss: a tree is grown on the loss's slope and
each leaf is then refilled with the quantile of its residuals.  Nothing is drawn at random,
so a fit repeats exactly.

Features see only what precedes a period (W5-W9), its calendar (W12) and exogenous columns.  The horizon is
recursive: each predicted value joins the history of the next step.  Columns known ahead take their
values at the predicted period, all others stay at their last training value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd

#: Size of a fit: trees, their depth, learning rate, bins of a feature, rows a leaf has at least.
TREES, DEPTH, RATE, BINS, LEAF = 80, 3, 0.1, 32, 5


@dataclass
class Trees:
    """Complete binary trees in arrays: the split of each inner node, the value of each leaf."""

    base: float
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        tree = np.arange(len(self.leaf))
        for i, row in enumerate(x):
            at = np.zeros(len(tree), int)
            for depth in range(int(np.log2(self.leaf.shape[1]))):
                node = (1 << depth) - 1 + at
                at = 2 * at + (row[self.feature[tree, node]] > self.limit[tree, node])
            out[i] += self.leaf[tree, at].sum()
        return out


def boost(x: np.ndarray, y: np.ndarray, quantile: float | None = None, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, least: int = LEAF) -> Trees:
    """Trees for the mean of ``y``, or for its ``quantile`` (pinball loss)."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    base = float(y.mean() if quantile is None else np.quantile(y, quantile))
    feature, limit = np.zeros((trees, (1 << depth) - 1), int), np.full((trees, (1 << depth) - 1), np.inf)
    leaf, now = np.zeros((trees, 1 << depth)), np.full(n, base)
    columns = np.arange(width) * BINS
    for t in range(trees):
        rest = y - now
        slope = rest if quantile is None else np.where(rest > 0, quantile, quantile - 1.0)
        at = np.zeros(n, int)
        for d in range(depth):
            cell = (at[:, None] * width * BINS + columns + binned).ravel()
            shape = (1 << d, width, BINS)
            total = np.bincount(cell, np.repeat(slope, width), minlength=np.prod(shape)).reshape(shape)
            count = np.bincount(cell, minlength=np.prod(shape)).reshape(shape)
            left, held = total.cumsum(2)[:, :, :-1], count.cumsum(2)[:, :, :-1]
            right, other = total.sum(2, keepdims=True) - left, count.sum(2, keepdims=True) - held
            fits = (held >= least) & (other >= least)
            gain = np.where(fits, left**2 / np.maximum(held, 1) + right**2 / np.maximum(other, 1), -np.inf).reshape(1 << d, -1)
            best = gain.argmax(1)
            whole, rows = total[:, 0].sum(1), np.maximum(count[:, 0].sum(1), 1)
            splits = gain[np.arange(1 << d), best] > whole**2 / rows + 1e-12
            f, b = best // (BINS - 1), best % (BINS - 1)
            feature[t, (1 << d) - 1 : (2 << d) - 1] = f
            limit[t, (1 << d) - 1 : (2 << d) - 1] = [edges[i][min(j, len(edges[i]) - 1)] if s else np.inf for i, j, s in zip(f, b, splits, strict=True)]
            at = 2 * at + (splits[at] & (binned[np.arange(n), f[at]] > b[at]))
        for k in np.unique(at):
            inside = rest[at == k]
            leaf[t, k] = rate * (inside.mean() if quantile is None else np.quantile(inside, quantile))
        now += leaf[t, at]
    return Trees(base, feature, limit, leaf)


def past_features(y: np.ndarray, season: int) -> list[float]:
    """Lags, changes, rolling and weighted means and the slope of what precedes a period; 0 where history is short."""
    n = len(y)
    lag = {k: float(y[-k]) if n >= k else 0.0 for k in (1, 2, 3, 7, 14, 21, season)}
    change = [(lag[1] - lag[k]) / abs(lag[k]) if n >= k and abs(lag[k]) > 1e-9 else 0.0 for k in (2, 7, 14)]
    means = [float(y[-k:].mean()) if n >= k else 0.0 for k in (3, 7, 14, 30)]
    spread = [float(y[-k:].std(ddof=1)) if n >= k else 0.0 for k in (3, 7)]
    weighted = [lag[1], lag[1]]
    if n >= 2:
        recent = y[::-1][:166]
        for i, span in enumerate((5, 12)):
            share = (1 - 2 / (min(span, n) + 1)) ** np.arange(len(recent))
            weighted[i] = float(recent @ share / share.sum())
    slope = float((np.arange(7) - 3.0) @ y[-7:] / 28) if n >= 7 else 0.0
    return [lag[1], lag[2], lag[3], lag[7], lag[14], lag[21], lag[season], lag[1] - lag[2] if n >= 2 else 0.0, *change, *means, *spread, *weighted, weighted[0] - weighted[1], slope]


def calendar(ts: pd.Series) -> np.ndarray:
    t = pd.DatetimeIndex(ts)
    day, year = t.weekday.to_numpy(), 2 * np.pi * t.dayofyear.to_numpy() / 365.25
    week = 2 * np.pi * day / 7
    return np.column_stack([t.month, t.quarter, day, day >= 5, t.is_month_start, t.is_month_end, t.dayofyear, np.sin(year), np.cos(year), np.sin(week), np.cos(week)]).astype(float)


def _as_number(values: pd.Series, n: int) -> np.ndarray:
    """An exogenous column as numbers: text by its place among the values of the first ``n`` rows, others -1; nulls 0."""
    if pd.api.types.is_numeric_dtype(values) or pd.api.types.is_bool_dtype(values):
        return np.nan_to_num(values.astype(float).to_numpy(), posinf=0.0, neginf=0.0)
    shown = values.astype("string")
    number = pd.to_numeric(shown, errors="coerce")
    if number.notna().sum() == shown.notna().sum():
        return np.nan_to_num(number.astype(float).to_numpy(), posinf=0.0, neginf=0.0)
    place = {v: i + 1.0 for i, v in enumerate(sorted(shown[:n].dropna().unique()))}
    return np.array([0.0 if pd.isna(v) else place.get(v, -1.0) for v in shown])


class LagTable:
    """Examples of one series.  ``rows`` are in time order; rows after the last value of y are future periods."""

    def __init__(self, rows: pd.DataFrame, season: int, features: Sequence[str] = (), known: Sequence[str] = ()):
        y = rows["y"].to_numpy(dtype=float)
        self.n = int(np.isfinite(y).sum())
        self.y, self.season = y[: self.n], season
        self.past = np.array([past_features(self.y[:i], season) for i in range(self.n)])
        self.calendar = calendar(rows["ts"])
        self.exog = np.column_stack([_as_number(rows[c], self.n) for c in features]) if features else np.zeros((len(rows), 0))
        self.known = np.array([c in known for c in features], bool)

    def forecast(self, start: int, horizon: int, quantiles: Sequence[float] = (), window: int | None = None) -> np.ndarray:
        """(horizon, 1 + quantiles): the expected value and each quantile, learned from the periods before ``start``."""
        first = max(3, min(7, self.season), start - window if window else 0)
        rows = np.arange(first, start)
        if len(rows) < 2 * LEAF:
            raise ValueError("insufficient_train_rows")
        x = np.hstack([self.past[rows], self.calendar[rows], self.exog[rows]])
        fits = [boost(x, self.y[rows], q) for q in (None, *quantiles)]
        history, out = self.y[:start].tolist(), np.zeros((horizon, len(fits)))
        for i in range(horizon):
            ahead = np.where(self.known, self.exog[start + i], self.exog[start - 1])
            row = np.concatenate([past_features(np.array(history), self.season), self.calendar[start + i], ahead])[None]
            out[i] = [f.predict(row)[0] for f in fits]
            history.append(out[i, 0])
        return out
