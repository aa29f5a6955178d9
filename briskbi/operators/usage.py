"""Usage and run statistics over log tables.

Logs are ordinary DataFrames (read with ``sources.files.read_log`` or any
table); every statistic is a ``groupBy`` with conditional aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAILY_CHAR_CAP = 50_000


def daily_usage(log: DataFrame, user: str, ts: str, chars: str, cost: str | None = None,
                cap: int = DAILY_CHAR_CAP) -> DataFrame:
    """Characters (and cost) per user per UTC day, flagged above ``cap``."""
    aggs = [F.sum(F.col(chars)).alias("chars"), F.count(F.lit(1)).alias("entries")]
    if cost:
        aggs.append(F.sum(F.col(cost)).alias("cost"))
    g = log.groupBy(F.col(user).alias("user"), F.to_date(F.col(ts)).alias("day")).agg(*aggs)
    return g.withColumn("over_cap", F.col("chars") > cap)


def usage_summary(log: DataFrame, kind: str, error: str | None = None, amount: str | None = None) -> DataFrame:
    """Per kind, entries, errors and amount in one conditional aggregate."""
    aggs = [F.count(F.lit(1)).alias("entries")]
    if error:
        aggs.append(F.count(F.when(F.col(error), 1)).alias("errors"))
    if amount:
        aggs.append(F.sum(F.col(amount)).alias("amount"))
    return log.groupBy(F.col(kind).alias("kind")).agg(*aggs)


def model_family(model: str = "model"):
    """Ensemble labels ``a+b`` count for their first model."""
    return F.split(F.col(model), r"\+").getItem(0)


def run_stats(runs: DataFrame, user: str, model: str, mae: str, created: str, latest: int = 5) -> tuple[DataFrame, DataFrame]:
    """Per user run count, average MAE, most common model family, newest runs.

    Returns (summary, latest) with ``latest`` newest runs per user.
    """
    fam = runs.withColumn("family", model_family(model))
    dist = fam.groupBy(user, "family").agg(F.count(F.lit(1)).alias("runs"))
    w = Window.partitionBy(user).orderBy(F.col("runs").desc(), F.col("family"))
    top = dist.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(user, F.col("family").alias("most_common_model"))
    summ = fam.groupBy(user).agg(F.count(F.lit(1)).alias("runs"), F.avg(mae).alias("avg_mae")).join(top, user, "left")
    wl = Window.partitionBy(user).orderBy(F.col(created).desc())
    newest = fam.withColumn("_r", F.row_number().over(wl)).where(F.col("_r") <= latest).drop("_r")
    return summ, newest


def model_category_stats(runs: DataFrame, datasets: DataFrame, key: str, category: str, model: str,
                         wape: str) -> DataFrame:
    """Per (category, model) wins, average accuracy (1 − WAPE)·100 and win rate.

    Runs join their dataset's category (inner: unmatched runs are skipped).
    """
    j = runs.join(datasets.select(key, category), key)
    g = j.groupBy(category, F.col(model).alias("model")).agg(
        F.count(F.lit(1)).alias("wins"), F.avg((1 - F.col(wape)) * 100).alias("avg_accuracy"))
    tot = F.sum("wins").over(Window.partitionBy(category))
    r = g.withColumn("win_rate", F.col("wins") / tot * 100)
    wr = Window.partitionBy(category).orderBy(F.col("wins").desc(), F.col("model"))
    return r.withColumn("rank", F.row_number().over(wr))
