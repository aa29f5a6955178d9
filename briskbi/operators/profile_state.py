"""A profile kept up to date batch by batch, without reading earlier rows again.

Every batch leaves two small tables under the state's folder: per column its counts, moments and ranges,
and its value counts.  Counts add up, ranges widen and moments merge exactly, so the profile of the state equals
the profile of all rows at once.  A batch that is tried again replaces its own tables; a batch whose
columns or types differ from the first one's fails before anything is written.

Layout: ``counts/batch=<n>`` (written first) and ``stats/batch=<n>``; a batch without stats is not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briskbi.functions.labels import ts_text
from briskbi.functions.parse import to_number, to_timestamp_mixed
from briskbi.operators.summaries import detect_types, quoted

_STATS = ("position int, column string, kind string, data_type string, rows long, nulls long, n long, mean double, m2 double, "
          "min double, max double, first timestamp, last timestamp, length long")


def known_columns(spark: SparkSession, path: str) -> list | None:
    """(column, Spark type, profile type) in order as of the first batch, None without one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/stats")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    seen = spark.read.parquet(f"{path}/stats").groupBy("position").agg(F.min_by(F.struct("column", "kind", "data_type"), "batch").alias("c"))
    return [tuple(r["c"]) for r in seen.orderBy("position").collect()] or None


def check_schema(df: DataFrame, known: list) -> None:
    """Raises for a batch whose columns (in any order) or types are not the known ones."""
    wanted, got = {c: k for c, k, _ in known}, {f.name: f.dataType.simpleString() for f in df.schema}
    if wanted != got:
        wrong = sorted(c for c in wanted.keys() | got.keys() if wanted.get(c) != got.get(c))
        raise ValueError("schema mismatch: " + ", ".join(f"{c} {wanted.get(c)} -> {got.get(c)}" for c in wrong))


def _stats(df: DataFrame, types: dict[str, str]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, (c, t) in enumerate(types.items()):
        cell, kind = quoted(c), df.schema[c].dataType
        aggs.append(F.count(cell).alias(f"given{i}"))
        if t == "numeric":
            v = to_number(cell, kind).cast("double")
            aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"mean{i}"), (F.var_pop(v) * F.count(v)).alias(f"m2{i}"), F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}")]
        elif t == "datetime":
            ts = to_timestamp_mixed(cell, kind).cast("timestamp")
            aggs += [F.min(ts).alias(f"first{i}"), F.max(ts).alias(f"last{i}")]
        elif t == "text":
            aggs.append(F.sum(F.length(cell.cast("string"))).alias(f"length{i}"))
    wide = df.agg(*aggs)

    def stat(name: str, i: int, kind: str):
        return (F.col(f"{name}{i}") if f"{name}{i}" in wide.columns else F.lit(None)).cast(kind).alias(name)

    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("kind"), F.lit(t).alias("data_type"),
                     F.col("rows"), (F.col("rows") - F.col(f"given{i}")).alias("nulls"), stat("n", i, "long"), stat("mean", i, "double"), stat("m2", i, "double"),
                     stat("min", i, "double"), stat("max", i, "double"), stat("first", i, "timestamp"), stat("last", i, "timestamp"), stat("length", i, "long"))
            for i, (c, t) in enumerate(types.items())]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def update(df: DataFrame, path: str, batch_id: int, types: dict[str, str] | None = None) -> None:
    """Adds a batch to the state; types of text columns are those found in the first batch, or ``types``."""
    spark, path = df.sparkSession, path.rstrip("/")
    known = known_columns(spark, path)
    if known:
        check_schema(df, known)
        types = {c: t for c, _, t in known}
    types = types or detect_types(df)
    cells = df.select(F.posexplode(F.array(*[quoted(c).cast("string") for c in types])).alias("position", "value")).where(F.col("value").isNotNull())
    counts = cells.groupBy("position", "value").agg(F.count(F.lit(1)).alias("count"))
    counts.write.mode("overwrite").parquet(f"{path}/counts/batch={batch_id}")
    _stats(df, types).write.mode("overwrite").parquet(f"{path}/stats/batch={batch_id}")


def profile(spark: SparkSession, path: str, k: int = 5) -> DataFrame:
    """The columns of ``summaries.profile``, over all batches of the state."""
    path = path.rstrip("/")
    stats = spark.read.schema(f"{_STATS}, batch long").parquet(f"{path}/stats")
    whole = Window.partitionBy("position")
    mean = F.sum(F.col("mean") * F.col("n")).over(whole) / F.nullif(F.sum("n").over(whole), F.lit(0))
    merged = stats.withColumn("all", mean).groupBy("position").agg(
        F.min_by(F.struct("column", "data_type"), "batch").alias("c"), F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.sum("n").alias("n"),
        F.first("all").alias("mean"), F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("all")) ** 2).alias("m2"),
        *[F.min(c).alias(c) for c in ("min", "first")], *[F.max(c).alias(c) for c in ("max", "last")], F.sum("length").alias("length"))
    done = F.broadcast(stats.select("batch").distinct())  # one number a batch
    counts = spark.read.schema("position int, value string, count long, batch long").parquet(f"{path}/counts").join(done, "batch", "left_semi")
    counts = counts.groupBy("position", "value").agg(F.sum("count").alias("count"))
    order = Window.partitionBy("position").orderBy(F.col("count").desc(), F.col("value").asc())
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy("position").agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("t"))
    distinct = counts.groupBy("position").agg(F.count(F.lit(1)).alias("nunique"))
    # All three have one row per column.
    out = merged.join(F.broadcast(distinct), "position", "left").join(F.broadcast(top), "position", "left")
    share = lambda c: F.round(F.coalesce(c, F.lit(0)) / F.greatest("rows", F.lit(1)), 4)
    filled = F.col("rows") - F.col("nulls")
    length = F.coalesce(F.try_divide(F.col("length"), filled), F.lit(0.0))
    return out.select(
        "c.column", "c.data_type", share(F.col("nulls")).alias("null_ratio"), share(F.col("nunique")).alias("unique_ratio"),
        F.coalesce(F.transform("t", lambda s: s["value"]), F.array().cast("array<string>")).alias("top_5"), "min", "max", F.round("mean", 2).alias("mean"),
        F.round(F.sqrt(F.when(F.col("n") > 1, F.col("m2") / (F.col("n") - 1))), 2).alias("std_dev"), ts_text(F.col("first")).alias("min_date"), ts_text(F.col("last")).alias("max_date"),
        F.when(F.col("c.data_type") == "text", F.round(length, 1)).alias("avg_char_length"))
