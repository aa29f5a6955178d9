"""Dataset summaries, profiling, quality, anomalies and correlations.

C17–C26, Q1–Q6, J5.  Wide statistics are one generated ``agg`` over all columns
(one scan); value counts group the unpivoted cells by column, hash and first
characters, and look up the texts of the few candidates only.  Per-column top-k
uses a rank limit (Spark plans a partial WindowGroupLimit before the shuffle, so a
hot column never ships all its values to one task).  Driver-side choices only read statistics rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from briskbi.functions.labels import compact_number, ts_text
from briskbi.functions.parse import to_number, to_timestamp_mixed
from briskbi.operators.ranking import global_order


def quoted(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def _unpivot(df: DataFrame, cols: list[str], value_type: str = "string") -> DataFrame:
    """(column, value) pairs for ``cols`` (one row per input row and column)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast(value_type).alias("value")) for c in cols])
    return df.select(F.explode(pairs).alias("kv")).select("kv.column", "kv.value")


#: Characters of a value that travel with its hash, and candidates up to which their table is broadcast (under 10 MB).
PREFIX, MOST_CANDIDATES = 16, 100_000


def _cells(df: DataFrame, cols: list[str]) -> DataFrame:
    """(i, value, hash, prefix): the non-null cells of ``cols`` as text, by column number."""
    cells = df.select(F.posexplode(F.array(*[quoted(c).cast("string") for c in cols])).alias("i", "value"))
    return cells.where(F.col("value").isNotNull()).select(
        "i", "value", F.xxhash64("value").alias("hash"), F.substring("value", 1, PREFIX).alias("prefix"))


def _frequent(df: DataFrame, cols: list[str], k: int) -> tuple[DataFrame, DataFrame]:
    """((i, nunique), (i, value, count, rank)): distinct values of each column and its ``k`` most frequent.

    Whole values are never shuffled.  A value is counted by its 64-bit hash with its first characters; the
    values that can be among the ``k`` first (by count, then by those characters, ties and all) are
    the candidates, and only their texts are looked up, in a second scan without a shuffle of the cells.
    """
    from briskbi.session import cut_lineage

    cells = _cells(df, cols)
    counts = cells.groupBy("i", "hash", "prefix").agg(F.count(F.lit(1)).alias("count"))
    first = Window.partitionBy("i").orderBy(F.col("count").desc(), F.col("prefix").asc())
    candidates = counts.withColumn("rank", F.rank().over(first)).where(F.col("rank") <= k).select("i", "hash", "prefix", "count")
    distinct = counts.groupBy("i").agg(F.lit(None).cast("long").alias("hash"), F.lit(None).cast("string").alias("prefix"), F.count(F.lit(1)).alias("count"))
    both = cut_lineage(candidates.unionByName(distinct))  # one job: the two branches share the counts
    candidates = both.where(F.col("hash").isNotNull())
    if candidates.count() <= MOST_CANDIDATES:
        candidates = F.broadcast(candidates)
    named = cells.join(candidates, ["i", "hash", "prefix"]).groupBy("i", "value").agg(F.max("count").alias("count"))
    order = Window.partitionBy("i").orderBy(F.col("count").desc(), F.col("value").asc())
    top = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return both.where(F.col("hash").isNull()).select("i", F.col("count").alias("nunique")), top


def _column_name(cols: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("i") + 1).alias("column")


def value_counts(df: DataFrame, cols: list[str], k: int | None = None) -> DataFrame:
    """(column, value, count, rank) for non-null values; rank by count desc, value asc."""
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, count long" + (", rank int" if k else ""))
    if k is None:
        return _unpivot(df, cols).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    return _frequent(df, cols, k)[1].select(_column_name(cols), "value", "count", "rank")


# ---------------------------------------------------------------------------
# C18–C21
# ---------------------------------------------------------------------------

def numeric_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per numeric column sum, mean, min, max, count (round 2) in one scan."""
    cols = cols or numeric_columns(df)
    aggs = []
    for c in cols:
        v = quoted(c).cast("double")
        aggs += [F.sum(v).alias(f"{c}__sum"), F.avg(v).alias(f"{c}__mean"), F.min(v).alias(f"{c}__min"),
                 F.max(v).alias(f"{c}__max"), F.count(v).alias(f"{c}__count")]
    wide = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.round(quoted(f"{c}__sum"), 2).alias("sum"),
                 F.round(quoted(f"{c}__mean"), 2).alias("mean"), F.round(quoted(f"{c}__min"), 2).alias("min"),
                 F.round(quoted(f"{c}__max"), 2).alias("max"), quoted(f"{c}__count").alias("count"))
        for c in cols
    ])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def top_values(df: DataFrame, cols: list[str] | None = None, k: int = 10, max_cols: int | None = None) -> DataFrame:
    """Top ``k`` value counts of every text column (of the first ``max_cols`` if given)."""
    cols = (cols or text_columns(df))[:max_cols]
    return value_counts(df, cols, k)


def date_range(df: DataFrame, col: str | None = None) -> DataFrame:
    """C20: earliest and latest value of the first datetime column."""
    col = col or (datetime_columns(df) or [None])[0]
    if col is None:
        return df.sparkSession.createDataFrame([], "column string, earliest timestamp, latest timestamp")
    return df.agg(F.lit(col).alias("column"), F.min(col).alias("earliest"), F.max(col).alias("latest"))


def ranked(df: DataFrame, num_cols: list[str] | None = None, cat_cols: list[str] | None = None,
           k: int = 10, ascending: bool = False, max_num: int | None = None, max_cat: int | None = None) -> DataFrame:
    """Top (or bottom) ``k`` group sums of every numeric × text column (of the first ``max_num`` × ``max_cat`` if given)."""
    num_cols = (num_cols or numeric_columns(df))[:max_num]
    cat_cols = (cat_cols or text_columns(df))[:max_cat]
    parts = []
    for cat in cat_cols:
        g = df.where(quoted(cat).isNotNull()).groupBy(quoted(cat).alias("label")).agg(
            *[F.sum(quoted(n).cast("double")).alias(n) for n in num_cols]
        )
        long = g.select(
            F.lit(cat).alias("dimension"), "label",
            F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), quoted(n).alias("value")) for n in num_cols])).alias("m"),
        ).select("dimension", "label", "m.measure", "m.value")
        parts.append(long)
    if not parts:
        return df.sparkSession.createDataFrame([], "dimension string, measure string, label string, value double, rank int")
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    order = F.col("value").asc() if ascending else F.col("value").desc()
    w = Window.partitionBy("dimension", "measure").orderBy(order, F.col("label").asc())
    return allp.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "dimension", "measure", "label", F.round("value", 2).alias("value"), "rank"
    )


# ---------------------------------------------------------------------------
# C17, C22, C23
# ---------------------------------------------------------------------------

def pick_dimensions(df: DataFrame, lo: int = 2, hi: int = 25) -> DataFrame:
    """C17: columns with ``lo``..``hi`` distinct values; text first, fewest first.

    An ``approx_count_distinct`` screen drops columns far above ``hi``; exact
    counts run only for the survivors.
    """
    cols = df.columns
    approx = df.agg(*[F.approx_count_distinct(quoted(c)).alias(c) for c in cols]).collect()[0].asDict()
    cand = [c for c in cols if approx[c] <= hi * 2 + 10]
    text = set(text_columns(df))
    if not cand:
        return df.sparkSession.createDataFrame([], "column string, n_distinct long, is_text boolean")
    exact = df.agg(*[F.count_distinct(quoted(c)).alias(c) for c in cand])
    long = exact.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), quoted(c).alias("n_distinct"), F.lit(c in text).alias("is_text"))
        for c in cand
    ])).alias("r")).select("r.*")
    return long.where((F.col("n_distinct") >= lo) & (F.col("n_distinct") <= hi))


# Name fragments that make a KPI card use the mean instead of the sum.
MEAN_NAME_HINTS = ["rate", "ratio", "ctr", "avg", "average", "percent", "pct", "score", "margin"]


def kpi_cards(df: DataFrame, top: int = 4, currency: bool = False) -> DataFrame:
    """Row count + the ``top`` of all numeric columns by |sum| (mean for rate-like names)."""
    cols = numeric_columns(df)
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for c in cols:
        aggs += [F.sum(quoted(c).cast("double")).alias(f"{c}__sum"), F.avg(quoted(c).cast("double")).alias(f"{c}__mean")]
    wide = df.agg(*aggs)
    cards = [F.struct(F.lit("rows").alias("name"), F.lit("count").alias("agg"),
                      F.col("__rows").cast("double").alias("value"), F.lit(1.0e300).alias("weight"))]
    for c in cols:
        use_mean = any(h in c.lower() for h in MEAN_NAME_HINTS)
        cards.append(F.struct(F.lit(c).alias("name"), F.lit("mean" if use_mean else "sum").alias("agg"),
                              quoted(f"{c}__mean" if use_mean else f"{c}__sum").alias("value"),
                              F.abs(quoted(f"{c}__sum")).alias("weight")))
    long = wide.select(F.explode(F.array(*cards)).alias("r")).select("r.*")
    w = Window.orderBy(F.col("weight").desc(), F.col("name"))  # one row per numeric column
    long = long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top + 1)
    return long.select("name", "agg", "value", compact_number(F.col("value"), currency).alias("display"), "rank")


def grouped_means(df: DataFrame, key: str, metrics: list[str], limit: int | None = None, agg: str = "mean") -> DataFrame:
    """Mean (or sum) of the metrics by ``key``; all keys, or the first ``limit`` in key order."""
    fn = F.sum if agg == "sum" else F.avg
    g = df.where(quoted(key).isNotNull()).groupBy(key).agg(*[fn(quoted(m).cast("double")).alias(m) for m in metrics])
    return g if limit is None else g.orderBy(key).limit(limit)


# ---------------------------------------------------------------------------
# C24, C25, C26 / J5
# ---------------------------------------------------------------------------

def zscore_anomalies(df: DataFrame, cols: list[str] | None = None, threshold: float = 2.5,
                     min_rows: int = 10) -> DataFrame:
    """Per column, count of |z| > threshold with the sample std.

    Pass 1 is one aggregate row (mean, std, n per column); pass 2 counts with the
    statistics as literals, so nothing is joined back to the data.
    """
    cols = cols or numeric_columns(df)
    aggs = []
    for c in cols:
        v = quoted(c).cast("double")
        aggs += [F.avg(v).alias(f"{c}__m"), F.stddev_samp(v).alias(f"{c}__s"), F.count(v).alias(f"{c}__n")]
    st = df.agg(*aggs).collect()[0].asDict() if cols else {}
    usable = [c for c in cols if (st[f"{c}__n"] or 0) >= min_rows and st[f"{c}__s"] not in (None, 0.0)
              and not math.isnan(st[f"{c}__s"])]
    schema = "column string, outlier_count long, total_rows long, percentage double, threshold double, mean double, std double"
    if not usable:
        return df.sparkSession.createDataFrame([], schema)
    counts = df.agg(*[
        F.count(F.when(F.abs((quoted(c).cast("double") - F.lit(st[f"{c}__m"])) / F.lit(st[f"{c}__s"])) > threshold, 1)).alias(c)
        for c in usable
    ])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), quoted(c).alias("outlier_count"), F.lit(st[f"{c}__n"]).cast("long").alias("total_rows"),
                 F.round(quoted(c) / F.lit(st[f"{c}__n"]) * 100, 2).alias("percentage"),
                 F.lit(threshold).alias("threshold"), F.round(F.lit(st[f"{c}__m"]), 2).alias("mean"),
                 F.round(F.lit(st[f"{c}__s"]), 2).alias("std"))
        for c in usable
    ])
    return counts.select(F.explode(rows).alias("r")).select("r.*").where(F.col("outlier_count") > 0)


def zscore_rows(df: DataFrame, col: str, threshold: float = 2.5) -> DataFrame:
    """C24 row-level variant: the rows whose |z| exceeds ``threshold``."""
    st = df.agg(F.avg(quoted(col).cast("double")).alias("m"), F.stddev_samp(quoted(col).cast("double")).alias("s")).collect()[0]
    if st["s"] in (None, 0.0):
        return df.limit(0).withColumn("z", F.lit(None).cast("double"))
    z = (quoted(col).cast("double") - F.lit(st["m"])) / F.lit(st["s"])
    return df.withColumn("z", z).where(F.abs(F.col("z")) > threshold)


def quality(df: DataFrame) -> DataFrame:
    """Rows, columns, duplicate rows, completeness %, quality score.

    Rows are equal when two 64-bit hashes of all their values (and of which are null) are, so the
    shuffle carries 16 bytes a row whatever the table's width.
    """
    cols = df.columns
    nulls = df.agg(F.count(F.lit(1)).alias("rows"),
                   *[F.count(F.when(quoted(c).isNull(), 1)).alias(f"n{i}") for i, c in enumerate(cols)])
    given = [quoted(c).isNull() for c in cols]  # hashes skip nulls
    row = [F.xxhash64(*given, *[quoted(c) for c in cols]).alias("a"), F.xxhash64(F.lit(1), *[quoted(c) for c in reversed(cols)], *given).alias("b")]
    dups = df.groupBy(*row).agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("duplicate_rows"))
    total_nulls = sum((quoted(f"n{i}") for i in range(len(cols))), F.lit(0))
    cells = F.col("rows") * F.lit(len(cols))
    comp = F.when(cells > 0, F.round((1 - total_nulls / cells) * 100, 1)).otherwise(F.lit(100.0))
    base = nulls.select("rows", comp.alias("completeness_pct"))
    # Both sides are single rows; a union + max collapses them without a join.
    merged = (
        base.select("rows", "completeness_pct", F.lit(None).cast("long").alias("duplicate_rows"))
        .unionByName(dups.select(F.lit(None).cast("long").alias("rows"), F.lit(None).cast("double").alias("completeness_pct"), "duplicate_rows"))
        .agg(F.max("rows").alias("rows"), F.max("completeness_pct").alias("completeness_pct"), F.max("duplicate_rows").alias("duplicate_rows"))
    )
    return merged.select(
        "rows", F.lit(len(cols)).cast("long").alias("columns"), "duplicate_rows", "completeness_pct",
        F.round(F.col("completeness_pct") - F.col("duplicate_rows") / F.greatest(F.col("rows"), F.lit(1)) * 10, 1).alias("quality_score"),
    )


def null_percentages(df: DataFrame) -> DataFrame:
    """C25 detail: null % per column (round 2), only columns with nulls."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.when(quoted(c).isNull(), 1)).alias(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.round(quoted(c) / F.col("__n") * 100, 2).alias("null_pct")) for c in cols])
    return wide.select(F.explode(rows).alias("r")).select("r.*").where(F.col("null_pct") > 0)


def compare(df1: DataFrame, df2: DataFrame, max_cols: int | None = None) -> DataFrame:
    """Mean and sum of shared numeric columns of two datasets (1×1 rows)."""
    shared = sorted(set(numeric_columns(df1)) & set(numeric_columns(df2)))[:max_cols]
    schema = "column string, ds1_mean double, ds2_mean double, ds1_sum double, ds2_sum double"
    if not shared:
        return df1.sparkSession.createDataFrame([], schema)

    def stats(df, tag):
        wide = df.agg(*[x for c in shared for x in (F.avg(quoted(c).cast("double")).alias(f"{c}__mean"),
                                                     F.sum(quoted(c).cast("double")).alias(f"{c}__sum"))])
        rows = F.array(*[F.struct(F.lit(c).alias("column"), F.round(quoted(f"{c}__mean"), 2).alias(f"{tag}_mean"),
                                  F.round(quoted(f"{c}__sum"), 2).alias(f"{tag}_sum")) for c in shared])
        return wide.select(F.explode(rows).alias("r")).select("r.*")

    # ≤ 10 rows per side: a keyed join of two tiny tables.
    return stats(df1, "ds1").join(stats(df2, "ds2"), "column").select(
        "column", "ds1_mean", "ds2_mean", "ds1_sum", "ds2_sum")


# ---------------------------------------------------------------------------
# Q1 / Q2 profile
# ---------------------------------------------------------------------------

# Name fragments that make a column a phone-like text identifier.
PHONE_HINTS = ["phone", "mobile", "fax", "tel", "cell", "whatsapp"]


def detect_types(df: DataFrame) -> dict[str, str]:
    """Q2: numeric / datetime / boolean / text per column.

    Typed columns follow the schema (phone-like names stay text).  For text
    columns one pass counts how many non-null values parse as a datetime
    (with a separator, D6) or a number; all of them must parse (D18: a full
    pass instead of the first 20 values).
    """
    out: dict[str, str] = {}
    text = []
    for f in df.schema.fields:
        name = f.name.lower()
        if any(h in name for h in PHONE_HINTS):
            out[f.name] = "text"
        elif isinstance(f.dataType, T.BooleanType):
            out[f.name] = "boolean"
        elif isinstance(f.dataType, T.NumericType):
            out[f.name] = "numeric"
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out[f.name] = "datetime"
        else:
            text.append(f.name)
    if text:
        aggs = []
        for c in text:
            aggs += [F.count(quoted(c)).alias(f"{c}__nn"), F.count(to_timestamp_mixed(quoted(c))).alias(f"{c}__dt"),
                     F.count(to_number(quoted(c))).alias(f"{c}__num")]
        st = df.agg(*aggs).collect()[0].asDict()
        for c in text:
            nn = st[f"{c}__nn"]
            if nn == 0:
                out[c] = "datetime" if any(k in c for k in ("_at", "date", "time")) else "text"
            elif st[f"{c}__dt"] == nn:
                out[c] = "datetime"
            elif st[f"{c}__num"] == nn:
                out[c] = "numeric"
            else:
                out[c] = "text"
    return {c: out[c] for c in df.columns}


PROFILE_SCHEMA = ("column string, data_type string, null_ratio double, unique_ratio double, top_5 array<string>, "
                  "min double, max double, mean double, std_dev double, min_date string, max_date string, "
                  "avg_char_length double")


def profile(df: DataFrame, types: dict[str, str] | None = None, counts: bool = False) -> DataFrame:
    """Q1: one row per column: type, null/unique ratios, top 5 values, typed stats; with ``counts`` also ``distinct``.

    One wide aggregate for the typed statistics; distinct counts and the top 5 come from hashes of
    the values (``_frequent``), so no column is shuffled as text.
    """
    types = types or detect_types(df)
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for c in cols:
        t = types[c]
        aggs.append(F.count(F.when(quoted(c).isNull(), 1)).alias(f"{c}__nulls"))
        if t == "numeric":
            v = to_number(quoted(c), df.schema[c].dataType)
            aggs += [F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max"), F.avg(v).alias(f"{c}__mean"),
                     F.stddev_samp(v).alias(f"{c}__std")]
        elif t == "datetime":
            ts = to_timestamp_mixed(quoted(c), df.schema[c].dataType)
            aggs += [F.min(ts).alias(f"{c}__mind"), F.max(ts).alias(f"{c}__maxd")]
        elif t == "text":
            aggs.append(F.avg(F.length(quoted(c).cast("string"))).alias(f"{c}__len"))
    wide = df.agg(*aggs)

    def stat(c, key, kind="double"):
        name = f"{c}__{key}"
        return quoted(name).cast(kind) if name in wide.columns else F.lit(None).cast(kind)

    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.lit(types[c]).alias("data_type"),
            F.round(stat(c, "nulls") / F.greatest(F.col("__rows"), F.lit(1)), 4).alias("null_ratio"),
            stat(c, "min").alias("min"), stat(c, "max").alias("max"),
            F.round(stat(c, "mean"), 2).alias("mean"), F.round(stat(c, "std"), 2).alias("std_dev"),
            ts_text(stat(c, "mind", "timestamp")).alias("min_date"),
            ts_text(stat(c, "maxd", "timestamp")).alias("max_date"),
            (F.round(F.coalesce(stat(c, "len"), F.lit(0.0)), 1) if types[c] == "text" else F.lit(None).cast("double")).alias("avg_char_length"),
            F.col("__rows").alias("rows"),
        )
        for c in cols
    ])
    base = wide.select(F.explode(rows).alias("r")).select("r.*")
    distinct, top = _frequent(df, cols, 5)
    nd = distinct.select(_column_name(cols), "nunique")
    top5 = top.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("t")).select(
        _column_name(cols), F.transform("t", lambda s: s["value"]).alias("top_5"))
    # Both sides have one row per column (bounded by the schema width).
    out = base.join(F.broadcast(nd), "column", "left").join(F.broadcast(top5), "column", "left")
    return out.select(
        "column", "data_type", "null_ratio",
        F.round(F.coalesce(F.col("nunique"), F.lit(0)) / F.greatest(F.col("rows"), F.lit(1)), 4).alias("unique_ratio"),
        F.coalesce(F.col("top_5"), F.array().cast("array<string>")).alias("top_5"),
        "min", "max", "mean", "std_dev", "min_date", "max_date", "avg_char_length",
        *([F.coalesce(F.col("nunique"), F.lit(0)).alias("distinct")] if counts else []),
    )


# ---------------------------------------------------------------------------
# Q3–Q6 correlations and mutual information
# ---------------------------------------------------------------------------

def pearson(a: Column, b: Column) -> Column:
    """Pearson r over the rows where both are given; null for a constant side (ANSI-safe)."""
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.try_divide(F.covar_pop(a, b), spread)


def correlations(df: DataFrame, cols: list[str] | None = None, min_abs: float = 0.3) -> DataFrame:
    """Q3: Pearson r for every numeric pair (pairwise-complete) in one scan; |r| ≥ min_abs."""
    cols = cols or numeric_columns(df)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    schema = "source string, target string, weight double, method string"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    wide = df.agg(*[pearson(quoted(a).cast("double"), quoted(b).cast("double")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), quoted(f"p{i}").alias("r"))
                     for i, (a, b) in enumerate(pairs)])
    long = wide.select(F.explode(rows).alias("x")).select("x.*")
    return long.where(F.col("r").isNotNull() & ~F.isnan("r") & (F.abs("r") >= min_abs)).select(
        "source", "target", F.round("r", 3).alias("weight"), F.lit("pearson").alias("method"))


def correlation_matrix(df: DataFrame, top: int | None = None) -> DataFrame:
    """Q6: full Pearson matrix of the non-constant numeric columns (of the ``top`` with the highest variance if given)."""
    cols = numeric_columns(df)
    # More than one distinct value ⇔ min < max (no distinct-count sketch needed).
    st = df.agg(*[x for c in cols for x in (F.var_samp(quoted(c).cast("double")).alias(f"{c}__v"),
                                             F.min(quoted(c)).alias(f"{c}__lo"), F.max(quoted(c)).alias(f"{c}__hi"))]
                ).collect()[0].asDict()
    keep = [c for c in cols if st[f"{c}__lo"] is not None and st[f"{c}__lo"] < st[f"{c}__hi"]
            and st[f"{c}__v"] is not None]
    keep = sorted(keep, key=lambda c: (-st[f"{c}__v"], c))[:top]
    if not keep:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, r double")
    uniq = [(a, b) for a in keep for b in keep if a < b]
    idx = {pair: f"p{i}" for i, pair in enumerate(uniq)}
    aggs = [pearson(quoted(a).cast("double"), quoted(b).cast("double")).alias(idx[(a, b)]) for a, b in uniq]
    wide = df.agg(*aggs) if aggs else df.agg(F.count(F.lit(1)).alias("__n"))
    cells = []
    for a in keep:
        for b in keep:
            r = F.lit(1.0) if a == b else F.round(quoted(idx[(min(a, b), max(a, b))]), 3)
            cells.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), r.alias("r")))
    return wide.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def mutual_info_discrete(df: DataFrame, x: str, y: str) -> DataFrame:
    """Q5 (discrete–discrete): exact plug-in mutual information in nats from counts."""
    pairs = df.where(quoted(x).isNotNull() & quoted(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("nxy"))
    n = pairs.agg(F.sum("nxy").alias("n"))
    px = pairs.groupBy(x).agg(F.sum("nxy").alias("nx"))
    py = pairs.groupBy(y).agg(F.sum("nxy").alias("ny"))
    # Marginal tables have one row per category; they are joined on their keys.
    j = pairs.join(px, x).join(py, y)
    total = n.collect()[0]["n"] or 0
    if total == 0:
        return df.sparkSession.createDataFrame([(x, y, 0.0)], "feature string, target string, mi double")
    term = (F.col("nxy") / F.lit(total)) * F.log((F.col("nxy") * F.lit(total)) / (F.col("nx") * F.col("ny")))
    return j.agg(F.round(F.sum(term), 6).alias("mi")).select(F.lit(x).alias("feature"), F.lit(y).alias("target"), "mi")


def mutual_info_binned(df: DataFrame, cat: str, num: str, bins: int = 10, squash: bool = True) -> DataFrame:
    """Q4: category–numeric MI with the numeric side cut into equal-width bins.

    A different estimator from the reference's k-NN one (named accordingly);
    with ``squash`` the score is ``score / max(1, score)``, as graph edges need it.
    """
    st = df.agg(F.min(quoted(num).cast("double")).alias("mn"), F.max(quoted(num).cast("double")).alias("mx")).collect()[0]
    if st["mn"] is None:
        return df.sparkSession.createDataFrame([(cat, num, 0.0)], "feature string, target string, mi double")
    width = (st["mx"] - st["mn"]) / bins if st["mx"] != st["mn"] else 1.0
    b = F.least(F.floor((quoted(num).cast("double") - F.lit(st["mn"])) / F.lit(width)), F.lit(bins - 1))
    binned = df.where(quoted(num).isNotNull()).select(quoted(cat), b.alias("__bin"))
    res = mutual_info_discrete(binned, cat, "__bin")
    return res.select(F.lit(cat).alias("feature"), F.lit(num).alias("target"),
                      (F.round(F.col("mi") / F.greatest(F.lit(1.0), F.col("mi")), 3) if squash else F.col("mi")).alias("mi"))


def _digamma(x: Column) -> Column:
    """Digamma of numbers of at least one: eight steps up the recurrence, then the asymptotic series."""
    y = x + 8.0
    i2 = 1.0 / (y * y)
    series = F.log(y) - 0.5 / y - i2 * (1 / 12 - i2 * (1 / 120 - i2 / 252))
    return series - sum((1.0 / (x + float(i)) for i in range(1, 8)), 1.0 / x)


def mutual_info_neighbors(df: DataFrame, cat: str, num: str, k: int = 5, block: int = 100_000) -> DataFrame:
    """Q4: mutual information (nats) of a category and a number by nearest neighbours: (feature, target, mi).

    For every row the distance to its ``k``-th neighbour of the same category (all of them in
    smaller ones) and the number of rows of any category closer than that, itself included; equal
    rows count where the distance is 0.  Rows with a null or NaN and categories of one row are left out; mi is at least 0.

    Rows are ordered over ranges; neighbours are found inside blocks of ``block`` ranks that repeat
    ``k`` rows of the blocks beside them, counts are differences of ranks.  No category is one task.
    """
    base = df.select(quoted(cat).cast("string").alias("c"), quoted(num).cast("double").alias("v")).where("c is not null and v is not null and not isnan(v)")
    classes = base.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    n = F.col("n").cast("double")
    part = classes.agg(F.sum("n").alias("rows"), F.sum(n * _digamma(n)).alias("own"), F.sum(n * _digamma(F.least(n - 1, F.lit(float(k))))).alias("near")).first()
    if not part["rows"]:
        return df.sparkSession.createDataFrame([(cat, num, 0.0)], "feature string, target string, mi double")
    total = float(part["rows"])

    ordered = global_order(base.join(classes, "c").withColumn("_id", F.monotonically_increasing_id()), [F.col("c"), F.col("v"), F.col("_id")], rank_col="r")
    place, own = (F.col("r") - 1) % block, F.floor((F.col("r") - 1) / block)
    copies = F.array(own, F.when((place < k) & (own > 0), own - 1), F.when(place >= block - k, own + 1))
    blocks = ordered.select("c", "n", "v", "r", own.alias("_own"), F.explode(F.array_compact(copies)).alias("_block"))
    w = Window.partitionBy("_block").orderBy("r")
    side = lambda step: F.array(F.lit(0.0), *[F.when(step("c", i).over(w) == F.col("c"), F.abs(step("v", i).over(w) - F.col("v"))) for i in range(1, k + 1)])
    points = blocks.select("*", side(F.lag).alias("_left"), side(F.lead).alias("_right")).where("_block = _own")
    pick = F.least(F.col("n") - 1, F.lit(k)).cast("int")
    both = F.transform(F.sequence(F.lit(0), pick), lambda i: F.when(F.col("_left")[i].isNotNull() & F.col("_right")[pick - i].isNotNull(), F.greatest(F.col("_left")[i], F.col("_right")[pick - i])))
    points = points.select("r", "v", F.array_min(both).alias("d"))

    # Rows and bounds in one order: kind 1 is a row, kind 0 counts rows below a bound, kind 2 also those on it.
    event = lambda t, kind, one, sign: F.struct(t.alias("t"), kind.alias("kind"), F.lit(one).alias("one"), F.lit(sign).alias("sign"))
    apart = F.col("d") > 0
    events = points.select("r", F.explode(F.array(
        event(F.col("v"), F.lit(1), 1.0, 0), event(F.col("v") + F.col("d"), F.when(apart, 0).otherwise(2), 0.0, 1),
        event(F.col("v") - F.col("d"), F.when(apart, 2).otherwise(0), 0.0, -1))).alias("e")).select("r", "e.*")
    counted = global_order(events, [F.col("t"), F.col("kind"), F.col("r")], running_sum="one", scale=0, running_col="below")
    closer = counted.where("sign <> 0").groupBy("r").agg(F.greatest(F.sum(F.col("sign") * F.col("below")), F.lit(1.0)).alias("m"))
    mean = F.sum(_digamma(F.col("m"))) / F.lit(total)
    mi = _digamma(F.lit(total)) + F.lit((part["near"] - part["own"]) / total) - mean
    return closer.agg(F.round(F.greatest(mi, F.lit(0.0)), 6).alias("mi")).select(F.lit(cat).alias("feature"), F.lit(num).alias("target"), "mi")


def category_edges(df: DataFrame, text: list[str] | None = None, numbers: list[str] | None = None, bins: int = 10,
                   min_score: float = 0.15, min_rows: int = 10) -> DataFrame:
    """Q4: edges between text and numeric columns by squashed binned mutual information.

    All pairs in two passes: one for the ranges, one that counts (pair, value, bin); the
    marginals are sums of those counts.  Pairs with fewer than ``min_rows`` complete rows have no edge.
    """
    text, numbers = text or text_columns(df), numbers or numeric_columns(df)
    schema = "source string, target string, weight double, method string"
    if not text or not numbers:
        return df.sparkSession.createDataFrame([], schema)
    st = df.agg(*[x for i, c in enumerate(numbers) for x in (F.min(quoted(c).cast("double")).alias(f"lo{i}"), F.max(quoted(c).cast("double")).alias(f"hi{i}"))]).collect()[0]
    cells = []
    for i, c in enumerate(numbers):
        lo, hi = st[f"lo{i}"], st[f"hi{i}"]
        if lo is None:
            continue
        width = (hi - lo) / bins if hi != lo else 1.0
        bucket = F.least(F.floor((quoted(c).cast("double") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
        cells += [F.struct(F.lit(t).alias("source"), F.lit(c).alias("target"), quoted(t).alias("x"), bucket.alias("b")) for t in text]
    if not cells:
        return df.sparkSession.createDataFrame([], schema)
    pair = ["source", "target"]
    counts = df.select(F.explode(F.array(*cells)).alias("p")).select("p.*").where(F.col("x").isNotNull() & F.col("b").isNotNull()).groupBy(*pair, "x", "b").agg(F.count(F.lit(1)).alias("nxy"))
    total = counts.groupBy(*pair).agg(F.sum("nxy").alias("n"))
    by_x = counts.groupBy(*pair, "x").agg(F.sum("nxy").alias("nx"))
    by_b = counts.groupBy(*pair, "b").agg(F.sum("nxy").alias("ny"))
    full = counts.join(by_x, [*pair, "x"]).join(by_b, [*pair, "b"]).join(total, pair)
    term = F.col("nxy") / F.col("n") * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    mi = full.where(F.col("n") >= min_rows).groupBy(*pair).agg(F.round(F.sum(term), 6).alias("mi"))
    score = F.round(F.col("mi") / F.greatest(F.lit(1.0), F.col("mi")), 3)
    return mi.select(*pair, score.alias("weight"), F.lit("mutual_info").alias("method")).where(F.col("weight") >= min_score)


def graph_nodes(df: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """Q3: one node per column with its kind and role."""
    kinds = {**{c: "numeric" for c in numeric_columns(df)}, **{c: "datetime" for c in datetime_columns(df)}}
    rows = [(c, kinds.get(c, "text"), (roles or {}).get(c, "unknown")) for c in df.columns]
    return df.sparkSession.createDataFrame(rows, "column string, type string, role string")


def rank_features(df: DataFrame, target: str, exclude: list[str] | None = None, numeric_share: float = 0.8) -> DataFrame:
    """Q5: score every candidate against ``target``; |Pearson| for numeric pairs, else binned MI.

    Text columns of which at least ``numeric_share`` of the values parse as numbers count as numeric.

    Scores (6 decimals) are scaled by the maximum (best feature = 1.0).
    """
    exclude = set(exclude or []) | {target}
    text = [c for c in text_columns(df) if c not in exclude or c == target]
    if text:  # one pass over all text columns
        parsed = {c: to_number(quoted(c), T.StringType()) for c in text}
        st = df.agg(*[x for i, c in enumerate(text) for x in (F.count(quoted(c)).alias(f"n{i}"), F.count(parsed[c]).alias(f"p{i}"))]).collect()[0]
        for i, c in enumerate(text):
            if st[f"n{i}"] and st[f"p{i}"] / st[f"n{i}"] >= numeric_share:
                df = df.withColumn(c, parsed[c])
    nums = set(numeric_columns(df))
    parts = []
    for c in df.columns:
        if c in exclude:
            continue
        if c in nums and target in nums:
            r = df.agg(F.round(F.abs(pearson(quoted(c).cast("double"), quoted(target).cast("double"))), 6).alias("score"))
            parts.append(r.select(F.lit(c).alias("feature"), F.lit("pearson").alias("method"), "score"))
        else:
            mi = mutual_info_binned(df, c, target, squash=False) if target in nums else mutual_info_discrete(df, c, target)
            parts.append(mi.select(F.lit(c).alias("feature"), F.lit("mutual_info").alias("method"), F.col("mi").alias("score")))
    if not parts:
        return df.sparkSession.createDataFrame([], "feature string, method string, score double, scaled double")
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    w = Window.partitionBy(F.lit(1))  # one row per feature column
    return allp.withColumn("scaled", F.round(F.try_divide(F.col("score"), F.max("score").over(w)), 6)).orderBy(
        F.col("score").desc(), "feature")


def attach_roles(profile_df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Attach role labels to profile rows by column name (inner: unknown names skipped).

    The roles table has one row per named column (bounded by the schema width).
    """
    spark = profile_df.sparkSession
    rt = spark.createDataFrame(sorted(roles.items()), "column string, role string")
    return profile_df.join(F.broadcast(rt), "column")
