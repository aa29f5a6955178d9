"""Distributed total orders: global rank, running sums and exact quantiles.

An un-partitioned window (``row_number().over(Window.orderBy(x))``) moves every
row into one task.  These helpers instead range-partition on the sort key, number
rows inside each partition (no shuffle) and add per-partition offsets taken from
a table with one row per partition.  A hot key cannot overload a task because
range bounds are drawn from the full sort key (ties broken by the caller's
unique columns).

The numbered frame is written with a reliable ``checkpoint`` before the offsets
are computed, so the partition ids seen by both passes are the same and a lost
executor recomputes from the checkpoint, not from a re-sampled range shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from briskbi.session import cut_lineage

_PID, _LPOS = "_br_pid", "_br_lpos"
#: A running sum in fixed point is kept as two whole numbers, billions and the rest, so it passes 64 bits.
_LIMB = 1_000_000_000
_LCUM = ("_br_high", "_br_low")


def _n_parts(df: DataFrame, n_parts: int | None) -> int:
    if n_parts:
        return n_parts
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _local_cumsum(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Numbers a partition's rows and adds up both parts of the running sum."""
    pos, acc = 0, [0, 0]
    for pdf in batches:
        n = len(pdf)
        pdf[_LPOS] = np.arange(pos + 1, pos + n + 1, dtype=np.int64)
        pos += n
        for i, c in enumerate(_LCUM):
            pdf[c] = np.cumsum(pdf[c].fillna(0).astype(np.int64).to_numpy(), dtype=np.int64) + acc[i]
            acc[i] = int(pdf[c].iloc[-1]) if n else acc[i]
        yield pdf


def global_order(
    df: DataFrame,
    order_cols: Sequence[Column],
    running_sum: str | None = None,
    scale: int = 2,
    rank_col: str = "global_rank",
    running_col: str = "running_sum",
    n_parts: int | None = None,
) -> DataFrame:
    """Add a 1-based position in the total order and, optionally, a running sum.

    ``order_cols`` must define a total order (end with a unique column) for a
    reproducible result.  The running sum is accumulated exactly in fixed point
    with ``scale`` decimals (money), so it does not depend on partitioning.
    """
    P = _n_parts(df, n_parts)
    ranged = df.repartitionByRange(P, *order_cols).sortWithinPartitions(*order_cols)
    ranged = ranged.withColumn(_PID, F.spark_partition_id())
    if running_sum is None:
        local = ranged.withColumn(_LPOS, F.monotonically_increasing_id())
    else:
        fixed = F.round(F.col(running_sum) * (10**scale)).cast("decimal(38,0)")
        ranged = ranged.withColumn("_br_fixed", fixed).withColumn(_LCUM[0], F.expr(f"_br_fixed div {_LIMB}")).withColumn(
            _LCUM[1], F.expr(f"_br_fixed % {_LIMB}").cast("long")).drop("_br_fixed")
        local = ranged.mapInPandas(_local_cumsum, T.StructType(ranged.schema.fields + [T.StructField(_LPOS, T.LongType())]))
    local = cut_lineage(local)

    aggs = [F.min(_LPOS).alias("_br_first"), F.count(F.lit(1)).alias("_br_n")]
    if running_sum is not None:
        total = F.col(_LCUM[0]).cast("decimal(28,0)") * _LIMB + F.col(_LCUM[1])
        local = local.withColumn("_br_sum", total.cast("decimal(38,0)"))
        aggs.append(F.max_by("_br_sum", _LPOS).alias("_br_psum"))
    offs = local.groupBy(_PID).agg(*aggs)
    # One row per partition: a single-task window over P rows is bounded.
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offs = offs.withColumn("_br_before", F.coalesce(F.sum("_br_n").over(before), F.lit(0)))
    if running_sum is not None:
        offs = offs.withColumn("_br_sum_before", F.coalesce(F.sum("_br_psum").over(before), F.lit(0)).cast("decimal(38,0)"))
    out = local.join(F.broadcast(offs), _PID)
    if running_sum is None:
        out = out.withColumn(rank_col, F.col("_br_before") + F.col(_LPOS) - F.col("_br_first") + 1)
    else:
        out = out.withColumn(rank_col, F.col("_br_before") + F.col(_LPOS))
        out = out.withColumn(running_col, ((F.col("_br_sum_before") + F.col("_br_sum")) / F.lit(10**scale)).cast("double"))
    drop = [_PID, _LPOS, *_LCUM, "_br_sum", "_br_first", "_br_n", "_br_psum", "_br_before", "_br_sum_before"]
    return out.drop(*[c for c in drop if c in out.columns])


#: Accuracy of the sketches that bracket a percentile: ranks are off by at most 1 / SKETCH of the rows.
SKETCH = 1_000


def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys``, nulls equal, with the left side's keys; without keys ``right`` has one row."""
    if not keys:
        return left.join(F.broadcast(right))
    other = right.withColumnsRenamed({k: f"_br_k{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_br_k{i}")) for i, k in enumerate(keys)]
    return left.join(other, same).drop(*[f"_br_k{i}" for i in range(len(keys))])


def _at_positions(rows: DataFrame, keys: Sequence[str], wanted: DataFrame, n_parts: int) -> DataFrame:
    """(keys, _br_pos, _br_found): the value at each wanted 0-based position of a group's sorted ``_br_v``.

    Rows are range-partitioned on (keys, value), so a group larger than a task is spread over many.
    """
    order = [F.col(k) for k in keys] + [F.col("_br_v")]
    ranged = rows.select(*keys, "_br_v").repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    ranged = cut_lineage(ranged.withColumn(_PID, F.spark_partition_id()).withColumn(_LPOS, F.monotonically_increasing_id()))
    # Per (partition, group): first id and row count, at most #groups + #partitions rows.
    seg = ranged.groupBy(_PID, *keys).agg(F.min(_LPOS).alias("_br_first"), F.count(F.lit(1)).alias("_br_cnt"))
    before = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("_br_off", F.coalesce(F.sum("_br_cnt").over(before), F.lit(0)))
    part = F.col("_br_pos") - F.col("_br_off")
    if keys:
        hit = _beside(wanted, seg, keys).where((part >= 0) & (part < F.col("_br_cnt")))
    else:
        hit = seg.join(F.broadcast(wanted), (part >= 0) & (part < F.col("_br_cnt")))
    hit = hit.select(*keys, "_br_pos", (F.col("_br_first") + part).alias(_LPOS))
    return hit.join(ranged.select(_LPOS, F.col("_br_v").alias("_br_found")), _LPOS).select(*keys, "_br_pos", "_br_found")


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str] | None = None,
    n_parts: int | None = None,
    sketch: int = SKETCH,
) -> DataFrame:
    """Exact, linearly interpolated percentiles per group (``keys`` may be empty).

    Same definition as ``quantile_cont`` / pandas ``quantile``: with the group's
    ``n`` non-null values sorted, position ``(n-1)·p`` is interpolated between its
    floor and ceiling neighbours.

    By selection: a mergeable sketch brackets each percentile, one pass counts what lies below, on
    and inside the bracket, and only the rows strictly inside (about 6 / ``sketch`` of a group at
    most) are sorted.  Values on the edges of a bracket are known, so a frequent value is never
    moved.  A position that its bracket misses is found by sorting its group.
    """
    keys = list(keys)
    names = list(names or [f"p{i}" for i in range(len(probs))])
    P = _n_parts(df, n_parts)
    base = df.select(*keys, F.col(value).cast("double").alias("_br_v")).where(F.col("_br_v").isNotNull())
    slack = 2.0 / sketch
    edges = [F.percentile_approx("_br_v", [max(0.0, p - slack), min(1.0, p + slack)], sketch).alias(f"_br_e{i}") for i, p in enumerate(probs)]
    # Without keys this is one row, which the driver holds.
    once = cut_lineage if keys else lambda rows: df.sparkSession.createDataFrame(rows.collect(), rows.schema)
    brackets = once(base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_br_n"), *edges))

    v, per = F.col("_br_v"), _beside(base, brackets, keys)
    count = lambda c: F.count(F.when(c, 1))
    stats = []
    for i in range(len(probs)):
        lo, hi = F.col(f"_br_e{i}")[0], F.col(f"_br_e{i}")[1]
        stats.append(F.struct(
            F.first(lo).alias("lo"), F.first(hi).alias("hi"), count(v < lo).alias("below"), count(v == lo).alias("on_lo"),
            count((v > lo) & (v < hi)).alias("inside"), count((v == hi) & (hi > lo)).alias("on_hi"),
            F.max(F.when(v < lo, v)).alias("before"), F.min(F.when(v > hi, v)).alias("after")).alias(f"_br_s{i}"))
    wide = per.groupBy(*keys).agg(F.first("_br_n").alias("_br_n"), *stats)
    spot = [(F.col("_br_n") - 1) * F.lit(float(p)) for p in probs]
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(pos).cast("long").alias("floor"), F.ceil(pos).cast("long").alias("ceil"),
                              (pos - F.floor(pos)).alias("frac"), F.col(f"_br_s{i}").alias("s")) for i, pos in enumerate(spot)])
    asked = wide.select(*keys, F.explode(rows).alias("_br_t")).select(
        *keys, F.col("_br_t.i").alias("_br_i"), F.col("_br_t.frac").alias("_br_frac"), F.col("_br_t.s").alias("_br_s"),
        F.explode(F.array_distinct(F.array("_br_t.floor", "_br_t.ceil"))).alias("_br_pos"))
    s = {c: F.col(f"_br_s.{c}") for c in ("lo", "hi", "below", "on_lo", "inside", "on_hi", "before", "after")}
    at = F.col("_br_pos") - s["below"]
    known = (F.when(at == -1, s["before"]).when((at >= 0) & (at < s["on_lo"]), s["lo"])
             .when((at >= s["on_lo"] + s["inside"]) & (at < s["on_lo"] + s["inside"] + s["on_hi"]), s["hi"])
             .when(at == s["on_lo"] + s["inside"] + s["on_hi"], s["after"]))
    inner = (at >= s["on_lo"]) & (at < s["on_lo"] + s["inside"])
    asked = once(asked.select(*keys, "_br_i", "_br_frac", "_br_pos", known.alias("_br_found"), inner.alias("_br_inner"),
                                     (at - s["on_lo"]).alias("_br_rank"), s["lo"].alias("_br_lo"), s["hi"].alias("_br_hi")))

    found = asked.where("_br_found is not null").select(*keys, "_br_i", "_br_frac", "_br_pos", "_br_found")
    sort = asked.where("_br_found is null and _br_inner")
    if not sort.isEmpty():
        group = [*keys, "_br_i"]
        spans = sort.select(*group, "_br_lo", "_br_hi").distinct()
        inside = _beside(base, spans.groupBy(*keys).agg(F.collect_list(F.struct("_br_i", "_br_lo", "_br_hi")).alias("_br_b")), keys)  # a few percentiles a group
        inside = inside.select(*keys, "_br_v", F.explode("_br_b").alias("b")).where("_br_v > b._br_lo and _br_v < b._br_hi").select(*keys, F.col("b._br_i").alias("_br_i"), "_br_v")
        got = _at_positions(inside, group, sort.select(*group, F.col("_br_rank").alias("_br_pos")), P).withColumnRenamed("_br_pos", "_br_rank")
        found = found.unionByName(_beside(sort.drop("_br_found"), got, [*group, "_br_rank"]).select(*found.columns))
    missed = asked.where("_br_found is null and not _br_inner").drop("_br_found")
    if not missed.isEmpty():
        whole = _beside(base, missed.select(*keys).distinct(), keys) if keys else base
        got = _at_positions(whole, keys, missed.select(*keys, "_br_pos").distinct(), P)
        found = found.unionByName(_beside(missed, got, [*keys, "_br_pos"]).select(*found.columns))

    ends = found.groupBy(*keys, "_br_i").agg(F.min_by("_br_found", "_br_pos").alias("a"), F.max_by("_br_found", "_br_pos").alias("b"), F.first("_br_frac").alias("f"))
    q = F.col("a") + (F.col("b") - F.col("a")) * F.col("f")
    return ends.groupBy(*keys).agg(*[F.max(F.when(F.col("_br_i") == i, q)).alias(name) for i, name in enumerate(names)])


def _ffill_local(cols: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict = {}
        for batch in batches:
            out = dict(zip(batch.schema.names, batch.columns))
            for c, v in out.items():
                if pa.types.is_floating(v.type):  # NaN counts as missing
                    out[c] = pc.if_else(pc.is_nan(v), pa.scalar(None, v.type), v)
            for c in cols:
                v = pc.fill_null_forward(out[c])
                if c in last:
                    v = pc.coalesce(v, last[c])
                if len(v) and v[-1].is_valid:
                    last[c] = v[-1]
                out[c] = v
            yield pa.RecordBatch.from_arrays(list(out.values()), schema=batch.schema)

    return run


def forward_fill(df: DataFrame, order_cols: Sequence[Column], cols: Sequence[str],
                 n_parts: int | None = None, typed: dict[str, Column] | None = None) -> DataFrame:
    """Fill nulls in ``cols`` with the last earlier non-null value.

    Rows are range-partitioned on ``order_cols``; each partition fills locally
    in order (Arrow batches), and values still missing at a partition's start
    come from the last non-null value of the partitions before it — a table with
    one row per partition.  No task sees more than its range.

    ``typed`` replaces columns by expressions over ``df`` before the fill, but after the
    rows have moved: the sampling for the ranges reads ``df`` too, and would compute them again.
    """
    cols = list(cols)
    P = _n_parts(df, n_parts)
    ranged = df.repartitionByRange(P, *order_cols).sortWithinPartitions(*order_cols)
    ranged = ranged.select(*[(typed or {}).get(c, F.col(c)).alias(c) for c in df.columns],
                           F.spark_partition_id().alias(_PID), F.monotonically_increasing_id().alias(_LPOS))
    local = cut_lineage(ranged.mapInArrow(_ffill_local(cols), ranged.schema))
    tail = local.groupBy(_PID).agg(*[F.max_by(F.col(c), F.col(_LPOS)).alias(c) for c in cols])
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    prev = tail.select(_PID, *[F.last(F.col(c), ignorenulls=True).over(before).alias(f"_br_prev_{i}")
                               for i, c in enumerate(cols)])
    prev = cut_lineage(prev)  # found once, not whenever the result is read
    out = local.join(F.broadcast(prev), _PID)
    filled = [F.coalesce(F.col(c), F.col(f"_br_prev_{cols.index(c)}")).alias(c) if c in cols else F.col(c)
              for c in df.columns]
    return out.select(*filled)
