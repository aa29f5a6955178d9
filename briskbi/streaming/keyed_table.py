"""A keyed table of hash buckets, updated bucket by bucket.

A row lives in the bucket of its key's hash.  A batch rewrites only the buckets its keys fall in, into
a folder of its own, and then switches the table by one new manifest: a small file that names, for
each bucket, the folder with its current rows.  Readers take the newest manifest, so they see a batch whole or not at
all; a batch that is tried again builds on the manifest before its own and replaces its own.

Layout under ``target``: ``data/<batch>-<try>/_bucket=<n>/*.parquet`` and ``manifest/<batch>.json``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"


def _files(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, target: str) -> list[int]:
    path, fs = _files(spark, f"{target}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def _load(spark: SparkSession, target: str, number: int) -> dict:
    text = spark.read.text(f"{target}/manifest/{number}.json", wholetext=True).first()[0]
    return json.loads(text)


def manifest(spark: SparkSession, target: str, below: int | None = None) -> dict | None:
    """The newest manifest (of those before batch ``below`` if given), None for a table not yet written."""
    target = target.rstrip("/")
    numbers = [n for n in _numbers(spark, target) if below is None or n < below]
    return _load(spark, target, numbers[-1]) if numbers else None


def _switch(spark: SparkSession, target: str, number: int, content: dict) -> None:
    """Writes a manifest aside and moves it into its place."""
    aside, fs = _files(spark, f"{target}/manifest/.{uuid.uuid4().hex}")
    place, _ = _files(spark, f"{target}/manifest/{number}.json")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if fs.exists(place):  # an earlier try of this batch; until the move, readers see the batch before
        fs.delete(place, False)
    if not fs.rename(aside, place):
        raise OSError(f"manifest {number} of {target} could not be moved into place")


def _bucket(key: list[str], buckets: int) -> Column:
    given = [F.col(f"`{c}`").isNull() for c in key]  # hashes skip nulls
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in key], *given), F.lit(buckets)).cast("int")


def _same_columns(known: T.StructType, got: T.StructType) -> None:
    a, b = ({f.name: f.dataType.simpleString() for f in s} for s in (known, got))
    if a != b:
        wrong = sorted(c for c in a.keys() | b.keys() if a.get(c) != b.get(c))
        raise ValueError(f"schema mismatch: {', '.join(f'{c} {a.get(c)} -> {b.get(c)}' for c in wrong)}")


def upsert(batch: DataFrame, target: str, key: list[str], order: list[str], batch_id: int, buckets: int = 64) -> list[int]:
    """Puts the last row per key (by ``order``) into the table; returns the buckets rewritten.

    A key's row in the batch replaces the one in the table; null keys count as one key.  ``buckets`` holds
    for a table's first batch.  Rows that differ in columns or types from the table's fail the batch.
    """
    spark, target = batch.sparkSession, target.rstrip("/")
    before = manifest(spark, target, below=batch_id)
    if before:
        known = T.StructType.fromJson(before["schema"])
        _same_columns(known, batch.schema)
        batch, buckets = batch.select(*[f"`{c}`" for c in known.names]), before["buckets"]
    columns = batch.columns
    rest = [c for c in columns if c not in key]
    named = {c: F.col(f"`{c}`") for c in columns}
    bucketed = batch.withColumn(BUCKET, _bucket(key, buckets))
    touched = sorted(r[0] for r in bucketed.select(BUCKET).distinct().collect())  # at most ``buckets`` numbers
    held = dict(before["at"]) if before else {}
    folder = f"{batch_id}-{uuid.uuid4().hex}"
    if touched:
        last = bucketed.groupBy(BUCKET, *[named[c] for c in key])
        if rest:
            newest = F.max_by(F.struct(*[named[c] for c in rest]), F.struct(*[named[c] for c in order]))
            rows = last.agg(newest.alias("_r")).select(BUCKET, *[named[c] if c in key else F.col(f"_r.`{c}`").alias(c) for c in columns])
        else:
            rows = last.agg(F.count(F.lit(1)).alias("_n")).drop("_n").select(BUCKET, *[named[c] for c in columns])
        old = [f"{target}/data/{held[str(b)]}/{BUCKET}={b}" for b in touched if str(b) in held]
        if old:
            kept = spark.read.schema(batch.schema).parquet(*old).withColumn(BUCKET, _bucket(key, buckets))
            new = bucketed.select(F.col(BUCKET).alias("_b"), *[named[c].alias(f"_k{i}") for i, c in enumerate(key)]).distinct()
            same = F.col(BUCKET) == F.col("_b")
            for i, c in enumerate(key):
                same = same & named[c].eqNullSafe(F.col(f"_k{i}"))
            rows = kept.join(new, same, "left_anti").select(BUCKET, *[named[c] for c in columns]).unionByName(rows)
        rows.repartition(len(touched), BUCKET).write.partitionBy(BUCKET).parquet(f"{target}/data/{folder}")
        held.update({str(b): folder for b in touched})
    _switch(spark, target, batch_id, {"buckets": buckets, "key": key, "schema": batch.schema.jsonValue(), "at": held})
    return touched


def read(spark: SparkSession, target: str) -> DataFrame:
    """The table as of its newest batch."""
    target = target.rstrip("/")
    now = manifest(spark, target)
    if now is None:
        raise ValueError(f"no table at {target}")
    schema = T.StructType.fromJson(now["schema"])
    paths = [f"{target}/data/{folder}/{BUCKET}={b}" for b, folder in now["at"].items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, target: str, keep: int = 2) -> int:
    """Deletes all but the last ``keep`` manifests and the folders that none of those names; returns the folders deleted."""
    target = target.rstrip("/")
    numbers = _numbers(spark, target)
    used = {folder for n in numbers[-keep:] for folder in _load(spark, target, n)["at"].values()}
    for n in numbers[:-keep]:
        path, fs = _files(spark, f"{target}/manifest/{n}.json")
        fs.delete(path, False)
    data, fs = _files(spark, f"{target}/data")
    gone = [s.getPath() for s in (fs.listStatus(data) if fs.exists(data) else []) if s.getPath().getName() not in used]
    for path in gone:
        fs.delete(path, True)
    return len(gone)
