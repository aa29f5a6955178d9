"""Embedding near-duplicates by randomised-rotation binary codes.

A unit vector is rotated into ``width`` dimensions (a fixed random matrix with
orthonormal columns) and kept as its signs with a correction factor f, the inner product of
the signs' unit vector and the rotated one.  <signs of o, q> / f is an unbiased estimate of
<o, q>, with error about sqrt((1 - f^2) / f^2 / (width - 1)); a pair whose estimate lies ``sure``
errors below the threshold is given up, every other pair is recomputed exactly.

Pairs are looked for in ``tables`` hash tables over bits of the codes.  Bits and tables follow
from the number of vectors N and the threshold alone: about N / 2^bits vectors of a
label meet by chance, and a pair at the threshold shares a bucket of some table with
probability ``recall``.  Every vector is in every table.  Large buckets are cut into blocks
and worked on block by block; a pair counts in the first table where it meets.

Equal vectors of one label are one class with a count, so copies are never paired.

Defined cases: null labels, null or zero vectors, and vectors with null or non-finite
components link with nothing; vectors of different length do not link; repeated rows
are copies that link with each other; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from briskbi.llm.shared import components, keep

BLOCK = 512


def rotation(d: int, width: int, seed: int = 7) -> np.ndarray:
    """width x d matrix with orthonormal columns, the same everywhere."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed * 1000 + d)).standard_normal((max(d, width), d)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated vectors, their signs as booleans, correction factors)."""
    turned = unit @ rotation(unit.shape[1], width).T
    return turned, turned > 0, np.abs(turned).sum(1) / math.sqrt(turned.shape[1])


def estimate(signs: np.ndarray, factor: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of coded (rows) and rotated (columns) vectors, and their error for each row."""
    width = signs.shape[1]
    raw = (signs.astype(np.float32) * 2 - 1) @ turned.T.astype(np.float32) / math.sqrt(width)
    return raw / factor[:, None], np.sqrt((1 - factor**2) / factor**2 / (width - 1))


def plan_tables(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits, tables) for n vectors."""
    bits = max(6, math.ceil(math.log2(max(n, 1) / 256)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _unit(blobs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _bands(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    width = signs.shape[1]
    draw = np.random.Generator(np.random.PCG64(bits * 1000 + tables))
    places = np.concatenate([draw.permutation(width) for _ in range(-(-bits * tables // width))])[: bits * tables].reshape(tables, bits)
    return (signs[:, places].astype(np.int64) << np.arange(bits)).sum(2).astype(np.int32)


def _linked(vec_a, bands_a, vec_b, bands_b, table: int, threshold: float, width: int, sure: float) -> np.ndarray:
    """Pairs (a, b) that link and meet in no earlier table."""
    fresh = np.ones((len(vec_a), len(vec_b)), bool)
    for t in range(table):
        fresh &= bands_a[:, t][:, None] != bands_b[:, t][None, :]
    _, signs, factor = encode(vec_a, width)
    turned, _, _ = encode(vec_b, width)
    value, error = estimate(signs, factor, turned)
    maybe = fresh & (value + sure * error[:, None] >= threshold)
    if not maybe.any():
        return maybe
    if maybe.mean() > 0.05:
        return maybe & (vec_a @ vec_b.T >= threshold)
    i, j = np.nonzero(maybe)
    ok = np.einsum("ij,ij->i", vec_a[i], vec_b[j]) >= threshold
    maybe[i[~ok], j[~ok]] = False
    return maybe


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, recall: float = 0.98, width: int = 256, sure: float = 5.0) -> DataFrame:
    """One row per vector row: id, n_links, component_id, kept."""
    kind = vectors.schema[id_col].dataType.simpleString()
    listed = F.col(vector).cast("array<double>")
    broken = F.exists(listed, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(math.inf)))
    zero = ~F.exists(listed, lambda v: v != 0)
    good = F.col(label).isNotNull() & F.col(vector).isNotNull() & ~broken & ~zero
    rows = vectors.select(F.col(id_col), F.when(F.coalesce(good, F.lit(False)), F.xxhash64(F.col(label).cast("string"), listed)).alias("_key"), F.col(label).cast("string").alias("_label"), listed.alias("_vec"))
    classes = rows.where("_key is not null").groupBy("_key").agg(F.count("*").alias("copies"), F.min(id_col).alias("least"), F.first("_label").alias("_label"), F.first("_vec").alias("_vec"))
    classes = keep(classes.withColumn("dims", F.size("_vec")))
    bits, tables = plan_tables(classes.count(), threshold, recall)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            flat, off = batch.column(4).flatten().to_numpy(), np.concatenate([[0], np.cumsum(dims)])
            for d in np.unique(dims):
                for at in np.array_split(np.flatnonzero(dims == d), max(1, (dims == d).sum() // 1024)):
                    x = np.stack([flat[off[i] : off[i + 1]] for i in at])
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    _, signs, _ = encode(x / np.linalg.norm(x, axis=1, keepdims=True), width)
                    bands = _bands(signs, bits, tables)
                    for t in range(tables):
                        part = pa.RecordBatch.from_arrays([c.take(pa.array(at)) for c in batch.columns[:4]], names=["_key", "copies", "_label", "dims"])
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(at), t, np.int32)), pa.array(bands[:, t]), pa.array([r.tobytes() for r in bands], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())], names=[*part.schema.names, "t", "bucket", "bands", "vec"])

    made = "_key long, copies long, _label string, dims int, t int, bucket int, bands binary, vec binary"
    entries = classes.select("_key", "copies", "_label", "dims", "_vec").mapInArrow(index, made)
    place = ["_label", "dims", "t", "bucket"]
    large = entries.select(*place).groupBy(*place).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    cut = entries.join(large, place, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("_key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("n", "blocks", "other")
    unit = [*place, "lo", "hi"]
    dealt = cut.repartition(*unit).sortWithinPartitions(*unit).select(*unit, "own", "_key", "copies", "bands", "vec")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                if row[:6] != now and rows:
                    yield from _unit_links(now, rows)
                    rows = []
                now = row[:6]
                rows.append(row[6:])
        if rows:
            yield from _unit_links(now, rows)

    def _unit_links(unit: tuple, rows: list) -> Iterator[pa.RecordBatch]:
        _, _, table, _, lo, hi = unit
        if len(rows) < 2:
            return
        own = np.array([r[0] for r in rows])
        keys, copies = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        bands = np.frombuffer(b"".join(r[3] for r in rows), np.int32).reshape(len(rows), -1)
        vec = _unit([r[4] for r in rows])
        a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        if not len(a) or not len(b):
            return
        linked = np.zeros((len(rows), len(rows)), bool)
        part = _linked(vec[a], bands[a], vec[b], bands[b], table, threshold, width, sure)
        if lo == hi:
            np.fill_diagonal(part, False)
            part = part | part.T  # an estimate is of one side; either may have kept the pair
        linked[np.ix_(a, b)] = part
        linked |= linked.T
        some = linked.any(1)
        if not some.any():
            return
        at = np.arange(len(rows))
        while True:  # smallest row reachable: few rounds, each over the block
            new = np.minimum(at, np.where(linked, at[None, :], len(rows)).min(1))
            new = new[new]
            if (new == at).all():
                break
            at = new
        yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array((linked @ copies)[some]), pa.array(keys[at][some])], names=["_key", "links", "toward"])

    found = keep(dealt.mapInArrow(links, "_key long, links long, toward long"))
    counts = found.groupBy("_key").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("_key").alias("a"), F.col("toward").alias("b"))).withColumnRenamed("node", "_key")
    full = classes.select("_key", "copies", "least").join(counts, "_key", "left").join(joined, "_key", "left").withColumn("root", F.coalesce("component", "_key"))
    roots = full.groupBy("root").agg(F.min("least").alias("component_id"))
    per_class = full.join(roots, "root").select("_key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.where("_key is not null").join(per_class, "_key").select(id_col, "n_links", "component_id")
    alone = rows.where("_key is null").select(id_col, F.lit(0).cast(T.LongType()).alias("n_links"), F.col(id_col).alias("component_id"))
    out = linked.unionByName(alone).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    return out.select(F.col(id_col).cast(kind).alias(id_col), "n_links", "component_id", "kept")
