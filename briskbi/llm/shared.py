"""Helpers the text operators share: byte-level words, shingle hashes, packed rows.

Texts are handled as UTF-8 bytes with numpy inside Arrow tasks; Spark deals the
rows out.  A word hash is a multilinear sum over the word's bytes, a shingle hash
a multilinear sum over its word hashes; both end in a 64-bit finaliser.
"""

from __future__ import annotations

import math
import re
import sys
import uuid
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from briskbi.session import ensure_checkpoint_dir

#: Bytes of text handled at once in a task; a longer single text is a batch of its own.
STEP_BYTES = 1 << 20
#: Bytes of text behind one shuffled slice.
SLICE_BYTES = 8 << 20

_U = np.uint64


#: Bytes of an Arrow batch between Spark and Python; Spark's own default is 64 MB, twice for each running task.
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to ``ARROW_BYTES`` if it is larger: texts can be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)b?\s*", spark.conf.get(name).lower()).groups()
    size = int(number) << 10 * " kmgtp".index(unit or " ")
    if size <= 0 or size > ARROW_BYTES:  # 0 and less: no limit
        spark.conf.set(name, str(ARROW_BYTES))


def worker_state(name: str) -> dict:
    """A dictionary that outlives the task.  Functions reach the workers by value, with module
    globals of their own in every task; a module object of the interpreter stays."""
    return vars(sys.modules.setdefault("briskbi_worker_state", ModuleType("briskbi_worker_state"))).setdefault(name, {})


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and odd multipliers), element-wise."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + _U(seed) * _U(1 << 32)) * _U(0x9E3779B97F4A7C15)) | _U(1)


_BYTE = stream(1, 256)
_PLACE = stream(2, 4096)
_SHINGLE = stream(3, 64)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ALNUM = np.zeros(256, bool)
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _ALNUM[_a : _b + 1] = True
#: Bytes that belong to words: everything but ASCII white space, or ASCII letters, digits and all of non-ASCII.
SPACED, ALNUM = ~_WHITE, _ALNUM
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 32


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each text); null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


class Words:
    """Words of a batch of texts: byte ranges, hashes, and the first word of each text."""

    def __init__(self, col: pa.Array | pa.ChunkedArray, inside: np.ndarray = SPACED, lower: bool = False):
        self.raw, self.offsets = text_bytes(col)
        n = len(self.raw)
        word = inside[self.raw]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        self.starts = np.flatnonzero(word & (~before | edge[:n]))
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        #: Text i has the words first[i]:first[i + 1].
        self.first = np.searchsorted(self.starts, self.offsets)
        table = np.where(inside, _BYTE[_LOWER] if lower else _BYTE, _U(0))
        self.hashes = np.empty(len(self.starts), np.uint64)
        a = 0
        while a < len(self.starts):  # bounded temporaries, also for one very long text
            b = max(a + 1, int(np.searchsorted(self.starts, self.starts[a] + STEP_BYTES)))
            self.hashes[a:b] = self._hash(table, a, b)
            a = b

    def _hash(self, table: np.ndarray, a: int, b: int) -> np.ndarray:
        lo, hi = int(self.starts[a]), int(self.ends[b - 1])
        starts = self.starts[a:b] - lo
        place = np.arange(hi - lo) - np.repeat(starts, np.diff(np.append(starts, hi - lo)))
        with np.errstate(over="ignore"):
            weight = _PLACE[place & 4095]
            if len(place) and place.max() > 4095:
                weight = weight + (place >> 12).astype(np.uint64) * _U(0x9E3779B97F4A7C16)
            total = np.add.reduceat(table[self.raw[lo:hi]] * weight, starts)
            return mix(total + (self.ends[a:b] - self.starts[a:b]).astype(np.uint64) * _U(0xD6E8FEB86659FD93))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]].tobytes()


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive hashes (empty when there are fewer)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, _U(k))
    with np.errstate(over="ignore"):
        for j in range(k):
            total += hashes[j : j + n] * _SHINGLE[j]
    return mix(total)


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``size`` bytes of text (one text at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(off, off[a] + size, side="right")) - 1)
            yield batch.slice(a, b - a)
            a = b
    pa.default_memory_pool().release_unused()  # the worker goes on to other tasks


def carried(docs: DataFrame, id_col: str, carry: tuple[str, ...], made: tuple[str, ...]) -> tuple[list[str], list]:
    """Names to carry (without those of result columns), and the id and those columns under names of our own."""
    small_batches(docs.sparkSession)
    kept = [c for c in dict.fromkeys(carry) if c not in (id_col, *made)]
    return kept, [F.col(id_col).alias("_id"), *[F.col(c).alias(f"_carry{i}") for i, c in enumerate(kept)]]


def rows_of(schema: str, columns: dict) -> pa.RecordBatch:
    """A record batch whose columns are numpy arrays or lists, in the order given."""
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], names=list(columns))


def cuts(sorted_values: np.ndarray) -> np.ndarray:
    """Start of each run of equal values in a sorted array, and its length at the end."""
    n = len(sorted_values)
    if not n:
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [n]])


def text_slices(docs: DataFrame, text: str, slice_bytes: int = SLICE_BYTES) -> int:
    """Number of slices so that each stands for ``slice_bytes`` of text at every input size."""
    small_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    return max(12, math.ceil(total / slice_bytes))


def keep(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: the plan runs once and lineage ends here."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Intermediate results of one call: Parquet tables in the shared folder, each deleted when it is no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{ensure_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}", []

    def keep(self, df: DataFrame) -> DataFrame:
        """The same rows read from a table: the plan runs once and lineage ends here."""
        self.paths.append(f"{self.folder}/{len(self.paths)}")
        df.write.parquet(self.paths[-1])
        out = self.spark.read.schema(df.schema).parquet(self.paths[-1])
        out._table = self.paths[-1]
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later result reads."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._table)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(node, component) with the smallest node reachable over ``edges`` (a, b).

    Alternates large-star and small-star steps (one group-by each) until the
    edges no longer change; every step is checkpointed, or written to ``tables`` in place of the
    step before.  Nodes without edges do not appear.  A hub's neighbours are aggregated, never collected.
    """
    kept = tables.keep if tables else keep

    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        linked = both.join(least, "a")
        if large:
            return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        own = least.where("m < a").select("a", F.col("m").alias("b"))
        return linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).where("a <> b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = kept(edges.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).select("a", "b").distinct())
    old = mark(now)
    while old[0]:
        before, now = now, kept(stars(stars(now, True), False))
        if tables:
            tables.drop(before)
        new = mark(now)
        if new == old:
            break
        old = new
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = members.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))
    if not tables:
        return least
    out = tables.keep(least)
    tables.drop(now)
    return out


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
