"""Source divergence audit over run-length columns.

Every (language, source) group is a column of term counts over its language's vocabulary.  The
vocabulary is put in the order that clusters equal counts: terms are compared column by column,
the column of the source with the fewest documents first.  The order is cut into stretches, in each
of which every column is run-length encoded.  The divergence of two sources is summed by
intersecting the run boundaries of their columns: inside a common run both counts stay the same,
so the term's value is taken once and multiplied by the run's length.

1. tasks count the words of each (group, term) and the documents that hold it before anything is
   shuffled; one shuffle by (language, term) adds the counts up and gives a term its counts
   by source, one entry for each source that has it;
2. terms in fewer than ``least_docs`` documents of their language go;
3. terms are range-partitioned in the order above, so a count that a third of the vocabulary shares
   is spread over many stretches;
4. pairs of columns meet by stretch and by blocks of ``block`` columns.

With p = 1 + floor(10^9 (count + 1) / (N + V)) of a group and q of another, a term's value is
floor((p - q)^2 / q), in whole numbers throughout (counts above 9.2e9 take wider integers).

Defined cases: null text, language and source are read as empty strings, so null and empty
sources are one group; a group without terms has N = 0 and still pairs; a language without
kept terms has value 0 in all pairs; a language with one source has no pairs; repeated rows and
null ids count as rows of their own; very long texts are a batch of their own; an empty table gives no rows;
columns other than the three are not read, so their names don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from briskbi.llm.shared import _LOWER, Words, cuts, keep, mix, steps, text_slices

#: (group, term) entries a task gathers before it sends them on, and rows of an Arrow batch.
FLUSH, ROWS = 1 << 20, 1 << 16
#: Entries (a term's count in a source) of a range partition, and of a stretch at most.
PART_ENTRIES, STRETCH = 250_000, 1 << 20
#: Groups up to which their table (about 60 bytes each) is broadcast; beyond it, joins shuffle.
MOST_BROADCAST = 100_000
SCALE = 1_000_000_000
_LETTERS = np.zeros(256, bool)
for _a, _b in ((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _LETTERS[_a : _b + 1] = True
_LOWER_BYTES = _LOWER.astype(np.uint8)


def _spelled(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of some ranges one after the other."""
    at = np.cumsum(sizes) - sizes
    return raw[np.arange(int(sizes.sum())) + np.repeat(starts - at, sizes)]


class _Entries:
    """Counts by (group, term) that a task has gathered."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, words: Words, gid: np.ndarray, lid: np.ndarray) -> None:
        if not len(words.starts):
            return
        doc = np.repeat(np.arange(len(gid)), words.counts())
        with np.errstate(over="ignore"):
            key = mix(words.hashes + (gid[doc].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")  # words of one key stay in the order of their documents
        key, by = key[order], doc[order]
        edge = cuts(key)
        new = np.ones(len(key), np.int64)
        new[1:] = (key[1:] != key[:-1]) | (by[1:] != by[:-1])
        one = order[edge[:-1]]
        size = words.ends[one] - words.starts[one]
        spelled = _LOWER_BYTES[_spelled(words.raw, words.starts[one], size)]
        self.parts.append((key[edge[:-1]], gid[doc[one]], lid[doc[one]], np.diff(edge), np.add.reduceat(new, edge[:-1]), size, spelled))
        self.size += len(one)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """All entries, one row for each (group, term)."""
        if not self.size:
            return
        key, gid, lid, n, docs, size, spelled = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        order = np.argsort(key, kind="stable")
        edge = cuts(key[order])[:-1]
        n, docs = np.add.reduceat(n[order], edge), np.add.reduceat(docs[order], edge)
        one, begin = order[edge], np.cumsum(size) - size
        for a in range(0, len(one), ROWS):
            part = one[a : a + ROWS]
            data = _spelled(spelled, begin[part], size[part])
            offsets = np.concatenate([[0], np.cumsum(size[part])]).astype(np.int32)
            term = pa.StringArray.from_buffers(len(part), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(lid[part], pa.int32()), term, pa.array(gid[part], pa.int32()), pa.array(n[a : a + ROWS], pa.int64()), pa.array(docs[a : a + ROWS], pa.int64())], names=["lid", "term", "gid", "n", "docs"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    entries = _Entries()
    for batch in steps(batches, "_text"):
        words = Words(batch.column(2), _LETTERS, lower=True)
        entries.add(words, batch.column(0).to_numpy(), batch.column(1).to_numpy())
        if entries.size >= FLUSH:
            yield from entries.rows()
    yield from entries.rows()


def group_table(docs: DataFrame, lang: str, source: str) -> DataFrame:
    """(lang, source, lid, gid, first, columns): a language's groups are numbered one after the other, fewest documents first."""
    named = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"))
    counted = named.groupBy("lang", "source").agg(F.count("*").alias("n_docs"))
    numbered = counted.select("lang", "source", (F.dense_rank().over(Window.orderBy("lang")) - 1).alias("lid"), (F.row_number().over(Window.orderBy("lang", "n_docs", "source")) - 1).alias("gid"))
    own = Window.partitionBy("lid")
    return numbered.select("*", F.min("gid").over(own).alias("first"), F.count("*").over(own).cast("int").alias("columns"))


def run_lengths(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, values) of the runs of a column of ``rows`` counts that are ``value`` at the ascending ``row`` and 0 elsewhere."""
    after = np.append(row[1:], -1)
    before = np.concatenate([[-1], row[:-1]])
    begins = np.ones(len(row), bool)
    begins[1:] = (row[1:] != before[1:] + 1) | (value[1:] != value[:-1])
    gap = row[(row + 1 != after) & (row + 1 < rows)] + 1
    lead = np.zeros(int(row[0] > 0), row.dtype)
    starts = np.concatenate([row[begins], gap, lead])
    values = np.concatenate([value[begins], np.zeros(len(gap) + len(lead), value.dtype)])
    order = np.argsort(starts, kind="stable")
    return starts[order], values[order]


_RUNS = "lid int, stretch long, rows int, gid int, starts binary, counts binary"


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms in order -> run-length columns of each stretch, without the columns that are 0 all over."""
    part, made = TaskContext.get().partitionId(), 0
    now, rows, held = None, 0, []

    def stretch() -> pa.RecordBatch:
        gid, row, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((row, gid))
        gid, row, n = gid[order], row[order], n[order]
        edge = cuts(gid)
        runs = [run_lengths(row[a:b], n[a:b], rows) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        m = len(runs)
        return pa.RecordBatch.from_arrays([pa.array([now] * m, pa.int32()), pa.array([(part << 32) + made] * m, pa.int64()), pa.array([rows] * m, pa.int32()), pa.array(gid[edge[:-1]], pa.int32()), pa.array([s.astype(np.int32).tobytes() for s, _ in runs], pa.binary()), pa.array([v.astype(np.int64).tobytes() for _, v in runs], pa.binary())], names=["lid", "stretch", "rows", "gid", "starts", "counts"])

    for batch in batches:
        lids, counts = batch.column(0).to_numpy(), batch.column(1)
        at = np.concatenate([[0], np.cumsum(np.asarray(counts.value_lengths()))])
        flat = counts.flatten()
        gid, n = -flat.field(0).to_numpy(), flat.field(1).to_numpy()
        edge = np.concatenate([[0], np.flatnonzero(lids[1:] != lids[:-1]) + 1, [len(lids)]]) if len(lids) else np.zeros(1, int)
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if held and (lids[a] != now or sum(len(x[0]) for x in held) >= STRETCH):
                yield stretch()
                rows, held, made = 0, [], made + 1
            now = int(lids[a])
            held.append((gid[at[a] : at[b]], np.repeat(np.arange(a, b), np.diff(at[a : b + 1])) - a + rows, n[at[a] : at[b]]))
            rows += int(b - a)
    if held:
        yield stretch()


def probability(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / (total + terms)), exact."""
    if len(count) and int(count.max()) >= 9_000_000_000:
        return np.array([1 + SCALE * (int(c) + 1) // (total + terms) for c in count], np.int64)
    return 1 + SCALE * (count.astype(np.int64) + 1) // (total + terms)


def value_of(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _paired(table: pa.Table) -> pa.Table:
    """A stretch's columns of two blocks -> what it adds to the value of each pair of them."""
    one = {c: table.column(c)[0].as_py() for c in ("lid", "bi", "bj", "rows")}
    columns = []
    for r in table.select(["gid", "block", "total", "terms", "starts", "counts"]).to_pylist():
        starts = np.frombuffer(r["starts"], np.int32) if r["starts"] is not None else np.zeros(1, np.int32)
        counts = np.frombuffer(r["counts"], np.int64) if r["counts"] is not None else np.zeros(1, np.int64)
        columns.append((r["gid"], r["block"], starts, probability(counts, r["total"], r["terms"])))
    here = [c for c in columns if c[1] == one["bi"]]
    there = [c for c in columns if c[1] == one["bj"]]
    a, b, value = [], [], []
    for x, _, starts, p in here:
        for y, _, others, q in there:
            if one["bi"] == one["bj"] and x >= y:
                continue
            bounds = np.union1d(starts, others)  # inside each of these runs both counts stay the same
            size = np.diff(np.append(bounds, one["rows"]))
            u = p[np.searchsorted(starts, bounds, side="right") - 1]
            v = q[np.searchsorted(others, bounds, side="right") - 1]
            a += [x, y]
            b += [y, x]
            value += [int((value_of(u, v) * size).sum()), int((value_of(v, u) * size).sum())]
    return pa.table({"lid": pa.array([one["lid"]] * len(a), pa.int32()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "value": pa.array(value, pa.int64())})


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 3, top_terms: int = 200, block: int = 64, slice_bytes: int = 16 << 20) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language, and by which terms.

    Part ``pair``: every other source of the language with the value summed over all kept terms; part
    ``term``: the ``top_terms`` terms that are likelier in the source than in its whole language.
    """
    slices = text_slices(docs, text, slice_bytes)
    groups = keep(group_table(docs, lang, source))
    few = groups.count() <= MOST_BROADCAST
    small = F.broadcast if few else (lambda df: df)  # a bounded table; with more groups Spark shuffles both sides

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).cast("string").alias("_text"))
    marked = rows.join(small(groups.select("lang", "source", "gid", "lid")), ["lang", "source"]).select("gid", "lid", "_text")
    entries = marked.mapInArrow(_counted, "lid int, term string, gid int, n long, docs long").repartition(slices, "lid", "term")
    by_source = entries.groupBy("lid", "term", "gid").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    gathered = by_source.groupBy("lid", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct((-F.col("gid")).alias("k"), "n")), asc=False).alias("counts"))
    terms = keep(gathered.where(F.col("docs") >= least_docs).select("lid", "term", "counts"))

    by_term = terms.select("lid", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("lang_n"), F.explode("counts").alias("e")).select("lid", "term", "lang_n", (-F.col("e.k")).alias("gid"), F.col("e.n").alias("n"))
    totals = by_term.groupBy("gid").agg(F.sum("n").alias("total"), F.count("*").alias("entries"))
    vocabulary = terms.groupBy("lid").agg(F.count("*").alias("terms"))
    stats = groups.join(totals, "gid", "left").join(vocabulary, "lid", "left").fillna(0, ["total", "entries", "terms"])
    stats = keep(stats.withColumn("lang_total", F.sum("total").over(Window.partitionBy("lid"))))

    n_entries = stats.agg(F.sum("entries")).first()[0] or 0
    order = ["lid", "counts", "term"]
    sorted_terms = terms.repartitionByRange(max(1, math.ceil(n_entries / PART_ENTRIES)), *order).sortWithinPartitions(*order)
    runs = keep(sorted_terms.select("lid", "counts").mapInArrow(_encoded, _RUNS))
    stretches = runs.groupBy("lid", "stretch").agg(F.max("rows").alias("rows"))
    numbered = stats.select("lid", "gid", "total", "terms", F.floor((F.col("gid") - F.col("first")) / block).cast("int").alias("block"), F.ceil(F.col("columns") / block).cast("int").alias("blocks"))
    columns = stretches.join(small(numbered), "lid").join(runs.drop("rows"), ["lid", "stretch", "gid"], "left")
    met = columns.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("other", "blocks")
    added = met.groupBy("lid", "stretch", "bi", "bj").applyInArrow(_paired, "lid int, a int, b int, value long")
    summed = added.groupBy("a", "b").agg(F.sum("value").alias("value"))
    names = stats.select("lid", "lang", "source", "gid")
    pairs = names.join(names.select("lid", F.col("gid").alias("b"), F.col("source").alias("item")), "lid").where("gid <> b")
    pairs = pairs.join(summed.withColumnRenamed("a", "gid"), ["gid", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    best_first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pairs.withColumn("rank", F.row_number().over(best_first))

    likely = lambda n, total: f"1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + 1 AS DECIMAL(20,0))) div CAST({total} + terms AS DECIMAL(20,0))"
    weighed = by_term.join(small(stats.select("gid", "total", "terms", "lang_total")), "gid").withColumn("p", F.expr(likely("n", "total"))).withColumn("q", F.expr(likely("lang_n", "lang_total"))).where("p > q")
    valued = weighed.select("gid", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    ranked = valued.withColumn("rank", F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("value"), F.asc("item")))).where(F.col("rank") <= top_terms)
    telling = ranked.join(small(names), "gid").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(telling)
