"""Ranked lexical search by best positions over impact lists.

Every task builds, for shards of the documents it reads, one impact list for each term of the
queries: (impact, document) by descending impact, and the same postings by document for direct access.
A query reads its lists from the top, all in step.  A document met for the first time gets its
whole score by direct accesses to the other lists, which also mark its *position* in each of
them as seen.  A list's best position is the end of its unbroken run of seen positions from the top; it
lies at or below the last position read, so the sum of the impacts there is a tighter threshold for
documents not seen yet.  A query stops in a shard when that threshold is strictly below its k-th
score (an equal score could still win by its id) or its lists end.  The shards' best are merged by Spark, in
two steps, so no task gets all of a query's candidates.

Documents are not shuffled, and postings of words that no query has are not built.  The queries
go to the tasks in blocks of bounded size, one pass over the documents for each block; nothing is dropped.

A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))); its impact in a document of n terms is
(10^9 tf) div (1000 tf + 20 m) with m = 50 + (50 n N) div L.

Defined cases: null and empty texts have no terms: such documents rank nowhere and such
queries have no rows; documents with score 0 are left out; equal scores rank by ascending id, null ids
last; repeated rows of documents or queries are rows of their own; very long texts are a batch of their
own; without documents or queries there are no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from briskbi.llm.shared import ALNUM, Words, cuts, keep, small_batches, steps

#: Postings of a shard, bytes of text behind it at most (a longer single batch excepted).
POSTINGS, SHARD_BYTES = 3_000_000, 32 << 20
#: Bytes of query text, and queries, of a block.
BLOCK_BYTES, BLOCK_ITEMS = 1 << 20, 4096
#: First candidates of a query come together in so many groups.
GROUPS = 64


@dataclass
class Block:
    """Queries of one pass: the hashes of their terms, and each query's terms as numbers of these."""

    terms: np.ndarray
    queries: list

    @classmethod
    def of(cls, texts: list) -> Block:
        words = Words(pa.array(texts, pa.large_string()), ALNUM, lower=True)
        terms = np.unique(words.hashes)
        queries = [np.unique(np.searchsorted(terms, words.hashes[a:b])) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        return cls(terms, queries)

    def postings(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, occurrences) of the block's terms, and all terms of each document."""
        words = Words(col, ALNUM, lower=True)
        n = words.counts()
        if not len(self.terms) or not len(words.hashes):
            return *(np.zeros(0, np.int64) for _ in range(3)), n
        at = np.minimum(np.searchsorted(self.terms, words.hashes), len(self.terms) - 1)
        there = self.terms[at] == words.hashes
        doc = np.repeat(np.arange(len(n)), n)[there]
        both, tf = np.unique(doc * len(self.terms) + at[there], return_counts=True)
        return both // len(self.terms), both % len(self.terms), tf, n


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Impact of a term that occurs ``tf`` times in a document of ``n`` terms; always below a million."""
    m = 50 + (50 * n.astype(np.int64) * n_docs) // n_terms
    return ((1_000_000_000 * tf) // (1000 * tf + 20 * m)).astype(np.int32)


class Shard:
    """Impact lists of some documents, numbered in the order of their ids."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int, n_docs: int):
        order = np.lexsort((doc, -impact, term))
        self.first = np.searchsorted(term[order], np.arange(terms + 1))
        self.doc, self.impact = doc[order].astype(np.int32), impact[order]
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order)) - np.repeat(self.first[:-1], np.diff(self.first))
        by_doc = np.lexsort((doc, term))
        self.by_doc, self.place = doc[by_doc].astype(np.int32), place[by_doc]
        self.met = np.zeros(n_docs, bool)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the ``k`` best by score, then document number; fewer if fewer score above 0."""
        lists = [(int(a), int(b), int(w)) for a, b, w in zip(self.first[terms], self.first[terms + 1], weights, strict=True) if b > a and w > 0]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen = [np.zeros(b - a, bool) for a, b, _ in lists]
        best = [0] * len(lists)
        met, read, longest = [], 0, max((b - a for a, b, _ in lists), default=0)
        while read < longest:
            head = np.unique(np.concatenate([self.doc[a + read : min(b, a + read + step)] for a, b, _ in lists if read < b - a]))
            new = head[~self.met[head]]
            self.met[new] = True
            met.append(new)
            read, step = read + step, min(2 * step, 8192)
            if len(new):
                total = np.zeros(len(new), np.int64)
                for (a, b, w), mark in zip(lists, seen, strict=True):  # direct accesses
                    at = np.minimum(np.searchsorted(self.by_doc[a:b], new), b - a - 1)
                    hit = self.by_doc[a + at] == new
                    place = self.place[a + at[hit]]
                    total[hit] += w * self.impact[a + place].astype(np.int64)
                    mark[place] = True
                docs, scores = np.concatenate([docs, new]), np.concatenate([scores, total])
                if len(docs) > k:
                    top = np.lexsort((docs, -scores))[:k]
                    docs, scores = docs[top], scores[top]
            threshold = 0
            for i, ((a, _, w), mark) in enumerate(zip(lists, seen, strict=True)):
                rest = mark[best[i] :]
                if len(rest):
                    stop = int(np.argmin(rest))
                    best[i] += stop if not rest[stop] else len(rest)
                if best[i] < len(mark):  # no unseen document has more here than the best position
                    threshold += w * int(self.impact[a + best[i] - 1])
            if len(docs) >= k and threshold < scores.min():
                break
        for new in met:
            self.met[new] = False
        top = np.lexsort((docs, -scores))
        return docs[top][scores[top] > 0], scores[top][scores[top] > 0]


def statistics(texts: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """(documents with terms, terms with repeats, documents that hold each of the block's terms) of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = terms = 0
        df = np.zeros(len(block.terms), np.int64)
        for batch in steps(batches, "_text"):
            _, term, _, n = block.postings(batch.column(0))
            docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
            df += np.bincount(term, minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *some.tolist()], pa.int32()), pa.array([terms, docs, *df[some].tolist()], pa.int64())], names=["term", "n"])

    summed = {r["term"]: r["n"] for r in texts.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return summed.get(-1, 0), summed.get(-2, 0), np.array([summed.get(i, 0) for i in range(len(block.terms))], np.int64)


def _searched(docs: DataFrame, id_col: str, text: str, block: Block, k: int) -> DataFrame:
    """(query, id, score): each shard's best of every query of the block."""
    n_docs, n_terms, df = statistics(docs.select(F.col(text).cast("string").alias("_text")), block)
    weights = np.array([weight(n_docs, int(x)) if x else 0 for x in df], np.int64)

    def found(ids: list, parts: list) -> Iterator[pa.RecordBatch]:
        ids = pa.chunked_array(ids).combine_chunks()
        by_id = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        number = np.empty(len(ids), np.int64)
        number[by_id] = np.arange(len(ids))
        doc, term, impact = (np.concatenate(x) for x in zip(*parts, strict=True))
        shard = Shard(number[doc], term, impact, len(block.terms), len(ids))
        for a in range(0, len(block.queries), 256):
            got = [shard.search(q, weights[q], k) for q in block.queries[a : a + 256]]
            query = np.repeat(np.arange(a, a + len(got)), [len(d) for d, _ in got])
            best = by_id[np.concatenate([d for d, _ in got]).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), ids.take(pa.array(best)), pa.array(np.concatenate([s for _, s in got]), pa.int64())], names=["query", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, size, held, rows = [], [], 0, 0, 0
        for batch in steps(batches, "_text"):
            doc, term, tf, n = block.postings(batch.column(1))
            ids.append(batch.column(0))
            parts.append(((doc + rows).astype(np.int32), term.astype(np.int32), impacts(tf, n[doc], n_docs, n_terms) if len(doc) else np.zeros(0, np.int32)))
            rows, held, size = rows + batch.num_rows, held + len(doc), size + batch.column(1).nbytes
            if held >= POSTINGS or size >= SHARD_BYTES:
                yield from found(ids, parts)
                ids, parts, size, held, rows = [], [], 0, 0, 0
        if rows:
            yield from found(ids, parts)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"query int, id {docs.schema[id_col].dataType.simpleString()}, score long")


def _best(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text", k: int = 50) -> DataFrame:
    """(query id, rank, document id, score): the ``k`` best documents of every query row, fewer if fewer score above 0."""
    small_batches(docs.sparkSession)
    size = queries.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col(query_text).cast("string"))).alias("b")).first()
    blocks = max(1, math.ceil(size["n"] / BLOCK_ITEMS), math.ceil((size["b"] or 0) / BLOCK_BYTES))
    dealt = queries.select(F.col(query_id).alias("_item"), F.col(query_text).cast("string").alias("_text"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).alias("_block"))
    dealt = keep(dealt)  # a query's block must not change from one pass to the next
    kind = docs.sparkSession.createDataFrame([], f"query int, `{query_id}` {queries.schema[query_id].dataType.simpleString()}").schema
    made = []
    for b in range(blocks):  # one pass over the documents each
        rows = dealt.where(F.col("_block") == b).select("_item", "_text").collect()
        names = F.broadcast(docs.sparkSession.createDataFrame([(i, r["_item"]) for i, r in enumerate(rows)], kind))  # at most a block of ids
        candidates = _searched(docs, id_col, text, Block.of([r["_text"] for r in rows]), k)
        first = _best(candidates.withColumn("_group", F.spark_partition_id() % GROUPS), ["query", "_group"], k)
        ranked = _best(first.drop("rank", "_group"), ["query"], k).join(names, "query")
        ranked = ranked.select(query_id, "rank", F.col("id").alias(id_col), "score")
        made.append(ranked if blocks == 1 else keep(ranked))
    return reduce(DataFrame.unionByName, made)
