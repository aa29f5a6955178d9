"""Benchmark decontamination by winnowing.

Training texts and benchmark items are cut into words; of every window of
``window`` consecutive words the smallest ``k``-word hash (the rightmost of
equals) is the fingerprint.  Equal windows choose equal fingerprints, so every
span shared over a full window meets in the fingerprint lookup; each hit is then
extended to its window and compared word for word.

The benchmark's fingerprints go to every task while the items' text is below
``block_bytes``; a larger benchmark is dealt out in blocks of that size, which
visit the documents one after the other.  Documents are never shuffled.

Defined cases: a null or empty text has no words and no hits; an item with fewer
words than a window is one window by itself; an item without words (or null) never
occurs; null item ids are reported as null; repeated rows are judged each for itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from briskbi.llm.shared import ALNUM, Words, carried, cuts, shingles, steps

BLOCK_BYTES = 32 << 20
_LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` k-gram hashes, the index of its smallest (rightmost of equals)."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, width):
        new = grams[j : j + n]
        less = new <= best
        best[less] = new[less]
        at[less] = j
    return at + np.arange(n)


class Fingerprints:
    """Windows of benchmark items, found by their winnowed fingerprint."""

    def __init__(self, texts: list, window: int, k: int):
        words = Words(pa.array(texts, pa.string()), ALNUM, lower=True)
        by_length: dict[int, list] = {}
        for i, n in enumerate(words.counts()):
            if n:
                by_length.setdefault(min(int(n), window), []).append(i)
        self.classes = []
        for length, items in sorted(by_length.items()):
            kk = min(k, length)
            fp, whole, shift, item, text = [], [], [], [], []
            for i in items:
                a, b = int(words.first[i]), int(words.first[i + 1])
                h = words.hashes[a:b]
                grams, at = shingles(h, kk), None
                at = winnow(grams, length - kk + 1)
                fp.append(grams[at])
                whole.append(shingles(h, length))
                shift.append(at - np.arange(len(at)))
                item.append(np.full(len(at), i))
                text += [b" ".join(words.text(j) for j in range(a + s, a + s + length)).translate(_LOW) for s in range(len(at))]
            fp = np.concatenate(fp)
            order = np.argsort(fp, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[fp >> np.uint64(44)] = True
            self.classes.append((length, kk, fp[order], np.concatenate(whole)[order], np.concatenate(shift)[order], np.concatenate(item)[order], [text[j] for j in order], seen))

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, number of words, item) of each occurrence; words are numbered over the batch."""
        out = []
        of_text = np.repeat(np.arange(len(words.first) - 1), words.counts())
        for length, k, fp, whole, shift, item, text, seen in self.classes:
            grams = shingles(words.hashes, k)
            at = winnow(grams, length - k + 1)
            if not len(at):
                continue
            inside = of_text[: len(at)] == of_text[length - 1 : length - 1 + len(at)]
            chosen = at[inside]
            chosen = chosen[np.diff(chosen, prepend=-1) != 0]
            chosen = chosen[seen[grams[chosen] >> np.uint64(44)]]
            lo, hi = np.searchsorted(fp, grams[chosen]), np.searchsorted(fp, grams[chosen], side="right")
            hit = lo < hi
            chosen, lo, hi = chosen[hit], lo[hit], hi[hit]
            if not len(chosen):
                continue
            windows = shingles(words.hashes, length)
            for a in range(0, len(chosen), 4096):
                n = (hi - lo)[a : a + 4096]
                entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[a : a + 4096], n)
                start = np.repeat(chosen[a : a + 4096], n) - shift[entry]
                ok = (start >= 0) & (start < len(windows))
                start, entry = start[ok], entry[ok]
                ok = inside[start] & (windows[start] == whole[entry])
                for s, e in zip(start[ok].tolist(), entry[ok].tolist(), strict=True):
                    if b" ".join(words.text(j) for j in range(s, s + length)).translate(_LOW) == text[e]:
                        out.append((s, length, int(item[e])))
        found = np.array(sorted(set(out)), np.int64).reshape(-1, 3)
        return found[:, 0], found[:, 1], found[:, 2]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, k: int = 4, carry: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: id, carried columns, n_words, n_hit, items, spans.

    ``items`` holds the ids of the benchmark items of which a window occurs,
    ``spans`` the runs of hit words (start, length).  A carried column named like
    one of these is left out.  An empty benchmark gives no hits.
    """
    kept, own_columns = carried(docs, id_col, carry, ("n_words", "n_hit", "items", "spans"))
    base = docs.select(*own_columns, F.col(text).cast("string").alias("_text"))
    item_type = benchmark.schema[item_id].dataType
    items = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    out = base.withColumns({"_hits": F.lit(None).cast("binary"), "_items": F.array().cast(T.ArrayType(item_type))})
    schema = out.schema
    names = [id_col, *kept]
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block)
        rows = part.orderBy("i", "t").collect()  # at most about block_bytes of text
        index = Fingerprints([r["t"] for r in rows], window, k)
        mark = _marker(index, [r["i"] for r in rows])
        if block == blocks - 1:  # the last visit also sums up, in the same task
            final = _final_schema(schema, names, item_type)
            summed = _summed(names)
            return out.mapInArrow(lambda batches, mark=mark, summed=summed: summed(mark(batches)), final)
        out = out.mapInArrow(mark, schema)
    raise AssertionError("there is at least one block")


def _marker(index: Fingerprints, ids: list):
    """Task function: adds one block's hits to the words marked so far (a byte for each word) and its items.

    Spark sends a function of this size to each executor once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "_text"):
            names = batch.schema.names
            words = Words(batch.column(names.index("_text")), ALNUM, lower=True)
            mark = np.zeros(len(words.hashes) + 1, np.int64)
            start, length, item = index.find(words)
            np.add.at(mark, start, 1)
            np.add.at(mark, start + length, -1)
            hit = (np.cumsum(mark)[:-1] > 0).astype(np.uint8)
            of = np.searchsorted(words.first, start, side="right") - 1
            before, listed = batch.column(names.index("_hits")).to_pylist(), batch.column(names.index("_items")).to_pylist()
            hits = []
            for i in range(batch.num_rows):
                own = hit[words.first[i] : words.first[i + 1]]
                hits.append((own if before[i] is None else own | np.frombuffer(before[i], np.uint8)).tobytes())
            for i, j in sorted({(int(a), int(b)) for a, b in zip(of, item, strict=True)}):
                if ids[j] not in listed[i]:
                    listed[i].append(ids[j])
            columns = list(batch.columns)
            columns[names.index("_hits")] = pa.array(hits, pa.binary())
            columns[names.index("_items")] = pa.array(listed, batch.schema.field("_items").type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _final_schema(marked: T.StructType, names: list[str], item_type: T.DataType) -> T.StructType:
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
    fields = [T.StructField(c, f.dataType) for c, f in zip(names, marked, strict=False)]
    return T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(item_type)), T.StructField("spans", span)])


def _summed(names: list[str]):
    """Task function: the words' marks as counts and runs."""
    result = [*names, "n_words", "n_hit", "items", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))
            n_words, n_hit, spans = [], [], []
            for blob in col("_hits").to_pylist():
                hit = np.frombuffer(blob, np.uint8)
                edge = cuts(hit)
                n_words.append(len(hit))
                n_hit.append(int(hit.sum()))
                spans.append([{"start": int(a), "length": int(b - a)} for a, b in zip(edge[:-1], edge[1:], strict=True) if hit[a]])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), col("_items"), pa.array(spans, kind)], names=result)

    return run
