"""Bounded-space online packing of token ids into sequences.

A partition keeps at most ``open_windows`` windows.  A document's full-length
pieces are sequences at once; its rest goes whole into the window it fits best.
When it fits in none, the fullest window takes what it can hold and is emitted,
and the rest of the piece looks again.  At the partition's end the windows left
over are merged: their pieces follow each other in sequences of full length, and
the remainder is cut at powers of two, so no sequence needs padding.

One pass over the partitions as they are read: no shuffle, and memory for the
open windows and one batch of texts.  ``sequence_id`` is the partition number
times 2^40 plus a counter; a recomputed partition gives the same ids.

Defined cases: null or empty text: the end id alone; null ids and repeated rows
are packed like any row; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from briskbi.llm.shared import small_batches, steps
from briskbi.llm.tokens import coder

PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Packer:
    """The open windows of one partition.  A piece is [document, start, ids, document's tokens]."""

    def __init__(self, length: int, open_windows: int, first_id: int):
        self.length, self.most, self.next_id = length, open_windows, first_id
        self.windows: list[list] = []
        self.room: list[int] = []

    def _emit(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            yield doc, start, ids, total, self.next_id, offset
            offset += len(ids)
        self.next_id += 1

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        total, start = len(ids), 0
        while total - start >= self.length:
            yield from self._emit([(doc, start, ids[start : start + self.length], total)])
            start += self.length
        while start < total:
            n = total - start
            best = min((i for i, r in enumerate(self.room) if r >= n), key=self.room.__getitem__, default=None)
            if best is None and len(self.room) < self.most:
                self.windows.append([])
                self.room.append(self.length)
                best = len(self.room) - 1
            if best is None:
                fullest = min(range(len(self.room)), key=self.room.__getitem__)
                cut = self.room.pop(fullest)
                window = self.windows.pop(fullest)
                window.append((doc, start, ids[start : start + cut], total))
                yield from self._emit(window)
                start += cut
                continue
            self.windows[best].append((doc, start, ids[start:].copy(), total))  # a view would hold the whole document
            self.room[best] -= n
            if not self.room[best]:
                self.room.pop(best)
                yield from self._emit(self.windows.pop(best))
            break

    def merge(self) -> Iterator[tuple]:
        left = [p for w in self.windows for p in w]
        tokens = sum(len(p[2]) for p in left)
        self.windows, self.room = [], []
        sizes = [self.length] * (tokens // self.length)
        sizes += [1 << b for b in reversed(range(self.length.bit_length())) if (tokens % self.length) >> b & 1]
        i, used = 0, 0
        for size in sizes:
            pieces, need = [], size
            while need:
                doc, start, ids, total = left[i]
                take = min(need, len(ids) - used)
                pieces.append((doc, start + used, ids[used : used + take], total))
                need -= take
                used += take
                if used == len(ids):
                    i, used = i + 1, 0
            yield from self._emit(pieces)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", length: int = 1024, open_windows: int = 64, end_id: int = 0) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = coder(tokenizer)
        packer = Packer(length, open_windows, TaskContext.get().partitionId() << 40)
        arrow = None

        def out(pieces: list) -> pa.RecordBatch:
            doc, start, ids, total, sequence, offset = zip(*pieces, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(doc, arrow), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(total, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        for batch in steps(batches, "_text"):
            arrow = batch.column(0).type
            ids, first = encoder.encode(batch.column(1))
            pieces = []
            for i, doc in enumerate(batch.column(0).to_pylist()):
                pieces.extend(packer.add(doc, np.append(ids[first[i] : first[i + 1]], np.uint32(end_id))))
            if pieces:
                yield out(pieces)
        if arrow is not None and (pieces := list(packer.merge())):
            yield out(pieces)

    return rows.mapInArrow(run, f"`{id_col}` {kind}, {PIECES}")
