"""Substring duplicates by relative Lempel-Ziv parsing against reference blocks.

Every document is factored against the blocks of all documents (its own included).
A factor is a stretch of at least ``window`` words that stands, word for word, at
another place too: (start, length, source, source_start).  Three steps, each one hash shuffle:

1. index: of every window the smallest ``anchor``-word hash is its anchor, so equal
   windows share an anchor at the same place; anchors that occur twice anywhere are the
   places where factors can start, all other text is left out;
2. blocks: each block (a slice of the hashes) holds the places of its windows.  The windows
   of step 1 are looked up there, also those across the borders of factors, and
   each gets a source: the first place of the same words, the first place itself the second;
3. factors: from left to right a factor goes on as long as its source goes on word for
   word; then the next one starts.  Words that factors cover go.

A literal parse, whose next factor starts where the last one ended, misses windows that
lie across two factors; here such a window is a factor of its own, so factors may overlap.

Rows in the shuffles are packed binary slices of about ``slice_bytes`` of text.
A window that repeats inside one task gets its source there and is sent on once, so a
passage in a third of all documents reaches its block once for each task.

Defined cases: null or empty text has no words; texts shorter than a window lose
nothing; the same row twice loses every word of every full window in both, and is its own source;
very long texts are one row of a bucket; extra columns are carried only on request.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from briskbi.llm.decontaminate import winnow
from briskbi.llm.shared import SLICE_BYTES, Words, carried, cuts, shingles, steps, text_slices

#: Entries a task gathers before it sends them on.
FLUSH = 1 << 20
#: In a position sent to a block: the task has given this hash's places their sources itself.
_DECIDED = np.uint32(1 << 31)
_PACKED = "part int, data binary"
_PLACE = (np.uint64, np.uint32)  # document key, position
_ENTRY = (np.uint64, *_PLACE)  # hash, then its place
_FACTOR = (*_PLACE, np.uint32, *_PLACE)  # first window, number of windows, its source


def _pack(columns: list[np.ndarray]) -> bytes:
    return b"".join(c.tobytes() for c in columns)


def _unpack(blobs: list[bytes], kinds: tuple) -> list[np.ndarray]:
    size = sum(np.dtype(k).itemsize for k in kinds)
    parts = []
    for blob in blobs:
        n, at, columns = len(blob) // size, 0, []
        for k in kinds:
            columns.append(np.frombuffer(blob, k, n, at))
            at += n * np.dtype(k).itemsize
        parts.append(columns)
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, k) for k in kinds]


def _grow(key: np.ndarray, pos: np.ndarray, n: np.ndarray, source: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Factors by key and position: neighbours whose sources are neighbours too become one,
    what lies inside an earlier factor of its document goes."""
    if not len(key):
        return [key, pos, n, source, at]
    order = np.lexsort((-n.astype(np.int64), pos, key))
    key, pos, n, source, at = (c[order] for c in (key, pos, n, source, at))
    document = np.repeat(np.arange(len(cuts(key)) - 1, dtype=np.int64), np.diff(cuts(key))) << 33
    end = np.maximum.accumulate(document + pos + n)
    new = np.concatenate([[True], (document + pos + n)[1:] > end[:-1]])
    key, pos, n, source, at = (c[new] for c in (key, pos, n, source, at))
    on = (key[1:] == key[:-1]) & (source[1:] == source[:-1]) & (pos[1:] == pos[:-1] + n[:-1]) & (at[1:] == at[:-1] + n[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~on]))
    return [key[first], pos[first], np.add.reduceat(n, first, dtype=np.uint32), source[first], at[first]]


def _sources(size: np.ndarray) -> np.ndarray:
    """For places sorted by hash, in runs of these sizes: where the source of each is (itself, if it has none)."""
    first = np.cumsum(size) - size
    source = np.repeat(first, size)
    source[first[size > 1]] += 1
    return source


def _return(columns: list[np.ndarray], buckets: int) -> Iterator[tuple[int, bytes]]:
    """Packed rows of places or factors, each to the bucket of its document."""
    bucket = np.mod(columns[0].view(np.int64), buckets)  # as pmod in Spark
    order = np.lexsort((columns[1], columns[0], bucket))
    bucket, columns = bucket[order], [c[order] for c in columns]
    at = cuts(bucket)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b > a:
            yield int(bucket[a]), _pack([c[a:b] for c in columns])


def _found(key: np.ndarray, pos: np.ndarray, source: np.ndarray, of: np.ndarray, sourced: bool) -> list[np.ndarray]:
    """Columns to return for the places ``of``; with sources, as factors."""
    if not sourced:
        return [key[of], pos[of]]
    return _grow(key[of], pos[of], np.ones(len(of), np.uint32), key[source[of]], pos[source[of]])


def _send(hashes: np.ndarray, key: np.ndarray, pos: np.ndarray, slices: int, buckets: int, sourced: bool) -> Iterator[tuple[int, bytes]]:
    """Packed rows: one place of each hash goes to the hash's block; places of hashes seen
    twice here are decided and go to their document's bucket."""
    order = np.argsort(hashes, kind="stable")
    hashes, key, pos = hashes[order], key[order], pos[order]
    edge = cuts(hashes)
    size = np.diff(edge)
    first = edge[:-1]
    out = hashes[first], key[first], np.where(size > 1, pos[first] | _DECIDED, pos[first])
    part = ((out[0] >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)
    at = cuts(part)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b > a:
            yield int(part[a]), _pack([c[a:b] for c in out])
    again = np.flatnonzero(np.repeat(size > 1, size))
    for bucket, data in _return(_found(key, pos, _sources(size), again, sourced), buckets):
        yield slices + bucket, data


class _Buffer:
    def __init__(self, slices: int, buckets: int, sourced: bool):
        self.slices, self.buckets, self.sourced, self.parts, self.n = slices, buckets, sourced, [], 0

    def add(self, hashes: np.ndarray, keys: np.ndarray, pos: np.ndarray) -> None:
        self.parts.append((hashes, keys, pos.astype(np.uint32)))
        self.n += len(hashes)

    def rows(self) -> pa.RecordBatch:
        h, k, p = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.n = [], 0
        return _batch(_send(h, k, p, self.slices, self.buckets, self.sourced))


def _batch(rows: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    parts, data = zip(*rows, strict=True) if (rows := list(rows)) else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])


def _resolver(slices: int, buckets: int, sourced: bool):
    """Task function on packed rows by part: places whose hash occurs a second time, by document bucket."""

    def decide(blobs: list[bytes]) -> pa.RecordBatch:
        h, k, p = _unpack(blobs, _ENTRY)
        own = p & ~_DECIDED
        order = np.lexsort((own, k, h))  # all blocks take the same document as the first one
        h, k, own, decided = h[order], k[order], own[order], p[order] >= _DECIDED
        size = np.diff(cuts(h))
        open_ = np.flatnonzero(np.repeat(size > 1, size) & ~decided)
        return _batch(_return(_found(k, own, _sources(size), open_, sourced), buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part >= slices:
                    yield _batch(iter([(part - slices, data)]))
                    continue
                if part != now and blobs:
                    yield decide(blobs)
                    blobs = []
                now = part
                blobs.append(data)
        if blobs:
            yield decide(blobs)

    return run


def _second_places(packed: DataFrame, slices: int, buckets: int, sourced: bool) -> DataFrame:
    """What the blocks find, dealt by document bucket."""
    dealt = packed.repartition(slices, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(_resolver(slices, buckets, sourced), _PACKED).withColumnRenamed("part", "_bucket").repartition(buckets, "_bucket")


def _windows(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hashes, anchor of each window start, whether that window lies in one text)."""
    grams = shingles(words.hashes, anchor)
    at = winnow(grams, window - anchor + 1)
    of = np.repeat(np.arange(len(words.first) - 1), words.counts())
    return grams, at, of[: len(at)] == of[window - 1 : window - 1 + len(at)] if len(at) else np.zeros(0, bool)


def _marked(words: Words, keys: np.ndarray, k: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Per word: whether its position is among the places (sorted by key) of its text."""
    mark = np.zeros(len(words.hashes), bool)
    lo, hi = np.searchsorted(k, keys), np.searchsorted(k, keys, side="right")
    for i in np.flatnonzero(lo < hi):
        mark[words.first[i] + p[lo[i] : hi[i]].astype(np.int64)] = True
    return mark


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 35, anchor: int = 10, carry: tuple[str, ...] = (), slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per document row: id, carried columns, n_words, n_removed, kept_text, spans, row_key, factors.

    A word goes when a window of ``window`` words that covers it also starts at
    another place of any document.  ``spans`` are the removed runs (start, length)
    in words, ``kept_text`` the other words joined by one space.  ``factors`` are the parse:
    (start, length, source, source_start) in words; the source is the row with that ``row_key``, or
    an equal row.  Which of several sources a factor names may depend on the partitioning, the spans
    never do.  A carried column named like a result column is left out.
    """
    kept, own_columns = carried(docs, id_col, carry, ("n_words", "n_removed", "kept_text", "spans", "row_key", "factors"))
    slices = buckets = text_slices(docs, text, slice_bytes)
    own = F.xxhash64(F.col(id_col), F.col(text))
    plain = docs.select(*own_columns, F.col(text).cast("string").alias("_text"), own.alias("_key"), F.pmod(own, F.lit(buckets)).cast("int").alias("_bucket"))
    dealt = plain.repartition(buckets, "_bucket")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = _Buffer(slices, buckets, False)
        for batch in steps(batches, "_text"):
            words = Words(batch.column(1))
            grams, at, inside = _windows(words, window, anchor)
            at = at[inside]
            at = at[np.diff(at, prepend=-1) != 0]
            of = np.searchsorted(words.first, at, side="right") - 1
            buffer.add(grams[at], batch.column(0).to_numpy().view(np.uint64)[of], at - words.first[of])
            if buffer.n >= FLUSH:
                yield buffer.rows()
        if buffer.n:
            yield buffer.rows()

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        k, p = _unpack(right.column("data").to_pylist(), _PLACE)
        order = np.argsort(k, kind="stable")
        k, p = k[order], p[order]
        buffer, out = _Buffer(slices, buckets, True), []
        if len(k) and left.num_rows:
            left = left.select(["_key", "_text"]).filter(pa.array(np.isin(left.column("_key").to_numpy().view(np.uint64), k)))
            for batch in steps(iter(left.combine_chunks().to_batches()), "_text"):
                words = Words(batch.column(1))
                keys = batch.column(0).to_numpy().view(np.uint64)
                _, at, inside = _windows(words, window, anchor)
                start = np.flatnonzero(inside & _marked(words, keys, k, p)[at]) if len(at) else np.zeros(0, np.int64)
                of = np.searchsorted(words.first, start, side="right") - 1
                whole = shingles(words.hashes, window)
                buffer.add(whole[start], keys[of], start - words.first[of])
                if buffer.n >= FLUSH:
                    out.append(buffer.rows())
            if buffer.n:
                out.append(buffer.rows())
        return pa.Table.from_batches(out, pa.schema([("part", pa.int32()), ("data", pa.binary())]))

    def structs(*names: str) -> T.ArrayType:
        return T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in names]))

    fields = [T.StructField(c, f.dataType) for c, f in zip([id_col, *kept], dealt.schema, strict=False)]
    made = [("n_words", T.LongType(), pa.int64()), ("n_removed", T.LongType(), pa.int64()), ("kept_text", T.StringType(), pa.string())]
    for name, parts in (("spans", ("start", "length")), ("factors", ("start", "length", "source", "source_start"))):
        made.append((name, structs(*parts), pa.list_(pa.struct([(x, pa.int64()) for x in parts]))))
    made.insert(4, ("row_key", T.LongType(), pa.int64()))
    schema = T.StructType([*fields, *(T.StructField(n, t) for n, t, _ in made)])
    names = [f.name for f in schema]

    def spans(left: pa.Table, right: pa.Table) -> pa.Table:
        k, *rest = _grow(*_unpack(right.column("data").to_pylist(), _FACTOR))
        p, n, source, source_at = (c.astype(np.int64) for c in rest)
        out = []
        for batch in steps(iter(left.combine_chunks().to_batches()), "_text"):
            words = Words(batch.column(batch.schema.names.index("_text")))
            own_key = batch.column(batch.schema.names.index("_key"))
            keys = own_key.to_numpy().view(np.uint64)
            lo, hi = np.searchsorted(k, keys), np.searchsorted(k, keys, side="right")
            cover = np.zeros(len(words.hashes) + 1, np.int64)
            for i in np.flatnonzero(lo < hi):
                at = words.first[i] + p[lo[i] : hi[i]]
                np.add.at(cover, at, 1)
                np.add.at(cover, at + n[lo[i] : hi[i]] + window - 1, -1)
            gone = np.cumsum(cover)[:-1] > 0
            n_removed, texts, runs, factors = [], [], [], []
            for i in range(batch.num_rows):
                cut = gone[int(words.first[i]) : int(words.first[i + 1])]
                removed = int(cut.sum())
                all_words = words.raw[words.offsets[i] : words.offsets[i + 1]].tobytes().split()
                n_removed.append(removed)
                texts.append(b" ".join(all_words if not removed else [w for w, g in zip(all_words, cut.tolist(), strict=True) if not g]).decode())
                edge = cuts(cut) if removed else [0]
                runs.append([{"start": int(x), "length": int(y - x)} for x, y in zip(edge[:-1], edge[1:], strict=True) if cut[x]])
                own_factors = zip(*(c[lo[i] : hi[i]].tolist() for c in (p, n, source, source_at)), strict=True)
                factors.append([{"start": x, "length": y + window - 1, "source": z, "source_start": w} for x, y, z, w in own_factors])
            result = words.counts(), n_removed, texts, runs, own_key, factors
            out.append(pa.RecordBatch.from_arrays([*batch.columns[: len(kept) + 1], *(pa.array(x, kind) if not isinstance(x, pa.Array) else x for x, (_, _, kind) in zip(result, made, strict=True))], names=names))
        kinds = [*(left.schema.field(i).type for i in range(len(kept) + 1)), *(kind for _, _, kind in made)]
        return pa.Table.from_batches(out, pa.schema(list(zip(names, kinds, strict=True))))

    index = _second_places(plain.select("_key", "_text").mapInArrow(anchors, _PACKED), slices, buckets, False)
    looked_up = dealt.groupBy("_bucket").cogroup(index.groupBy("_bucket")).applyInArrow(windows, _PACKED)
    twice = _second_places(looked_up, slices, buckets, True)
    return dealt.groupBy("_bucket").cogroup(twice.groupBy("_bucket")).applyInArrow(spans, schema)
