"""Token-id files: one zstandard frame per document, a shared dictionary, an offset index.

``write`` deals the documents out by ascending id.  A shard is two files in the
folder: ``shard-N.bin`` (magic, SHA-256 of the dictionary, then a frame for each
document: its ids, little-endian unsigned 32-bit, compressed by itself with the
shared dictionary) and ``shard-N.idx`` (an Arrow file: document id, byte offset,
frame bytes, tokens).  ``dictionary.zdict`` is trained on the serialised ids of
at most ``dictionary_docs`` documents of at most ``dictionary_bytes`` of text, those with the
smallest hash; it changes the size of the files, never what is read back.
``read_document`` fetches one document by its offset, ``read`` everything.

Files are written under a task's own name and then moved into place, so a task
that runs again leaves one whole file.  The folder must be one that the driver and all
executors reach (any URI that ``pyarrow.fs`` opens).

Defined cases: null or empty text: the end id alone; null ids come first; equal ids
keep all their rows, in the order of a hash of their text; an empty table gives
no shards and an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from briskbi.llm.shared import steps, text_slices
from briskbi.llm.tokens import coder

MAGIC = b"IDZSTD01"
DICTIONARY = "dictionary.zdict"
_HEAD = len(MAGIC) + 32


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _put(store: fs.FileSystem, path: str, data: bytes | list[bytes]) -> None:
    own = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        for part in [data] if isinstance(data, bytes) else data:
            f.write(part)
    _move(store, own, path)


def _move(store: fs.FileSystem, own: str, path: str) -> None:
    try:
        store.move(own, path)
    except OSError:  # some stores don't move onto a file that a lost task left
        store.delete_file(path)
        store.move(own, path)


def train_dictionary(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionary_sample(rows: DataFrame, id_col: str, most: int, longest: int) -> DataFrame:
    """At most ``most`` rows with a ``_text`` of at most ``longest`` bytes, chosen by a hash of id and text.

    A threshold on the hash leaves about twice as many of all rows, so what the tasks send to the
    driver doesn't grow with the table.  Long texts among those leave fewer than ``most`` rows.
    """
    total = rows.count()
    share = min(1.0, 2 * most / max(1, total))
    chance = F.shiftrightunsigned(F.xxhash64(id_col, "_text"), 1)
    few = (F.octet_length("_text") > 0) & (F.octet_length("_text") <= longest)
    if share < 1:
        few &= chance <= F.lit(int(share * (2**63 - 1)))
    return rows.where(few).orderBy("_hash", id_col).limit(most).select("_text")


def write(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int = 1, dictionary_docs: int = 512, dictionary_bytes: int = 16 << 10, shard_bytes: int = 16 << 20, level: int = 3) -> list[tuple[int, int, int]]:
    """Writes the files; returns (shard, documents, tokens) of every shard in ascending order (one small row each)."""
    rows = docs.select(F.col(id_col), F.col(text).cast("string").alias("_text"), F.xxhash64(F.col(text).cast("string")).alias("_hash"))
    sample = dictionary_sample(rows, id_col, dictionary_docs, dictionary_bytes).collect()
    ids, first = coder(tokenizer).encode(pa.array([r["_text"] for r in sample], pa.string()))
    dictionary = train_dictionary([ids[a:b].astype("<u4").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)])
    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    _put(store, f"{root}/{DICTIONARY}", dictionary)
    digest = hashlib.sha256(dictionary).digest()
    shards = text_slices(docs, text, shard_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encoder, compressor = coder(tokenizer), zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary))
        there, at = _open(folder)
        own, keys, sizes, tokens, out = f"{at}/shard-{shard:06d}.bin.{uuid.uuid4().hex}", [], [], [], None
        try:
            for batch in steps(batches, "_text"):
                if out is None:
                    out = there.open_output_stream(own)
                    out.write(MAGIC + digest)
                ids, first = encoder.encode(batch.column(1))
                for a, b in zip(first[:-1], first[1:], strict=True):
                    frame = compressor.compress(np.append(ids[a:b], np.uint32(end_id)).astype("<u4").tobytes())
                    out.write(frame)
                    sizes.append(len(frame))
                    tokens.append(int(b - a) + 1)
                keys.append(batch.column(0).take(pa.array(range(batch.num_rows))))  # a slice would hold the texts
        finally:
            if out is not None:
                out.close()
        if out is None:
            return
        offset = _HEAD + np.concatenate([[0], np.cumsum(sizes)[:-1]])
        index = pa.table({"id": pa.chunked_array(keys), "offset": pa.array(offset, pa.int64()), "bytes": pa.array(sizes, pa.int64()), "tokens": pa.array(tokens, pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, index.schema) as f:
            f.write_table(index)
        _put(there, f"{at}/shard-{shard:06d}.idx", sink.getvalue().to_pybytes())
        _move(there, own, f"{at}/shard-{shard:06d}.bin")
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(tokens)], pa.int64()), pa.array([sum(tokens)], pa.int64())], names=["shard", "docs", "tokens"])

    dealt = rows.repartitionByRange(shards, F.col(id_col).asc_nulls_first(), "_hash").sortWithinPartitions(F.col(id_col).asc_nulls_first(), "_hash")
    done = dealt.select(id_col, "_text").mapInArrow(run, "shard int, docs long, tokens long").collect()
    return sorted((r["shard"], r["docs"], r["tokens"]) for r in done)


def _index(store: fs.FileSystem, root: str, shard: int) -> pa.Table:
    with store.open_input_file(f"{root}/shard-{shard:06d}.idx") as f:
        return pa.ipc.open_file(f).read_all()


def _decoder(store: fs.FileSystem, root: str, f) -> zstandard.ZstdDecompressor:
    with store.open_input_file(f"{root}/{DICTIONARY}") as d:
        dictionary = d.read()
    if f.read(_HEAD) != MAGIC + hashlib.sha256(dictionary).digest():
        raise ValueError("the shard was not written with this folder's dictionary")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))


def read_document(folder: str, shard: int, row: int) -> np.ndarray:
    """The ids of one document: two small reads, whatever the shard's size."""
    store, root = _open(folder)
    entry = _index(store, root, shard).slice(row, 1).to_pylist()[0]
    with store.open_input_file(f"{root}/shard-{shard:06d}.bin") as f:
        decoder = _decoder(store, root, f)
        f.seek(entry["offset"])
        return np.frombuffer(decoder.decompress(f.read(entry["bytes"])), "<u4")


def read(spark: SparkSession, folder: str, shards: list[tuple[int, int, int]], id_type: str = "long", id_col: str = "doc_id", rows: int = 256) -> DataFrame:
    """One row per document: id, start (ids of all documents before it), n_tokens, ids (binary)."""
    base, listed = 0, []
    for shard, _, tokens in shards:
        listed.append((shard, base))
        base += tokens
    names = [id_col, "start", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for batch in batches:
            for shard, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                index = _index(store, root, shard)
                with store.open_input_file(f"{root}/shard-{shard:06d}.bin") as f:
                    decoder = _decoder(store, root, f)
                    for a in range(0, index.num_rows, rows):
                        part = index.slice(a, rows).combine_chunks()
                        ids = [decoder.decompress(f.read(n)) for n in part["bytes"].to_pylist()]
                        tokens = np.array([len(x) // 4 for x in ids], np.int64)
                        if tokens.tolist() != part["tokens"].to_pylist():
                            raise ValueError(f"shard {shard} does not hold what its index says")
                        starts = start + np.concatenate([[0], np.cumsum(tokens)[:-1]])
                        yield pa.RecordBatch.from_arrays([part["id"].combine_chunks() if isinstance(part["id"], pa.ChunkedArray) and part["id"].num_chunks != 1 else part["id"].chunk(0), pa.array(starts, pa.int64()), pa.array(tokens, pa.int64()), pa.array(ids, pa.binary())], names=names)
                        start += int(tokens.sum())

    source = spark.createDataFrame(listed, "shard int, base long").repartition(max(1, len(listed)), "shard")
    return source.mapInArrow(run, f"`{id_col}` {id_type}, start long, n_tokens long, ids binary")
