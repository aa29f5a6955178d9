"""Token counts by a two-tier lookup on the map side: no pre-token is ever shuffled.

A text is cut into pieces (pre-tokens) whose token counts add up.  First tier: a compact hash table
of frequent pieces and their lengths in tokens, learned from a small sample of the rows and broadcast.
Second tier: pieces the table lacks are looked up in a table of the Python worker, which outlives
a task; only pieces that neither knows go through the tokenizer.  The tables decide how fast a count is
found, never what it is: a piece's length is always the tokenizer's own.

Strings of added tokens inside a text count as the library's default has it: one token each, and the
text around them is encoded apart.

Defined cases: null and empty texts have no bytes and no tokens; a very long text is a batch of its own and a
long piece is encoded but not remembered; repeated rows and null ids give a row each; an empty
table gives none; carried columns named like a result column are left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from briskbi.llm.shared import carried, steps, text_bytes, worker_state
from briskbi.llm.tokens import PIECE_BYTES, PIECES, Coder, _Table

#: Pieces of the broadcast table at most: ten bytes each, so under 700 KB whatever the input.
ENTRIES = 65_536
#: Rows the table is learned from (about), and their longest text: under 16 MB reach the driver.
SAMPLE_ROWS, SAMPLE_BYTES = 1024, 16_384


def added_strings(path: str) -> tuple[list[str], bool]:
    """Strings of a tokenizer file's added tokens, and whether the library matches them in the text as it stands."""
    with open(path, encoding="utf-8") as f:
        kind = json.load(f)
    added = kind.get("added_tokens") or []
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and (not t["normalized"] or kind.get("normalizer") is None) for t in added)
    return [t["content"] for t in added if t["content"]], plain


class Counter:
    """Token counts of texts, with the library's default handling of added tokens' strings."""

    def __init__(self, path: str):
        self.coder = Coder(path)  # cuts texts into pieces; its own encoder reads added tokens as ordinary text
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added, self.plain = added_strings(path)
        longest_first = sorted(self.added, key=len, reverse=True)
        self.pattern = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None
        self.table, self.lengths = _Table(PIECES), np.zeros(PIECES, np.uint16)

    def _encoded(self, texts: list[str], library: bool = False) -> np.ndarray:
        tokenizer = self.library if library else self.coder.tokenizer
        return np.array([len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], np.int64)

    def _segments(self, col: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Texts cut at added tokens' strings, the row of each segment, and these strings' number per row."""
        odd = np.zeros(len(col), bool)
        for s in self.added:
            odd |= pc.match_substring(col, s).to_numpy(zero_copy_only=False)
        found = np.zeros(len(col), np.int64)
        if not odd.any():
            return col, np.arange(len(col)), found
        parts = {int(i): self.pattern.split(col[int(i)].as_py()) for i in np.flatnonzero(odd)}
        for i, p in parts.items():
            found[i] = len(p) - 1
        same = np.flatnonzero(~odd)
        segments = pa.concat_arrays([col.filter(pa.array(~odd)), pa.array([s for p in parts.values() for s in p], col.type)])
        return segments, np.concatenate([same, np.repeat(list(parts), [len(p) for p in parts.values()])]), found

    def _piece_lengths(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, frequent: Frequent | None) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64) if frequent is None else frequent.find(hashes)
        left = np.flatnonzero(out < 0)
        number = self.table.find(hashes[left])
        known = number >= 0
        out[left[known]] = self.lengths[number[known]]
        left = left[~known]
        if len(left):
            own, one, back = np.unique(hashes[left], return_index=True, return_inverse=True)
            one = left[one]
            got = self._encoded([raw[a:b].tobytes().decode() for a, b in zip(starts[one], ends[one], strict=True)])
            out[left] = got[back]
            kept = np.flatnonzero(ends[one] - starts[one] <= PIECE_BYTES)[: PIECES - self.table.n]  # a full table stays
            self.lengths[self.table.n : self.table.n + len(kept)] = got[kept]
            self.table.add(own[kept])
        return out

    def pieces(self, col: pa.Array) -> tuple:
        raw, starts, ends, hashes, first = self.coder._pieces(col)
        return raw, starts, ends, np.maximum(hashes, np.uint64(1)), first

    def count(self, col: pa.Array, frequent: Frequent | None = None) -> np.ndarray:
        """Tokens of each text; null counts as empty."""
        col = col.cast(pa.large_string()).fill_null("")
        if not self.plain or self.coder.white == "whole":
            return self._encoded(col.to_pylist(), library=True)
        segments, row, found = self._segments(col)
        raw, starts, ends, hashes, first = self.pieces(segments)
        total = np.concatenate([[0], np.cumsum(self._piece_lengths(raw, starts, ends, hashes, frequent))])
        np.add.at(found, row, total[first[1:]] - total[first[:-1]])
        return found


class Frequent:
    """The broadcast table, unpacked: token counts of frequent pieces by hash."""

    def __init__(self, hashes: bytes, lengths: bytes):
        self.lengths = np.frombuffer(lengths, np.uint16).astype(np.int64)
        self.table = _Table(max(1, len(self.lengths)))
        self.table.add(np.frombuffer(hashes, np.uint64))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        number = self.table.find(hashes)
        out = np.full(len(hashes), -1, np.int64)
        out[number >= 0] = self.lengths[number[number >= 0]]
        return out


def learn_frequent(docs: DataFrame, path: str, text: str = "text", rows: int = SAMPLE_ROWS, entries: int = ENTRIES) -> tuple[bytes, bytes]:
    """(hashes, token counts) of the most frequent pieces of about ``rows`` rows, drawn row by row over the whole table.

    Only rows of at most ``SAMPLE_BYTES`` bytes are drawn.  A piece that occurs once is left out.
    """
    total = docs.count()
    short = docs.select(F.col(text).cast("string").alias("_text")).sample(min(1.0, rows / max(1, total)), seed=11).where(F.octet_length("_text") <= SAMPLE_BYTES)
    counter = Counter(path)
    raw, starts, ends, hashes, _ = counter.pieces(pa.array([r["_text"] for r in short.collect()], pa.large_string()))
    own, one, n = np.unique(hashes, return_index=True, return_counts=True)
    top = np.argsort(-n, kind="stable")[:entries]
    top = top[(n[top] > 1) & (ends[one[top]] - starts[one[top]] <= PIECE_BYTES)]
    lengths = counter._encoded([raw[a:b].tobytes().decode() for a, b in zip(starts[one[top]], ends[one[top]], strict=True)])
    return own[top].tobytes(), lengths.astype(np.uint16).tobytes()


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", limit: int = 2048, carry: tuple[str, ...] = (), sample_rows: int = SAMPLE_ROWS, entries: int = ENTRIES) -> DataFrame:
    """One row per document row: id, carried columns, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    ``path`` is a file of the tokenizers library; no begin, end or other token is added, nothing is cut or padded.
    """
    kept, own = carried(docs, id_col, carry, ("n_bytes", "n_tokens", "over_limit"))
    rows = docs.select(*own, F.col(text).cast("string").alias("_text"))
    table = docs.sparkSession.sparkContext.broadcast(learn_frequent(docs, path, text, sample_rows, entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state("token_counts")
        if path not in state:
            state[path] = Counter(path)
        if state.get("broadcast") != table.value:
            state["broadcast"], state["frequent"] = table.value, Frequent(*table.value)
        counter, frequent = state[path], state["frequent"]
        for batch in steps(batches, "_text"):
            col = batch.column(batch.schema.get_field_index("_text"))
            size = np.diff(text_bytes(col)[1])
            n = counter.count(col, frequent)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=[id_col, *kept, "n_bytes", "n_tokens", "over_limit"])

    kinds = ", ".join(f"`{c}` {f.dataType.simpleString()}" for c, f in zip([id_col, *kept], rows.schema, strict=False))
    return rows.mapInArrow(run, f"{kinds}, n_bytes long, n_tokens long, over_limit boolean")
