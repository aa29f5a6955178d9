"""Toxicity by a gap-weighted subsequence string kernel, Nyström landmarks and a linear SVM.

The kernel of two strings sums over common subsequences of ``order`` characters,
each weighted by ``decay`` for every character of the stretch it spans, so an
insult still matches with characters inserted or left out.  Landmarks are
character strings of toxic training texts that clean ones lack; a word's features
are its kernel values with the landmarks times the inverse root of the landmarks'
kernel matrix.  A sentence is represented by its strongest word.  All sentences of
clean texts are negatives, the sentences of toxic texts that hold a landmark
are positives.  A text scores as its strongest sentence.

Fitting takes at most ``train_docs`` labelled texts of each class, those with the
smallest id hash and at most ``train_bytes`` of text (a documented, fixed bound: it
happens on the driver).  Scoring reads every whole text, in one pass without a shuffle.

Defined cases: null and empty texts have no words and get the score of the bias;
labels that are null are not used; without labels of both classes every score is 0;
characters set apart by white space (four or more in a row) are also read as one word, and so are
pieces between white space that make up a landmark from a word's start to a word's end;
long words are read in overlapping pieces; repeated rows score alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from briskbi.llm.shared import Words, carried, steps, worker_state
from briskbi.llm.tokens import _Table

#: Words a worker remembers the value of, and the longest piece of a word that the kernel sees.
REMEMBERED, PIECE = 500_000, 40
_SENTENCE = re.compile(r"[.!?\n]+\s|\n")


def _codes(words: list[str], alphabet: dict[str, int], width: int) -> np.ndarray:
    """Letters of words as landmark letters (0: no landmark has it; -1: past the end)."""
    if not words:
        return np.zeros((0, width), np.int8)
    chars = np.array([w[:width] for w in words], f"<U{width}").view(np.uint32).reshape(len(words), width)
    out = np.zeros(chars.shape, np.int8)
    for letter, code in alphabet.items():
        out[chars == ord(letter)] = code
    out[chars == 0] = -1
    return out


def common_letters(words: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each coded word and landmark (at most 63 letters), by bit rows."""
    b, m = len(words), len(landmarks)
    letters = int(max(words.max(initial=0), landmarks.max(initial=0))) + 1
    place = np.zeros((letters, m), np.uint64)  # bit j of a letter: landmark letter j is that letter
    for j in range(landmarks.shape[1]):
        some = np.flatnonzero(landmarks[:, j] > 0)
        place[landmarks[some, j], some] |= np.uint64(1 << j)
    row = np.full((b, m), np.uint64((1 << 64) - 1))
    with np.errstate(over="ignore"):
        for i in range(words.shape[1]):
            met = row & place[np.maximum(words[:, i], 0)]
            row = (row + met) | (row - met)
    return np.bitwise_count(~row)


def subsequence_kernel(words: np.ndarray, landmarks: np.ndarray, order: int, decay: float) -> np.ndarray:
    """Kernel matrix of coded words and landmarks; an unbroken common run of ``order`` letters counts 1.

    A pair without a common subsequence of ``order`` letters has value 0, so the sums are
    made only for the pairs that have one.
    """
    width = landmarks.shape[1]
    total = np.zeros((len(words), len(landmarks)), np.float32)
    word, landmark = np.nonzero(common_letters(words, landmarks) >= order)
    if not len(word):
        return total
    words, landmarks = words[word], landmarks[landmark]
    value = np.zeros(len(words), np.float32)
    # state[q][j]: weight of common subsequences of q letters that end before landmark letter j
    state = [[np.zeros(len(words), np.float32) for _ in range(width + 1)] for _ in range(order)]
    for i in range(words.shape[1]):
        letter = words[:, i]
        if (letter < 0).all():
            break
        same = [(letter == landmarks[:, j]) & (letter > 0) for j in range(width)]
        for j in range(order - 1, width):
            value += same[j] * state[order - 1][j] if order > 1 else same[j]
        for q in range(order - 1, 0, -1):
            run = np.zeros(len(words), np.float32)
            for j in range(width):
                run = run * np.float32(decay) + (same[j] * state[q - 1][j] if q > 1 else same[j])
                state[q][j + 1] = state[q][j + 1] * np.float32(decay) + run
    total[word, landmark] = value
    return total


def self_kernel(words: np.ndarray, order: int, decay: float) -> np.ndarray:
    """The kernel of each word with itself, over the letters that landmarks have."""
    width = words.shape[1]
    total = np.zeros(len(words), np.float32)
    state = np.zeros((order, width + 1, len(words)), np.float32)
    for i in range(width):
        same = (words[:, i] > 0) & (words.T == words[:, i])
        total += (same * state[order - 1, :-1]).sum(0) if order > 1 else same.sum(0)
        for q in range(order - 1, 0, -1):
            run = np.zeros(len(words), np.float32)
            gain = same * state[q - 1, :-1] if q > 1 else same.astype(np.float32)
            state[q] *= decay
            for j in range(width):
                run = run * np.float32(decay) + gain[j]
                state[q, j + 1] += run
    return total


@dataclass
class Model:
    alphabet: dict
    landmarks: np.ndarray
    scale: np.ndarray
    mapping: np.ndarray
    weights: np.ndarray
    bias: float
    order: int
    decay: float

    def features(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), 2 * len(self.landmarks)), np.float32)
        if not words:
            return out
        size = np.array([min(len(w), PIECE) for w in words])
        for a in range(0, len(words), 16384):
            by_size = np.argsort(size[a : a + 16384], kind="stable") + a
            for part in np.array_split(by_size, 8):
                if len(part):
                    coded = _codes([words[i] for i in part], self.alphabet, max(1, int(size[part].max())))
                    kernel = subsequence_kernel(coded, self.landmarks, self.order, self.decay)
                    some = np.flatnonzero(kernel.any(axis=1))  # a word unlike all landmarks has the features 0
                    out[part[some]] = self._mapped(kernel[some], self_kernel(coded[some], self.order, self.decay))
        return out

    def _mapped(self, kernel: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Nyström features of two scalings of the kernel: by both strings' length, and so that a
        word that holds a landmark whole weighs the same whatever its length."""
        near = kernel / self.scale
        alike = near / np.sqrt(np.maximum(1, own))[:, None]
        return np.hstack([alike @ self.mapping, (near / np.maximum(1, near.max(axis=1, keepdims=True))) @ self.mapping])

    def values(self, words: list[str]) -> np.ndarray:
        """Decision value of each word; a long word takes its best piece."""
        pieces, of = [], []
        for i, w in enumerate(words):
            for a in range(0, max(1, len(w) - PIECE // 2), PIECE // 2):
                pieces.append(w[a : a + PIECE])
                of.append(i)
        out = np.full(len(words), -np.inf, np.float32)
        np.maximum.at(out, of, self.features(pieces) @ self.weights + np.float32(self.bias))
        return out


def _landmarks(sentences: list[list[list[str]]], toxic: list[set[str]], clean: list[set[str]], most: int, shortest: int, longest: int) -> list[str]:
    """Strings of ``shortest`` to ``longest`` letters that toxic texts have in many places and clean ones hardly.

    A place is a word with its neighbours, so copies of a text do not add up; a word's count is
    that of its places or its texts, whichever is smaller.
    """
    def grams(word: str) -> set[str]:
        return {word[i : i + n] for n in range(shortest, longest + 1) for i in range(len(word) - n + 1)}

    common = Counter(w for t in clean for w in t)
    places: dict = {}
    holders = Counter(w for t in toxic for w in t)
    for t in sentences:
        for x in t:
            for before, w, after in zip(["", *x], x, [*x[1:], ""], strict=False):
                places.setdefault(w, set()).add(hash((before, after)))  # a number takes less than the pair
    least = max(8, len(toxic) // 100)
    places = {w: min(len(p), holders[w]) for w, p in places.items()}
    strange = {w for w, c in places.items() if c >= least and c / len(toxic) > 4 * common[w] / max(1, len(clean))}
    texts: dict[str, set[int]] = {}
    found: Counter = Counter()
    for i, t in enumerate(toxic):
        for w in t & strange:
            for g in grams(w):
                texts.setdefault(g, set()).add(i)
    for w in strange:
        for g in grams(w):
            found[g] += places[w]
    against: Counter = Counter()
    for w, c in common.items():
        for g in grams(w) & texts.keys():
            against[g] += c
    ranked = sorted((g for g in texts if found[g] / len(toxic) > 20 * against[g] / max(1, len(clean))), key=lambda g: (-found[g], -len(g), g))
    chosen: list[str] = []
    for g in ranked:
        inner = {g[i : i + shortest] for i in range(len(g) - shortest + 1)}
        alike = [c for c in chosen if any(x in c for x in inner)]
        if not any(len(texts[g] - texts[c]) < least for c in alike):
            chosen.append(g)
        if len(chosen) == most:
            break
    return chosen


def train_svm(x: np.ndarray, y: np.ndarray, seen: np.ndarray, cost: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps; rows count as often as ``seen``."""
    share = cost * seen
    ridge = np.eye(x.shape[1] + 1)
    ridge[-1, -1] = 1e-6
    w, active = np.zeros(x.shape[1] + 1), np.ones(len(x), bool)
    for _ in range(rounds):
        square, right = ridge.copy(), np.zeros(len(w))
        for a in range(0, len(x), 8192):  # wide numbers for a block of rows at a time
            on = np.flatnonzero(active[a : a + 8192]) + a
            xa = np.hstack([x[on], np.ones((len(on), 1), x.dtype)]).astype(np.float64)
            square += (xa.T * share[on]) @ xa
            right += xa.T @ (share[on] * y[on])
        w = np.linalg.solve(square, right)
        now = np.concatenate([y[a : a + 8192] * (x[a : a + 8192].astype(np.float64) @ w[:-1] + w[-1]) < 1 for a in range(0, len(x), 8192)])
        if (now == active).all():
            break
        active = now
    return w[:-1].astype(np.float32), float(w[-1])


def _sentences(text: str, words: dict[str, str]) -> list[list[str]]:
    """Sentences as lists of words; equal words are one object, kept in ``words``."""
    return [[words.setdefault(w, w) for w in s.split()] for s in _SENTENCE.split(text.lower()) if s.strip()]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", train_docs: int = 1500, train_bytes: int = 20_000, landmarks: int = 32, order: int = 4, decay: float = 0.5) -> Model | None:
    """The model, or None without labels of both classes.  ``labels`` holds the rows to learn from."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("_y"))
    ids = [r for y in (0, 1) for r in known.where(F.col("_y") == y).orderBy(F.xxhash64(id_col), id_col).limit(2 * train_docs).collect()]
    marked = docs.sparkSession.createDataFrame(ids, known.schema) if ids else known.limit(0)
    own = docs.select(F.col(id_col), F.col(text).cast("string").alias("_text")).where(F.octet_length("_text") <= train_bytes)
    rows = own.join(F.broadcast(marked), id_col)  # at most 4 * train_docs rows on the broadcast side
    texts, known_words = {}, {}
    for y in (0, 1):
        sample = rows.where(F.col("_y") == y).orderBy(F.xxhash64(id_col), id_col, "_text").limit(train_docs).select("_text").collect()
        texts[y] = [_sentences(r["_text"], known_words) for r in sample]
        del sample
    if not texts[0] or not texts[1]:
        return None
    bags = {y: [{w for s in t for w in s} for t in texts[y]] for y in texts}
    chosen = _landmarks(texts[1], bags[1], bags[0], landmarks, order, 10)
    if not chosen:
        return None
    alphabet = {c: i + 1 for i, c in enumerate(sorted({c for g in chosen for c in g}))}
    coded = _codes(chosen, alphabet, max(map(len, chosen)))
    gram = subsequence_kernel(coded, coded, order, decay)
    scale = np.sqrt(np.diag(gram))
    values, vectors = np.linalg.eigh(gram.astype(np.float64) / np.outer(scale, scale))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    model = Model(alphabet, coded, scale.astype(np.float32), root.astype(np.float32), np.zeros(2 * len(chosen), np.float32), 0.0, order, decay)
    words = {y: sorted(set().union(*bags[y])) for y in bags}
    near = {y: model.features(words[y]) for y in words}
    back = np.linalg.inv(root)
    weight = dict(zip(words[0], (near[0][:, len(chosen) :] @ back).max(axis=1).tolist(), strict=True))
    # sentences of toxic texts: those with a word that holds a landmark; of clean texts: all, by their strongest word
    place = {w: i for i, w in enumerate(words[0])}
    clean = np.bincount([place[max(s, key=weight.__getitem__)] for t in texts[0] for s in t], minlength=len(words[0]))
    toxic = np.array([i for i, w in enumerate(words[1]) if any(g in w for g in chosen)], int)
    if not len(toxic):
        return None
    often = {y: Counter(w for t in bags[y] for w in t) for y in bags}
    seen = [np.array([often[y][w] for w in words[y]], float) for y in (0, 1)]
    some = clean > 0
    for _ in range(8):  # with the strongest words of clean sentences first, then also those the last model gets wrong
        x = np.vstack([near[1][toxic], near[0][some]])
        y = np.array([1.0] * len(toxic) + [-1.0] * int(some.sum()))
        model.weights, model.bias = train_svm(x, y, np.concatenate([seen[1][toxic], np.maximum(clean, seen[0])[some]]))
        wrong = (near[0] @ model.weights + model.bias > -0.5) & ~some
        if not wrong.any():
            break
        some |= wrong
    return model


def _apart(words: Words) -> Iterator[tuple[int, str]]:
    """(text, joined letters) of four or more single characters in a row."""
    lead = words.raw[words.starts] if len(words.starts) else np.zeros(0, np.uint8)
    single = (words.ends - words.starts) == 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
    of = np.repeat(np.arange(len(words.first) - 1), words.counts())
    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.where(single, of + 1, 0), [0]])))
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if b - a >= 4 and single[a]:
            yield int(of[a]), b"".join(words.text(j) for j in range(a, b)).decode().lower()


def _gapped(landmarks: np.ndarray, alphabet: dict[str, int]) -> str:
    """Pattern of the landmarks as whole words, with up to three white-space characters between letters."""
    letter = {code: re.escape(c) for c, code in alphabet.items()}
    words = (r"\s{0,3}".join(letter[c] for c in row if c > 0) for row in landmarks.tolist())
    return r"(?:^|\s)(" + "|".join(words) + r")(?:$|[\s.,;:!?])"


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), margin: float = 0.2) -> DataFrame:
    """One row per document row: id, carried columns, score (0 to 1), predicted (1 from 0.5 on).

    A text is toxic when its decision value reaches ``margin``: parts of insults, which
    ordinary words happen to hold, lie just above 0, whole ones near 1.
    """
    kept, own_columns = carried(docs, id_col, carry, ("score", "predicted"))
    rows = docs.select(*own_columns, F.col(text).cast("string").alias("_text"))
    if model is None:
        return rows.select(*[F.col(a).alias(b) for a, b in zip(rows.columns, [id_col, *kept], strict=False)], F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    pattern = _gapped(model.landmarks, model.alphabet)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state("toxicity")
        gapped = re.compile(pattern)
        own_model = (model.weights.tobytes(), model.bias, model.landmarks.tobytes())
        if state.get("model") != own_model:
            state.update(model=own_model, table=_Table(REMEMBERED), known=np.zeros(REMEMBERED, np.float32))
        table, known = state["table"], state["known"]
        for batch in steps(batches, "_text"):
            words = Words(batch.column(batch.schema.names.index("_text")))
            hashes = np.maximum(words.hashes, np.uint64(1))
            number = table.find(hashes)
            value = known[number]
            new = np.flatnonzero(number < 0)
            if len(new):
                own, one, back = np.unique(hashes[new], return_index=True, return_inverse=True)
                got = model.values([words.text(i).decode().lower() for i in new[one]])
                value[new] = got[back]
                n = min(len(own), REMEMBERED - table.n)  # the first words are the frequent ones; a full table stays
                known[table.n : table.n + n] = got[:n]
                table.add(own[:n])
            best = np.full(batch.num_rows, model.bias, np.float64)
            some = np.flatnonzero(words.counts())
            if len(some):
                best[some] = np.maximum(best[some], np.maximum.reduceat(value, words.first[:-1][some]))
            for i, joined in _apart(words):
                best[i] = max(best[i], float(model.values([joined])[0]))
            lowered = pc.utf8_lower(batch.column(batch.schema.names.index("_text")))
            for i in np.flatnonzero(pc.match_substring_regex(lowered, pattern).fill_null(False).to_numpy(zero_copy_only=False)):
                joined = {"".join(g.split()) for g in gapped.findall(lowered[int(i)].as_py()) if len(g.split()) > 1}
                if joined:
                    best[i] = max(best[i], float(model.values(sorted(joined)).max()))
            p = 1 / (1 + np.exp(-np.clip(4 * (best - margin), -50, 50)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[id_col, *kept, "score", "predicted"])

    kinds = ", ".join(f"`{c}` {f.dataType.simpleString()}" for c, f in zip([id_col, *kept], rows.schema, strict=False))
    return rows.mapInArrow(run, f"{kinds}, score double, predicted int")
