"""The source divergence audit against a brute-force version in whole numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from briskbi.llm import divergence


def brute(rows, least=3, top=200):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(fold))) for text, lang, source in rows]
    held, sources = defaultdict(Counter), defaultdict(set)
    for lang, source, words in terms:
        held[lang].update(set(words))
        sources[lang].add(source)
    out = []
    for lang in sources:
        kept = [t for t, d in held[lang].items() if d >= least]
        count = {s: Counter() for s in sources[lang]}
        for at, source, words in terms:
            if at == lang:
                count[source].update(w for w in words if held[lang][w] >= least)
        count[None] = sum(count.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in count.items()}
        for s in sources[lang]:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources[lang] if o != s]
            term = [((p[s][t] - p[None][t]) ** 2 // p[None][t], t) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            for part, items, most in (("pair", pair, len(pair)), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def sample(seed, n=400):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "ß", "É", "é", "漢字", "can't", "x1y", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))]
    sources = ["hot"] * 8 + ["a", "b", "B", "é", "", None, "c", "d"]
    rows = [(" ".join(rng.choices(vocabulary[: rng.choice([9, 40, 129])], k=rng.randrange(0, 60))), rng.choice(["en", "en", "de", None, ""]), rng.choice(sources)) for _ in range(n)]
    rows += [(None, "en", "silent"), ("", "xx", "one"), ("rare words", "xx", "two"), ("alone alone", "yy", "only"), ("big " * 50_000, "en", "long")]
    return rows + rows[:50]  # repeated rows


def got(spark, rows, **settings):
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "text string, lang string, source string, term string").repartition(6)
    frame = divergence.audit(docs, **settings)
    assert frame.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in frame.collect())


def test_audit_equals_brute_force(spark, monkeypatch):
    rows = sample(1)
    monkeypatch.setattr(divergence, "PART_ENTRIES", 200)  # several stretches, flushes and blocks of columns
    monkeypatch.setattr(divergence, "FLUSH", 500)
    assert got(spark, rows, block=3, top_terms=7) == brute(rows, top=7)
    monkeypatch.setattr(divergence, "STRETCH", 50)
    monkeypatch.setattr(divergence, "MOST_BROADCAST", 0)
    assert got(spark, rows, least_docs=1) == brute(rows, least=1)


def test_audit_of_nothing(spark):
    assert got(spark, []) == []
    rows = [("word", "en", "a"), ("other", "en", "b"), (None, None, None)]  # no term in three documents
    assert got(spark, rows) == brute(rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_run_lengths():
    rng = random.Random(2)
    for _ in range(300):
        column = np.array([rng.choice([0, 0, 1, 2]) for _ in range(rng.randrange(1, 30))])
        row = np.flatnonzero(column)
        if len(row):
            starts, values = divergence.run_lengths(row, column[row], len(column))
            assert np.array_equal(np.repeat(values, np.diff(np.append(starts, len(column)))), column)
            assert (values[1:] != values[:-1]).all()


def test_counts_beyond_64_bits():
    counts = np.array([0, 5, 9_000_000_000_000])
    assert divergence.probability(counts, 10_000_000_000_000, 7).tolist() == [1 + 10**9 * (int(c) + 1) // (10_000_000_000_007) for c in counts]

