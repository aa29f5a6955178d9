"""Best-position search against a brute-force ranking."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from briskbi.llm import lexical_search

_FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(_FOLD))


def brute(docs, queries, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in queries:
        scored = []
        for i, b in bags:
            m = 50 + (50 * sum(b.values()) * n_docs) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 20 * m)) for w in set(terms(text)) if b[w])
            if s:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(map(str, out))


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "é", "É", "漢字", "x9", "don't", *(f"w{i}" for i in range(300))]
    shares = [1 / (1 + i) for i in range(len(vocabulary))]
    text = lambda m: " ".join(rng.choices(vocabulary, shares, k=m))
    docs = [(i, text(rng.randrange(0, 80))) for i in range(n)]
    copy = text(30)
    docs += [(5000 + i, copy) for i in range(n // 3)] + [(7, "w1 w2"), (7, "w1 w2"), (None, copy), (None, None), (9000, ""), (9001, "w3 " * 100_000), (9002, "... !")]
    queries = [(i, text(rng.randrange(1, 25))) for i in range(30)] + [(99, None), (98, ""), (97, "nowhere"), (96, copy), (96, copy), (95, "THE"), (None, "w1 w2 w250")]
    rng.shuffle(docs)
    return docs, queries


@pytest.mark.parametrize("k, shard, block", [(5, 3_000_000, 4096), (50, 400, 9), (3, 100, 4096)])
def test_search_equals_brute_force(spark, monkeypatch, k, shard, block):
    monkeypatch.setattr(lexical_search, "POSTINGS", shard)
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", block)
    rows, asked = corpus(k, 500)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, score int, item_id string").repartition(4)
    queries = spark.createDataFrame([(i, t, 2) for i, t in asked], "item_id long, text string, doc_id int").repartition(3)
    got = lexical_search.search(docs, queries, k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, asked, k)


def test_empty_tables(spark):
    docs, queries = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id string, text string")
    assert lexical_search.search(docs.limit(0), queries).collect() == []
    assert lexical_search.search(docs, queries.limit(0)).collect() == []
    assert lexical_search.search(docs.withColumn("text", lexical_search.F.lit(None).cast("string")), queries).collect() == []


def shard_of(rng, n_docs, n_terms):
    some = [(d, t, rng.randrange(1, 50)) for d in range(n_docs) for t in range(n_terms) if rng.random() < 0.5]
    doc, term, impact = (np.array(x) for x in zip(*some))
    return lexical_search.Shard(doc, term, impact.astype(np.int32), n_terms, n_docs), some


def test_shard_finds_the_best_and_stops_early():
    rng = random.Random(4)
    for _ in range(60):
        shard, some = shard_of(rng, 200, 6)
        asked = np.array(sorted(rng.sample(range(6), 3)))
        weights = np.array([rng.randrange(0, 5) for _ in asked])
        score = Counter()
        for d, t, x in some:
            score[d] += int(weights[list(asked).index(t)]) * x if t in asked else 0
        wanted = sorted(((-s, d) for d, s in score.items() if s))[:10]
        docs, scores = shard.search(asked, weights, 10, step=2)
        assert [(-s, d) for d, s in zip(docs.tolist(), scores.tolist())] == wanted
        assert not shard.met.any()
    # one list falls steeply after its top: the documents below it are never read
    n = 4000
    impact = np.concatenate([np.full(20, 900), np.ones(n - 20)]).astype(np.int32)
    steep = lexical_search.Shard(np.arange(n), np.zeros(n, int), impact, 1, n)
    reads = []
    plain = np.unique

    def counting(x, *a, **kw):
        reads.append(len(x))
        return plain(x, *a, **kw)

    lexical_search.np.unique, keep = counting, lexical_search.np.unique
    try:
        docs, _ = steep.search(np.array([0]), np.array([3]), 10, step=16)
    finally:
        lexical_search.np.unique = keep
    assert docs.tolist() == list(range(10)) and sum(reads) < 100
