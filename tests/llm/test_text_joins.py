"""N-gram Jaccard join, substring dedup, decontamination and URL filter against brute force."""

import random
import time
from collections import Counter

import pytest

from briskbi.llm import decontaminate, ngram_join, substring, urlfilter
from briskbi.llm import queries as Q

SCHEMA = "doc_id long, text string, n_words string, _key string, component_id int"


def frame(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, None, "x", 1) for i, t in texts], SCHEMA).repartition(parts)


def words(n, rng, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edge_texts():
    rng = random.Random(5)
    base = words(120, rng)
    near = [list(base) for _ in range(60)]
    for w in near:
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    texts = [None, "", " \t\n", "one", "ONE", "a b c", "a b c d e", "A b C d e", "é É", "a b c d e f"]
    texts += [" ".join(w) for w in near] + [" ".join(base)] * 5
    texts += [" ".join(words(rng.randrange(1, 80), rng, 12)) for _ in range(60)]
    texts += ["long " + "y" * 50_000 + " " + " ".join(words(6000, rng)), "same " * 500]
    return [(i if i != 7 else None, t) for i, t in enumerate(texts)]


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                group[root(i)] = root(j)
    members = {}
    for i, (k, _) in enumerate(rows):
        members.setdefault(root(i), []).append(k)
    least = {r: min((k for k in m if k is not None), default=None) for r, m in members.items()}
    return sorted(((k, len(sets[i]), least[root(i)]) for i, (k, _) in enumerate(rows)), key=str)


def test_jaccard_components_match_all_pairs(spark):
    rows = edge_texts()
    got = ngram_join.jaccard_components(frame(spark, rows), slice_bytes=20_000).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


def test_near_copies_that_link_only_through_others(spark):
    rng = random.Random(11)
    base = words(200, rng, 10**6)
    rows = []
    for i in range(700):  # a chain: neighbours link, ends do not, and strays beside it
        w = list(base)
        for j in range(i // 8 * 2):
            w[j * 7 % 200] = f"c{j}"
        for _ in range(rng.randrange(9)):
            w[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = ngram_join.jaccard_components(frame(spark, rows, 7), slice_bytes=100_000).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert ngram_join.jaccard_components(none).collect() == []
    assert substring.duplicate_spans(none).collect() == []
    assert decontaminate.decontaminate(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []
    some = decontaminate.decontaminate(frame(spark, [(1, "a b")]), spark.createDataFrame([], "item_id long, text string")).collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in some] == [(2, 0, [])]


def brute_spans(rows, window):
    split = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (k, _), w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((k, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,anchor", [(35, 10), (6, 3)])
def test_spans_match_brute_force(spark, window, anchor):
    rows = edge_texts() + [(3, "one"), (500, "a a " * 200)]
    rng = random.Random(2)
    passage = " ".join(words(60, rng, 10**6))
    rows += [(600 + i, f"{' '.join(words(i, rng))} {passage} {' '.join(words(3, rng))}") for i in range(40)]
    rows += [(600, rows[-1][1])]
    got = substring.duplicate_spans(frame(spark, rows), window=window, anchor=anchor, carry=("text",), slice_bytes=30_000)
    got = got.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == brute_spans(rows, window)
    at = {r.row_key: (r.text or "").encode().split() for r in got}
    rows_alike = Counter(r.row_key for r in got)
    for r in got:
        covered = set()
        for f in r.factors:
            assert f.length >= window and (rows_alike[r.row_key] > 1 or (f.source, f.source_start) != (r.row_key, f.start))
            assert at[r.row_key][f.start : f.start + f.length] == at[f.source][f.source_start : f.source_start + f.length]
            covered |= set(range(f.start, f.start + f.length))
        assert covered == {x for s in r.spans for x in range(s.start, s.start + s.length)} and len(covered) == r.n_removed
        for f, g in zip(r.factors, r.factors[1:]):  # a factor goes on as long as its source does
            on = f.length - window + 1
            assert g.start > f.start and (g.start, g.source, g.source_start) != (f.start + on, f.source, f.source_start + on)


def test_spans_carry_columns(spark):
    got = substring.duplicate_spans(frame(spark, [(1, "a  b"), (2, None)]), carry=("text", "n_words", "_key")).orderBy("doc_id").collect()
    assert [(r.text, r.n_words, r._key, r.kept_text, r.spans) for r in got] == [("a  b", 2, "x", "a b", []), (None, 0, "x", "", [])]


def brute_hits(rows, items):
    import re

    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    out = []
    for k, t in rows:
        w, hit, found = split(t), set(), set()
        for item, text in items:
            x = split(text)
            n = min(10, len(x))
            grams = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found.add(item)
        out.append((k, len(w), len(hit), sorted(found, key=str)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_hits_match_brute_force(spark, block_bytes):
    rng = random.Random(4)
    items = [(1, None), (2, ""), (3, "!!"), (4, "Hello"), (5, "a-b_c"), (6, " ".join(words(10, rng))), (7, " ".join(words(30, rng))), (7, "Straße über ÄB"), (None, "null item")]
    texts = [None, "", "hello, HELLO world", "x A b C.", items[5][1].upper(), "pre " + items[6][1] + " post", " ".join(items[6][1].split()[5:22]), "straße ÜBER über ÄB", "null item", "z" * 9000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, "hello")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(frame(spark, rows), bench, block_bytes=block_bytes).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"], key=str)) for r in got), key=str) == brute_hits(rows, items)


def test_url_rules(spark):
    urls = ["https://A.Example.NET/en/x?q", "http://example.net/en", "http://example.net/english/", "x.org/fr/", None, "", "ftp://org/fr/", "http://b.org/fr/#f",
            "http://net", "http://net/", "http://example.com/de/a", "http://notexample.com/de/", "http://example.com:80/de/", "https://?a://b", "http://a.net#://"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h")], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1] == ("example.net", "/en", "net/", "block")
    assert got[2][2:] == ("net/", "block")
    assert got[3] == got[4] == got[5] == ("", "", None, "allow")
    assert got[6][2:] == got[7][2:] == ("org/fr/", "allow")
    assert got[8] == ("net", "", None, "allow") and got[9][2] == "net/"
    assert got[10][2:] == ("example.com/de/", "block")
    assert got[11][2] is None and got[12][2] is None
    assert got[13] == ("", "", None, "allow") and got[14] == ("a.net", "", None, "allow")
    blocks = urlfilter.BROADCAST_BYTES
    try:
        urlfilter.BROADCAST_BYTES = 10  # rules in several blocks give the same verdicts
        again = urlfilter.judge(pages).collect()
    finally:
        urlfilter.BROADCAST_BYTES = blocks
    assert len(again) == len(urls) + 1 and {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in again} == got
    assert urlfilter.judge(pages, rules=[], default="block").where("verdict <> 'block'").count() == 0


def test_every_oracle_has_a_query():
    assert set(Q.ORACLE) <= set(Q.QUERIES)
    assert {q.split("_")[0] for q in Q.QUERIES} == {f"op{n}" for n in range(1, 14)}


def test_very_long_urls_and_equal_prefixes():
    rules = [("a.org/x", "allow"), ("a.org/xyz", "block"), ("a.org/", "allow"), ("b.org/d/e", "block"), ("a.org/xyz", "allow")]
    trie = urlfilter.Trie(rules)

    def brute(host, path):
        fits = [(r, v) for r, v in rules if r is not None and (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        return max((len(r), v == "block", r, v) for r, v in fits)[2:] if fits else None

    for host in ("a.org", "c.a.org", "b.org", "org", ""):
        for path in ("", "/", "/x", "/xy", "/xyz", "/xyzz/a", "/y", "/d", "/d/", "/d/ef", "/d/f"):
            assert trie.find(host, path) == brute(host, path), (host, path)
    began = time.process_time()
    assert trie.find("a.org", "/xyz" + "x" * 2_000_000) == ("a.org/xyz", "block")
    assert trie.find("a.org", "/" * 1_000_000) == ("a.org/", "allow")
    assert trie.find("." * 1_000_000 + "a.org", "/q") == ("a.org/", "allow")
    assert time.process_time() - began < 5
