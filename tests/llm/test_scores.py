"""Toxicity, main text, embedding near-duplicates and the pipeline."""

import math
import random
import time

import numpy as np

from briskbi.llm import html_text, toxicity, vectors


def brute_kernel(u, v, order, decay):
    """Sum over equal subsequences of ``order`` letters; decay for each letter skipped between."""
    from itertools import combinations

    total = 0.0
    for a in combinations(range(len(u)), order):
        for b in combinations(range(len(v)), order):
            if all(u[i] == v[j] for i, j in zip(a, b)):
                total += decay ** (a[-1] - a[0] + b[-1] - b[0] + 2 - 2 * order)
    return total


def test_kernel_matches_its_definition():
    marks = ["idiot", "worthless", "scum", "abab"]
    alphabet = {c: i + 1 for i, c in enumerate(sorted(set("".join(marks))))}
    coded = toxicity._codes(marks, alphabet, 9)
    for word in ["idiot", "i.d.i.o.t", "idi", "", "scumscum", "worthles", "ababab", "zzzz", "tidiot"]:
        w = toxicity._codes([word], alphabet, max(1, len(word)))
        got = toxicity.subsequence_kernel(w, coded, 4, 0.5)[0]
        assert np.allclose(got, [brute_kernel(word, m, 4, 0.5) for m in marks], rtol=1e-4)
        if all(c in alphabet for c in word):
            assert math.isclose(float(toxicity.self_kernel(w, 4, 0.5)[0]), brute_kernel(word, word, 4, 0.5), rel_tol=1e-4)


def test_toxicity_learns_insults(spark):
    rng = random.Random(1)
    syllables = ["an", "er", "on", "th", "re", "in", "ti", "ou"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(1, 4)))
    insults = ["idiot", "scum", "worthless", "moron"]

    def text(toxic):
        w = [word() for _ in range(60)]
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(insults))
        return " ".join(w)

    rows = [(i, text(i % 3 == 0), i % 3 == 0) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, _text string").repartition(3)
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows if i % 5] + [(10_000, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model, carry=("_text",)).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if not i % 5]
    assert np.mean([p == y for p, y in held]) > 0.97 and got[1]._text == "x"
    probes = ["an id.iot here", "ti worth-less on", "s c u m", "A MORON", "an er on th", "", None, "x" * 5000, "a" * 60 + "idiot" + "b" * 60]
    extra = spark.createDataFrame(list(enumerate(probes)), "doc_id long, text string")
    said = {r.doc_id: r for r in toxicity.score(extra, model).collect()}
    assert [said[i].predicted for i in range(len(probes))] == [1, 1, 1, 1, 0, 0, 0, 0, 1]
    assert all(0 <= r.score <= 1 for r in said.values())
    assert toxicity.score(docs.limit(0), model).collect() == []
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    assert {(r.score, r.predicted) for r in toxicity.score(extra, None).collect()} == {(0.0, 0)}


def test_main_text(spark):
    body = "A long enough paragraph, with many words in it, so that the sums of the line blocks surge &amp; stay."
    cases = {
        "": "",
        "plain": "plain",
        "<p>a<p>b<br>c&nbsp;&lt;d&gt;</p>": "a\nb c <d>",
        "<p title='x > y'>one <b>two</b>three</p><!-- <p>no</p> -->": "one twothree",
        f"<nav><a>x</a></nav><article><h1>T</h1><p>{body}<div class='ad'>buy</div><p>Sh.</article><div id=comments><p>nice</div><footer>f": f"T\n{body.replace('&amp;', '&')}\nSh.",
        "<nav><p>open<article><p>kept</article>": "kept",
        "<script>var t='</p><p>x';</script><style>p{}</style><p>y": "y",
        f"<div><a>one</a></div><div><a>two</a></div><div><a>three</a></div><p>{body}</p><p>Short.</p><div><a>a</a></div><div><a>b</a></div><div><a>c</a></div><div><a>d</a></div>": f"{body.replace('&amp;', '&')}\nShort.",
        "<main><form><p>no</p></form><aside>x</aside><table><tr><td>c1<td>c2</table></main>": "c1\nc2",
    }
    for page, text in cases.items():
        assert html_text.main_text(page) == text, page
    rows = spark.createDataFrame([(i, None, p, "t") for i, p in enumerate(cases)] + [(99, "u", None, "t"), (0, None, "", "t")], "page_id long, url string, html string, text string")
    got = html_text.extract(rows, carry=("url", "text")).collect()
    assert len(got) == len(cases) + 2 and got[0].__fields__ == ["page_id", "url", "text", "n_chars"]
    assert {(r.page_id, r.text) for r in got} == {(i, t) for i, t in enumerate(cases.values())} | {(99, "")}
    assert html_text.main_text("<p>" + "x " * 200_000) == " ".join(["x"] * 200_000)


def test_main_text_weighs_marked_pages_too():
    body = "A long enough paragraph, with many words in it, so that the sums of the line blocks surge and stay. " * 4
    body = body.strip()
    links = "".join(f"<li><a>link {i}</a></li>" for i in range(4))
    cases = {
        f"<main><h1>T</h1><p>lead</p><article><p>{body}</p></article><p>end</p></main>": f"T\nlead\n{body}\nend",
        f"<article><p>{body}</p></article><div><p>{body}</p></div><article><p>Second.</p></article>": f"{body}\nSecond.",
        f"<article><h1><a>T</a></h1><p>{body}</p><ul>{links}</ul><p>On.</p><p><a>more</a></p></article>": f"T\n{body}\nOn.\nmore",
        f"<p>{body}</p><p>{body}</p><p>{body}</p><ul>{links}</ul><p>{body[:100]}</p>": f"{body}\n{body}\n{body}\n{body[:100].strip()}",
        f"<article><nav>x</nav></article><p>{body}</p>": body,
    }
    for page, text in cases.items():
        assert html_text.main_text(page) == text, page


def test_marks_of_main_text_do_not_take_whole_parts():
    body = ("A long enough paragraph, with many words in it, so that the sums of the line blocks surge and stay. " * 4).strip()
    found = f"Discussion\n{body}"
    cases = {
        f"<div class='content has-sidebar'><h1>T</h1><p>{body}</p></div>": f"T\n{body}",
        f"<div id=page class=no-sidebar><p>{body}</p><div class=ad>buy</div><p>{body}</p></div>": f"{body}\n{body}",
        f"<article><p>{body}</p><p>{body}</p><section id='discussion'><h2>Discussion</h2><p>{body}</p></section></article>": f"{body}\n{body}\n{found}",
        f"<p>{body}</p><p>{body}</p><section id='discussion'><h2>Discussion</h2><p>{body}</p></section>": f"{body}\n{body}\n{found}",
        f"<main><p>{body}</p><div class='notice'>Mind this.</div><section id='related-work'><p>{body}</p></section><p>{body}</p></main>": f"{body}\n{body}\n{body}",
        f"<div class='search-page'><p>{body}</p></div>": body,
        f"<div class='sidebar'><p>{body}</p><p>{body}</p></div><p>Short.</p>": f"{body}\n{body}\nShort.",
        f"<p>{body} <span class='alert'>Mind</span> it.</p>": f"{body} Mind it.",
        f"<article><p>{body}</p><div class='sidebar'><div><p>a</p></div><p>b</p></div><p>c</p></article><article class='comment'>d</article>": f"{body}\nc",
        f"<div>{''.join(f'<div class=comment><p>{body}</p></div>' for _ in range(5))}</div>": "\n".join([body] * 5),
    }
    for page, text in cases.items():
        assert html_text.main_text(page) == text, page


def test_small_blocks_named_as_notices_adverts_or_comments_go():
    body = ("A long enough paragraph, with many words in it, so that the sums of the line blocks surge and stay. " * 4).strip()
    gone = "notice alert banner promo sponsor related subscribe signup advert-box cookie-banner comment-list article-comments user-comments site_notice".split()
    stays = "has-sidebar no-comments comments-open with-banner notice-board-less discussion related-work banner-heading noticeable".split()
    for name in gone:
        for zone in ("article", "div"):
            assert html_text.main_text(f"<{zone}><p>{body}</p><div class='x {name}'><p>Buy or mind this.</p></div><p>{body}</p></{zone}>") == f"{body}\n{body}", name
        assert html_text.main_text(f"<div class='{name}'><p>{body}</p></div>") == body, name  # not when it is most of the page
    for name in set(stays) - {"notice-board-less", "banner-heading"}:
        assert html_text.main_text(f"<article><p>{body}</p><div class='{name}'><p>Part of the text.</p></div><p>{body}</p></article>") == f"{body}\nPart of the text.\n{body}", name
    assert html_text.main_text(f"<article><h2 class='banner-heading'>T</h2><p>{body} <span class='alert'>Mind</span> it.</p></article>") == f"T\n{body} Mind it."


def test_hostile_pages_take_linear_time():
    units = ["<a", '<a ">" ', "<!", "<a '", "<div class=ad>x", "<article>x", "<div class=ad><i>", "<a \"'>'", "<nav>", "<li class=ad>", "&#9999999999"]
    for unit in units:
        page = unit * (1_000_000 // len(unit))
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 15, unit
    assert html_text.main_text("&#" + "9" * 6000 + "; &#" + "0" * 6000 + "65;") == "\ufffd A"
    assert html_text.main_text("<p title=\"x y>one</p><p>two") == "one\ntwo"  # no end of the quote: the first > ends the tag


def test_main_text_of_an_empty_table(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 64))
    y = x[:1] * 0.7 + rng.standard_normal((400, 64)) * 0.5
    x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
    _, signs, factor = vectors.encode(x, 256)
    turned, _, _ = vectors.encode(y, 256)
    value, error = vectors.estimate(signs, factor, turned)
    off = value - x @ y.T
    assert abs(off.mean()) < 0.003 and (np.abs(off) <= 5 * error[:, None]).all()


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 24))
    rows = []
    for i in range(900):
        v = centres[0 if i < 300 else i % 20] + rng.standard_normal(24) * (0.05 + 0.4 * (i % 3 == 0))
        rows.append((i, [float(a) for a in v], [1, 1, 2, None][i % 4]))
    rows += [(2000, rows[0][1], 1), (2001, rows[0][1], 1), (2002, [2 * a for a in rows[0][1]], 1), (2003, None, 1), (2004, [0.0] * 24, 1), (2005, [float("nan")] * 24, 1), (2006, [1.0, None], 1), (2007, [1.0, 1.0], 1), (2008, [float("inf")] * 24, 1), (2009, [], 1), (1, rows[1][1], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = vectors.near_duplicates(frame).collect()
    n = len(rows)
    ok = [r[1] is not None and len(r[1]) > 0 and all(a is not None and math.isfinite(a) for a in r[1]) and any(r[1]) and r[2] is not None for r in rows]
    links = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                links[i, j] = links[j, i] = a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.93
    expected = links.sum(1)
    found = {}
    for r in got:
        found.setdefault(r.vec_id, []).append(r.n_links)
    assert len(got) == n
    total = sum(sum(v) for v in found.values())
    assert all(max(found[r[0]]) <= c for r, c in zip(rows, expected)) and total >= 0.97 * expected.sum()
    dead = [r for r in got if r.vec_id in (2003, 2004, 2005, 2006, 2007, 2008, 2009)]
    assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in dead)
    assert vectors.near_duplicates(frame.limit(0)).collect() == []


def test_toxicity_reads_across_white_space(spark):
    rng = random.Random(2)
    insults = ["idiot", "worthless", "дурак", "crétin"]
    word = lambda: "".join(rng.choices(["an", "er", "on", "th", "re", "да", "но"], k=rng.randrange(1, 4)))
    text = lambda toxic: " ".join([word() for _ in range(20)] + [rng.choice(insults) for _ in range(2 * toxic)] + [word() for _ in range(20)])
    rows = [(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(600)]
    model = toxicity.fit(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    probes = ["an idi ot er", "Wor thless", "on д у р а к er", "an c r é t i n", "дур  ак", "an er idi on ot", "th idi otan", None, "д а н о д а"]
    said = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(list(enumerate(probes)), "doc_id long, text string"), model).collect()}
    assert [said[i] for i in range(len(probes))] == [1, 1, 1, 1, 1, 0, 0, 0, 0]
