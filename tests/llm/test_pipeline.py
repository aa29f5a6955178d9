"""The pipeline's stages against brute force on a small corpus, and its contract."""

import random

import numpy as np
from llm.test_text_joins import brute_components, brute_hits, brute_spans
from llm.test_tokens import FILES, plain

import corpus_pipeline
from briskbi.llm import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark, folder):
    rng = random.Random(8)
    syllables = ["an", "er", "on", "th", "re", "in", "ti", "ou", "st", "nd"]
    text = lambda n: [("".join(rng.choices(syllables, k=rng.randrange(2, 5)))) for _ in range(n)]
    items = [" ".join(text(14)) for _ in range(5)]
    passage, near = text(60), text(150)
    docs = {}
    for i in range(400):
        w = text(rng.randrange(30, 90))
        if i % 4 == 1:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scum", "moron"]))
        if i % 40 == 2:
            w = w[:20] + passage + w[20:]
        if i % 40 == 3:
            w = w[:10] + items[i % 5].split() + w[10:]
        if i % 40 == 4:
            w = [x if rng.random() > 0.01 else "zz" for x in near]
        docs[i] = " ".join(w)
    docs |= {400: None, 401: "", 402: docs[0], 403: docs[8]}
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}", len(t) if t is not None else None) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 1)) for i in range(0, 400)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def test_stages_match_brute_force(spark, tmp_path):
    folder = str(tmp_path / "tables")
    docs, items = corpus(spark, folder)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "substring_dedup", "benchmark_decontamination", "packing"]
    frames = [spark.read.parquet(f"{folder}/documents.parquet")]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frames[-1], folder)
        if i < 4:
            assert out.columns == COLUMNS and out.dtypes == frames[0].dtypes
        out.write.parquet(f"{tmp_path}/{i}")
        frames.append(spark.read.parquet(f"{tmp_path}/{i}"))
    texts = [{r.doc_id: r.text for r in f.collect()} for f in frames[:5]]

    model = toxicity.fit(frames[0], spark.read.parquet(f"{folder}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score(frames[0], model).where("predicted = 1").collect()}
    assert {i for i in range(400) if i % 4 == 1} == rejected
    assert texts[1] == {i: t for i, t in docs.items() if i not in rejected}

    groups = brute_components(sorted(texts[1].items()))
    assert set(texts[2]) == {i for i, _, c in groups if c == i} and 402 not in texts[2]
    assert all(texts[2][i] == texts[1][i] for i in texts[2])

    spans = {i: (n, kept) for i, _, n, kept in brute_spans(sorted(texts[2].items()), 35)}
    assert texts[3] == {i: kept if n else texts[2][i] for i, (n, kept) in spans.items()} and any(n for n, _ in spans.values())
    lengths = {r.doc_id: r.n_chars for r in frames[3].collect()}
    assert all(lengths[i] == (len(t) if t is not None else None) for i, t in texts[3].items())

    hits = {i: n for i, _, n, _ in brute_hits(sorted(texts[3].items()), list(enumerate(items)))}
    assert texts[4] == {i: t for i, t in texts[3].items() if not hits[i]} and any(hits.values())

    encode = plain(FILES[0])
    pieces = {}
    for p in frames[5].collect():
        pieces.setdefault(p.doc_id, []).append((p.start, p.ids))
    assert set(pieces) == set(texts[4])
    for i, t in texts[4].items():
        assert b"".join(ids for _, ids in sorted(pieces[i])) == np.array([*encode(t), 0], "<u4").tobytes()

    total = {i: sum(len(ids) for _, ids in parts) for i, parts in pieces.items()}  # cuts depend on the partitions
    ran = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        ran[r.doc_id] = ran.get(r.doc_id, 0) + len(r.ids)
    assert ran == total


def test_stages_on_empty_tables(spark, tmp_path):
    folder = str(tmp_path / "none")
    corpus(spark, str(tmp_path / "some"))
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/some/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []


def test_rows_that_share_ids_or_have_none(spark):
    rng = random.Random(5)
    a, b, c, d, e = (" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60)) for _ in range(5))
    near = a.rsplit(" ", 1)[0] + " other"
    rows = [
        (1, a, "x"), (1, a, "x"), (1, a, "x"), (2, near, "x"),  # one row three times
        (7, b, "x"), (5, b, "x"), (7, c, "y"),  # a copy and another text under one id
        (None, d, "x"), (None, d, "x"), (None, d, "y"), (None, e, "x"),
        (9, "", "x"), (9, "", "x"), (None, None, "x"), (9, d[:20], "x"),
    ]
    docs = spark.createDataFrame([(i, t, s, len(t) if t else None, 0.5, 9) for i, t, s in rows], "doc_id long, text string, source string, n_chars long, Score double, n_words int").repartition(3)
    left = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    got = sorted(((r.doc_id, r.text) for r in left), key=str)
    assert got == sorted([(1, a), (5, b), (7, c), (None, d), (None, e), (9, ""), (9, ""), (None, None), (9, d[:20])], key=str)
    cut = corpus_pipeline.substring_dedup(spark, spark.createDataFrame(left, docs.schema), "")
    assert cut.columns == docs.columns and sorted(((r.doc_id, r.text) for r in cut.collect()), key=str) == got
    assert {(r.Score, r.n_words) for r in cut.collect()} == {(0.5, 9)}
    empty = spark.createDataFrame([], "item_id long, text string")
    read, corpus_pipeline.read = corpus_pipeline.read, lambda *_: empty
    try:
        assert {(r.Score, r.n_words) for r in corpus_pipeline.benchmark_decontamination(spark, docs, "").collect()} == {(0.5, 9)}
    finally:
        corpus_pipeline.read = read
