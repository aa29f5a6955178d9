"""Token counts against the library, text by text."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from briskbi.llm import token_counts

MARKS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "'s", "'LL", "don't", "é", "é", "≠", "ß", "İ", " ", "　", "​", "\x0b", "\x1c", "\n", "\t", "  ", "123", "...", "a.b", "漢字", "😀", "Thnt", "x" * 90, "_", "a=b", "ﬁ", "\x00"]


def texts(n, seed):
    rng = random.Random(seed)
    joined = lambda: rng.choice(["", " ", " "]).join(rng.choice(MARKS + ["word", "The", "of", "insight"]) for _ in range(rng.randrange(1, 25)))
    return [joined() for _ in range(n)]


def library(path, rows):
    tokenizer = Tokenizer.from_file(path)
    return [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in rows], add_special_tokens=False)]


def test_counts_equal_the_library(spark):
    rows = [None, "", " ", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a<|startoftext|>b <|endoftext|> c", "x" * 300_000, "y z " * 200_000, *texts(3000, 5), *texts(3000, 5)]
    docs = spark.createDataFrame([(None if i == 9 else i % 5000, t, "c", 7) for i, t in enumerate(rows)], "doc_id long, text string, n_tokens string, extra int").repartition(5)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        wanted = sorted((str(None if i == 9 else i % 5000), len((t or "").encode()), n, n > 20) for i, (t, n) in enumerate(zip(rows, library(path, rows))))
        for sample in (0, 500):
            got = token_counts.count_tokens(docs, path, limit=20, carry=("extra", "n_tokens"), sample_rows=sample)
            assert got.columns == ["doc_id", "extra", "n_bytes", "n_tokens", "over_limit"]
            assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == wanted


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).collect() == []


def test_query_equals_the_library(spark):
    from briskbi.llm.queries import QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    n = library(public_tokenizers.path("word_bpe_49k.json"), [r.text for r in rows])
    wanted = sorted((r.doc_id, len((r.text or "").encode()), k, k > 2048) for r, k in zip(rows, n))
    got = QUERIES["op11_token_counts"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(tuple(r) for r in got.collect()) == wanted
