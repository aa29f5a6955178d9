"""Piece table, packing, token files and chat windows: exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from briskbi.llm import chat, packing, shared, tokenfiles, tokens

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def plain(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("most", [1_000_000, 40])
def test_pieces_give_the_tokenizers_ids(monkeypatch, name, most):
    monkeypatch.setattr(tokens, "PIECES", most)
    rng = random.Random(1)
    marks = ["a", "b", "É", " ", "  ", "\n", "\t", "'s", "'LL", "1", "23", ".", "!?", " ", "　", "\x0b", "\x1c", "½", "Σ", "é", "́", "漢", "<|endoftext|>", "’", "​", "\r\n", "😀", "\u0085", "≮"]
    texts = ["".join(rng.choices(marks, k=rng.randrange(40))) for _ in range(1500)] + ["", None, "x" * 4000, "a" * 90 + " " + "b" * 90]
    coder, expected = tokens.Coder(public_tokenizers.path(name)), plain(name)
    for a in range(0, len(texts), 400):
        ids, first = coder.encode(pa.array(texts[a : a + 400], pa.string()))
        for i, t in enumerate(texts[a : a + 400]):
            assert ids[first[i] : first[i + 1]].tolist() == expected(t)


def documents(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "short", "w " * 9000] + [" ".join(rng.choices(["alpha", "Beta,", "gamma.", "δ"], k=rng.randrange(1, 900))) for _ in range(150)]
    rows = [(i if i != 7 else None, t, "x") for i, t in enumerate(texts)] + [(3, "short", "y"), (4, "other", "z")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(4)


@pytest.mark.parametrize("open_windows", [1, 4, 64])
def test_packing_places_every_id_once(spark, open_windows):
    rows, docs = documents(spark)
    expected = plain(FILES[0])
    pieces = packing.pack(docs, public_tokenizers.path(FILES[0]), length=256, open_windows=open_windows).collect()
    sequences, seen = {}, []
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for parts in sequences.values():
        parts.sort(key=lambda p: p.offset)
        ends = np.cumsum([p.length for p in parts])
        assert [p.offset for p in parts] == [0, *ends[:-1]] and ends[-1] <= 256
        assert ends[-1] & (ends[-1] - 1) == 0  # no padding at all: full, or a power of two
    for p in pieces:
        assert len(p.ids) == 4 * p.length
    by = {}
    for p in pieces:
        by.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    for i, t, _ in rows:
        ids = np.array([*expected(t), 0], "<u4").tobytes()
        own = sorted((p for p in by[(i, len(ids) // 4)]), key=lambda p: p.start)
        if (i, t) in ((3, "short"),):
            seen.append(i)  # the same row twice: two copies of one piece
            assert [p.ids for p in own] == [ids, ids]
        else:
            assert b"".join(p.ids for p in own) == ids and [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
    assert packing.pack(docs.limit(0), public_tokenizers.path(FILES[0])).collect() == []


def test_token_files_round_trip(spark, tmp_path):
    rows, docs = documents(spark)
    expected = plain(FILES[1])
    folder = f"file://{tmp_path}/files"
    shards = tokenfiles.write(docs, folder, public_tokenizers.path(FILES[1]), shard_bytes=20_000)
    got = sorted(tokenfiles.read(spark, folder, shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    texts = sorted((k is not None, k, zlib.crc32(np.array([*expected(t), 1], "<u4").tobytes())) for k, t, _ in rows)
    assert sorted((r.doc_id is not None, r.doc_id, zlib.crc32(r.ids)) for r in got) == texts
    shard, n, _ = shards[-1]
    whole = [r for r in got][-n:]
    for i in (0, n - 1):
        assert tokenfiles.read_document(folder, shard, i).tobytes() == whole[i].ids
    with open(f"{tmp_path}/files/shard-{shard:06d}.bin", "rb") as f:
        assert f.read(8) == tokenfiles.MAGIC and f.read(32) == hashlib.sha256(open(f"{tmp_path}/files/{tokenfiles.DICTIONARY}", "rb").read()).digest()
    none = tokenfiles.write(docs.limit(0), f"file://{tmp_path}/none", public_tokenizers.path(FILES[1]))
    assert none == [] and tokenfiles.read(spark, folder, none).collect() == []


def test_escapes_are_reversible():
    for t in ["", "\\", "a\\b</s>\\", "<\\/s>", "<<s>", "\\n[INST]\\\\", "<|end|>\n<|turn|>user\nhi", *chat.CONTROL]:
        escaped = chat.escape(t)
        assert chat.unescape(escaped) == t and not any(c in escaped for c in chat.CONTROL)
        assert chat.unescape_role(chat.escape_role(t + "\nx")) == t + "\nx" and "\n" not in chat.escape_role(t + "\nx")
    with pytest.raises(ValueError):
        chat.parse("<|turn|>user\nhi<|end|>\nrest")


def test_chat_windows(spark):
    rng = random.Random(9)
    rows = [(None, 0, "user", "hi"), (None, 1, "assistant", None), (1, None, None, ""), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 0, "system", "Be kind."), (2, 1, "user", "long " * 3000)]
    rows += [(3, i, "system" if not i else "user" if i % 2 else "assistant", " ".join(rng.choices(["yes", "no", "<|end|>", "\\"], k=rng.randrange(30)))) for i in range(200)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", chat.F.lit("clash")).repartition(3)
    windows = chat.format_chats(turns, public_tokenizers.path(FILES[0]), budget=120, history=40)
    by = {}
    for w in windows.collect():
        by.setdefault(w.conv_id, []).append(w)
    for conv, ws in by.items():
        ws.sort(key=lambda w: w.window)
        own = sorted(((t is not None, t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        parsed = [chat.parse(w.formatted) for w in ws]
        assert [(r, x) for p in parsed for new, r, x in p if new] == [(r, x) for _, _, r, x in own]
        assert [x for w in ws for x in chat.spread(w.formatted, w.loss)] == [x for _, _, r, x in own if r == "assistant"]
        if conv == 3:
            assert all(p[0][1] == "system" for p in parsed) and any(not new and r != "system" for p in parsed for new, r, _ in p)
            assert all(w.tokens <= 120 or w.n_new == 1 for w in ws)
    ids = plain(FILES[0])
    assert all(w.tokens == len(ids(w.formatted)) for ws in by.values() for w in ws)
    short = spark.createDataFrame([(7, i, "user" if i % 2 else "assistant", "\\" * (i % 4)) for i in range(900)], "conv_id long, turn long, role string, text string")
    made = chat.format_chats(short, public_tokenizers.path(FILES[0])).collect()
    assert len(made) > 5 and all(w.n_new > 1 and len(ids(w.formatted)) <= 1024 for w in made)
    back = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for conv, ws in by.items():
        texts = "".join(x for w in ws for x in chat.spread(w.formatted, w.loss))
        assert back[conv].loss_chars == len(texts) and back[conv].loss_sha256 == hashlib.sha256(texts.encode()).hexdigest()
        assert back[conv].n_turns == sum(1 for r in rows if r[0] == conv)
    assert chat.read_back(chat.format_chats(turns.limit(0), public_tokenizers.path(FILES[0]))).collect() == []


def test_dictionary_sample_is_spread_and_bounded(spark):
    F = chat.F
    rows = spark.range(0, 20_000, 1, 8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same")).when(F.col("id") % 50 == 1, F.lit("")).when(F.col("id") % 50 == 2, F.lit("x" * 300)).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    got = [r["_text"] for r in tokenfiles.dictionary_sample(rows, "doc_id", 100, 200).collect()]
    assert 50 <= len(got) <= 100 and got == [r["_text"] for r in tokenfiles.dictionary_sample(rows.repartition(5), "doc_id", 100, 200).collect()]
    assert "" not in got and max(map(len, got)) <= 200 and len(set(got)) > 20
    few = rows.limit(60).where(F.length("_text") > 0)
    assert tokenfiles.dictionary_sample(few, "doc_id", 100, 10**6).count() == few.count()


def test_an_open_window_does_not_hold_the_whole_document():
    packer = packing.Packer(64, 4, 0)
    ids = np.arange(100_000, dtype=np.uint32)
    list(packer.add(1, ids))
    assert sum(len(w) for w in packer.windows) == 1 and all(piece[2].base is None and len(piece[2]) <= 64 for w in packer.windows for piece in w)


def test_batch_sizes_with_units(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for given, then in (("16m", str(shared.ARROW_BYTES)), ("1m", "1m"), ("2048k", "2048k"), ("5000000b", str(shared.ARROW_BYTES)), ("4194304", "4194304"), ("1g", str(shared.ARROW_BYTES))):
            spark.conf.set(name, given)
            shared.small_batches(spark)
            assert spark.conf.get(name) == then
    finally:
        spark.conf.set(name, before)
