import random

import pytest

from dasymetra.llm import bpe

TRICKY = ["", " ", "a" * 50_000, "ab" * 9_000, "<|endoftext|> is text", "\x00﻿😀🗳️👍🏽", "é" * 1001, "日本語の文章。" * 50, "it's we'll I'd\n\n\t x", "１２３ ½ №"]


@pytest.fixture(scope="module")
def vocabulary():
    try:
        return bpe.load_vocabulary()
    except OSError:
        pytest.skip("no vocabulary files")


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.DEFAULT_FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_public_library(vocabulary, library):
    rnd = random.Random(1)
    texts = TRICKY + ["".join(rnd.choice("abct he\n\t'sé日1ZÇ") for _ in range(rnd.randint(0, 200))) for _ in range(3000)]
    texts += ["".join(chr(rnd.choice([rnd.randint(1, 0xD7FF), rnd.randint(0xE000, 0x1FFFF)])) for _ in range(30)) for _ in range(300)]
    assert bpe.Encoder(vocabulary).batch(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_round_trip(vocabulary):
    back = {}
    for letter, byte in bpe.byte_letters().items():
        back[vocabulary.first[byte]] = bytes([byte])
    for pair, (_, new) in sorted(vocabulary.merged.items(), key=lambda x: x[1]):
        back[new] = back[pair >> 20] + back[pair & 0xFFFFF]
    for text, ids in zip(TRICKY, bpe.Encoder(vocabulary).batch(TRICKY)):
        assert b"".join(back[i] for i in ids).decode() == text


def test_forgetting_changes_nothing(vocabulary, monkeypatch):
    texts = [f"word{i} and other{i % 7}" for i in range(50)]
    whole = bpe.Encoder(vocabulary).batch(texts)
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 5)
    small = bpe.Encoder(vocabulary)
    assert [small.batch([t])[0] for t in texts] == whole


def test_table(spark, vocabulary):
    docs = spark.createDataFrame([(1, "hello", "x"), (1, "hello", "x"), (2, None, None), (3, "", "y"), (None, " ", "z")], "doc_id bigint, text string, ids string")
    out = bpe.encode(docs, vocabulary)
    assert out.columns == ["doc_id", "text", "ids", "ids_"]
    got = sorted(((r.doc_id or 0), r.ids_) for r in out.collect())
    assert got == [(0, [220]), (1, [31373]), (1, [31373]), (2, []), (3, [])]
    assert bpe.encode(docs.limit(0), vocabulary, keep=["doc_id"]).count() == 0
    assert {r.doc_id: r.n_tokens for r in bpe.encode(docs, vocabulary, keep=["doc_id"], count_only=True).collect()} == {None: 1, 1: 1, 2: 0, 3: 0}
