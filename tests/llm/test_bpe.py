from __future__ import annotations

import random

import pytest

from gleanwright.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def judge():
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    odd = ["", " ", "\n\n  x", "aaaaaaaaaaaaaaaa aaa", "<|endoftext|> hi", "it's we'll THEY'RE", "日本語のテスト", "👩‍🎤🔥🔥", "á​", "12345 6.7", "\x00\x01", "  \t \r\n", "e" * 900, "ab" * 1500, "don't#tag", "".join(rng.choices("abcdefghij", k=1001)), "x" * 30_000]
    return odd + ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(160, 1200), rng.randrange(0x4E00, 0x4F00), 32, 10))) for _ in range(200)) for _ in range(40)]


def test_same_ids_as_the_public_library(judge, texts):
    encoder = bpe.Encoder(bpe.vocabulary_path())
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids == judge(text), ascii(text[:60])


def test_round_trip(texts):
    path = bpe.vocabulary_path()
    encoder, ranks = bpe.Encoder(path, remembered=5), bpe.read_ranks(path)
    for text in texts:
        assert bpe.decode(encoder.encode([text])[0], ranks) == text


def test_table(spark, judge):
    frame = spark.createDataFrame([(1, "hello world", 5), (2, "", 6), (3, None, 7), (4, "hello world", 8)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: r.ids for r in bpe.encoded(frame, bpe.vocabulary_path()).collect()}
    assert got == {1: judge("hello world"), 2: [], 3: [], 4: judge("hello world")}
    assert bpe.encoded(frame.where("false"), bpe.vocabulary_path()).collect() == []
