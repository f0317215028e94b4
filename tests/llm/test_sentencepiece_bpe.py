"""op12 against the sentencepiece library."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from cuelake.llm import sentencepiece_bpe as S

pytestmark = pytest.mark.skipif(not public_tokenizers.path(S.TOKENIZER), reason="no vocabulary")


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path(S.TOKENIZER), "rb") as f:
        return f.read()


def texts(own):
    rnd = random.Random(1)
    letters, pieces = " abcdef=-.\n\t▁é梦①<>_123,;s't́h   ", [own.id_to_piece(i).replace("▁", " ") for i in range(259, own.get_piece_size())]
    out = ["", " ", "<s>hi</s><unk>", "\x00a", "ab" * 700, "=" * 900, "aaaa" * 200, " " * 3000 + "x", "\n" * 50, "x" * 5000]
    out += [" " * n + end for n in range(70) for end in ("", "a b", "梦  ①x")]
    out += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    out += ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 12))) for _ in range(5000)]
    return out + ["".join(chr(rnd.choice([rnd.randint(0, 0x2FF), rnd.randint(0, 0xD7FF), rnd.randint(0x1F000, 0x1FAFF)])) for _ in range(20)) for _ in range(500)]


def test_like_the_library(model):
    own, encoder, decoder = sentencepiece.SentencePieceProcessor(model_proto=model), S.Encoder(model), S.Decoder(model)
    given = texts(own)
    got = [np.frombuffer(x, "<i4") for k in range(0, len(given), 500) for x in encoder.encode_all(given[k : k + 500])]
    wanted = own.encode(given, num_threads=1)
    assert [g.tolist() for g in got] == wanted
    assert [decoder.decode(g.astype(np.int64)) for g in got] == [own.decode(w) for w in wanted]


def test_decoding_of_any_ids(model):
    own, decoder, rnd = sentencepiece.SentencePieceProcessor(model_proto=model), S.Decoder(model), random.Random(2)
    for _ in range(3000):
        ids = [rnd.choice([rnd.randint(0, 300), rnd.randint(0, own.get_piece_size() - 1)]) for _ in range(rnd.randint(0, 8))]
        assert decoder.decode(np.array(ids, dtype=np.int64)) == own.decode(ids)


def test_memory_of_words_is_bounded(model, monkeypatch):
    monkeypatch.setattr(S, "CACHE_WORDS", 50)
    monkeypatch.setattr(S, "ROUND_CHARACTERS", 100)
    own, encoder = sentencepiece.SentencePieceProcessor(model_proto=model), S.Encoder(model)
    given = [f"word{k} other{k % 7} {'long' * 20}{k}" for k in range(300)]
    for k in range(0, 300, 20):
        got = [np.frombuffer(x, "<i4").tolist() for x in encoder.encode_all(given[k : k + 20])]
        assert got == own.encode(given[k : k + 20], num_threads=1)
    assert len(encoder.recent) < 150


def test_operator(spark, model):
    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = [(1, "Hello  world"), (1, "Hello  world"), (None, "x"), (2, None), (3, ""), (4, "long " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({"id": docs.text, "ids": docs.text, "n_tokens": docs.text})
    encoded = S.encode_texts(docs)
    assert encoded.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids", "array<int>")]
    found = S.decode_tokens(encoded).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    wanted = sorted(((i, len(ids := own.encode(t or "")), ids, own.decode(ids)) for i, t in rows), key=key)
    assert sorted(map(tuple, found), key=key) == wanted
    assert S.decode_tokens(encoded.limit(0)).count() == 0
