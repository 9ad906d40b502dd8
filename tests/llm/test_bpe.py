import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from convlens.llm import bpe


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected(whole, text):
    ids = whole.encode(text, add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), whole.decode(ids, skip_special_tokens=False).encode()


def test_documents_match_the_library(docs, corpus, whole):
    got = {r["doc_id"]: r for r in bpe.encode(docs, with_ids=True).collect()}
    assert len(got) == len(corpus)
    for i, text, _ in corpus:
        ids, decoded = expected(whole, text or "")
        assert got[i]["ids_sha256"] == hashlib.sha256(ids).hexdigest() and got[i]["n_tokens"] == len(ids) // 4
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded).hexdigest()
        assert np.array(got[i]["ids"], "<u4").tobytes() == ids


def test_round_trip(docs, corpus):
    back = bpe.decode(bpe.encode(docs, with_ids=True))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t, _ in corpus}


ALPHABET = "ab  \n\t.'s<|endoftext|>ñ 　é1 2中\r​😀̈"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=3000), min_size=1, max_size=3))
def test_any_text_matches_the_library(texts):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder = bpe.encoder_of(bpe.tokenizer_json())
    assert list(coder.encode([t.encode() for t in texts])) == [expected(whole, t) for t in texts]


def test_long_runs_and_small_caches(whole):
    rng = random.Random(4)
    texts = ["x" * 50_000, " " * 9000, "<|endoftext|>" * 900, "é" * 20_000, "".join(rng.choice(ALPHABET) for _ in range(60_000)), ""]
    coder = bpe.ChunkEncoder(bpe.tokenizer_json(), chunk_cache=2000, word_cache=10)
    for _ in range(2):
        assert list(coder.encode([t.encode() for t in texts])) == [expected(whole, t) for t in texts]


def test_chunks_follow_content():
    rng = random.Random(1)
    shared = " ".join(str(rng.random()) for _ in range(2000)).encode()
    a, b = shared, b"another start " + shared
    own = [{d[p:q] for p, q in zip(x, x[1:])} for d, x in ((a, bpe.pieces(a)), (b, bpe.pieces(b)))]
    assert len(own[0] & own[1]) > 0.9 * len(own[0])


def test_segments_agree_with_the_whole(monkeypatch):
    data = " ".join(f"w{i * i % 977}" for i in range(9000)).encode()
    want = bpe.pieces(data)
    monkeypatch.setattr(bpe, "SEGMENT", 1000)
    assert bpe.pieces(data) == want


def test_empty_and_odd_tables(no_docs, odd_docs):
    assert bpe.encode(no_docs).count() == 0
    assert sorted(r["n_tokens"] == 0 for r in bpe.encode(odd_docs).collect()) == [False] * 4 + [True] * 3


def test_new_pieces_reach_the_tokenizer_in_portions(whole, monkeypatch):
    """What the tokenizer returns for a piece is far larger than its ids, so not all new ones of a group are given at once."""
    monkeypatch.setattr(bpe, "TOGETHER", 50)
    coder, most = bpe.ChunkEncoder(bpe.tokenizer_json()), []

    class Counting:
        def encode_batch_fast(self, new, **options):
            most.append(len(new))
            return own.encode_batch_fast(new, **options)

        def decode_batch(self, ids, **options):
            return own.decode_batch(ids, **options)

    own, coder.tokenizer = coder.tokenizer, Counting()
    text = " ".join(f"word{i * i}" for i in range(700)) + " <|endoftext|> é" * 3
    assert list(coder.encode([text.encode()])) == [expected(whole, text)]
    assert max(most) <= 50 and sum(most) > 600
