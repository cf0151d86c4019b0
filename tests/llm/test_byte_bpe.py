from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from llm_fixtures import empty, odd, odd_rows, plain

from plumbline.llm import byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def peer():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def test_codec_equals_the_rank_library(peer):
    codec, rnd = byte_bpe.Codec.of(byte_bpe.read_ranks(PATH), PATTERN), random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "ß", "\x1c", "\x85", "\xa0", "中文", "1", "½", "🙂", "'s", "<|endoftext|>", "\x00", "Ⅷ", "x" * 70, "▁"]
    for text in ["", "a" * 30_000, " " * 5_000] + ["".join(rnd.choices(parts, k=rnd.randint(0, 40))) for _ in range(400)]:
        ids = codec.encode(text)
        assert ids == peer.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_memory_limit_changes_nothing(peer, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMORY", 3)
    codec = byte_bpe.Codec.of(byte_bpe.read_ranks(PATH), PATTERN)
    for text in ["one two three four five six", "six seven one", "eight"]:
        assert codec.encode(text) == peer.encode_ordinary(text)


def test_texts_are_encoded_together_and_words_in_use_stay_known(peer, monkeypatch):
    class Watched:
        def __init__(self, sp):
            self.sp, self.calls = sp, []

        def encode(self, mapped, **named):
            self.calls.append(len(mapped))
            return self.sp.encode(mapped, **named)

    rnd = random.Random(3)
    words = ["".join(rnd.choices("bcdfgqxz", k=9)) for _ in range(400)]
    texts = [" ".join([words[0], words[i], "é🙂"]) for i in range(1, 400)] + ["", "  "]
    codec = byte_bpe.Codec.of(byte_bpe.read_ranks(PATH), PATTERN)
    codec.sp = Watched(codec.sp)
    assert list(codec.encode_all(texts)) == [peer.encode_ordinary(t) for t in texts]
    assert len(codec.sp.calls) == 1
    monkeypatch.setattr(byte_bpe, "MEMORY", 16)
    monkeypatch.setattr(byte_bpe, "AT_ONCE", 30)
    codec.forget()
    codec.sp.calls.clear()
    assert list(codec.encode_all(texts)) == [peer.encode_ordinary(t) for t in texts]
    assert sum(codec.sp.calls) <= 404  # every word once: the one that all texts hold is not forgotten
    assert list(codec.encode_all([])) == []


def test_round_trip_and_stored_ids(spark, peer):
    docs = odd(spark)
    want = []
    for r in odd_rows():
        ids = peer.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert plain(byte_bpe.round_trip(docs, PATH, PATTERN)) == sorted(want, key=lambda r: [(v is not None, v) for v in r])
    texts = docs.where("doc_id < 11")
    back = byte_bpe.decode_ids(byte_bpe.encode_ids(texts, PATH, PATTERN), PATH, PATTERN)
    assert {(r.doc_id, bytes(r.decoded).decode()) for r in back.collect()} == {(r[0], r[1] or "") for r in odd_rows() if r[0] is not None and r[0] < 11}
    assert byte_bpe.round_trip(empty(spark), PATH, PATTERN).count() == 0


def test_vocabulary_without_a_byte_is_refused():
    with pytest.raises(ValueError, match="lacks"):
        byte_bpe.model_of({b"a": 0})
