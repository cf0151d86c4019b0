"""Byte-level BPE through a sentencepiece model that is written straight from the vocabulary.

A rank file lists token bytes and ranks. Each token becomes a piece in which byte ``b`` is the character
``U+0100 + b``; its score is its negative rank, so that the pair that a rank table merges first is the pair with
the highest score, leftmost first in both. Normalisation is the identity. Each match of the split pattern is one
pre-token and is encoded by itself; a pre-token that is a token as a whole is that token, as rank tables have it.
Decoding maps ids back to bytes.

The model is a few MB, bounded by the vocabulary, and is broadcast. Pre-tokens already met are remembered in each
Python worker until its task ends, up to ``MEMORY`` of them and those of the texts in hand; that changes the time only. They are kept in two generations,
so that a full memory does not forget the words that are in use. No shuffle, and no text leaves its row.

Edge cases: a null or empty text has no tokens, and its digests are those of the empty string. Long texts are
encoded whole. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from codecs import charmap_decode
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.batches import slices
from plumbline.session import ship_package

MEMORY = 1 << 17  # pre-tokens remembered, in two generations
AT_ONCE = 1 << 18  # characters of texts that are held as pre-tokens
SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (lines of base64 text and rank), read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A field of a protocol-buffer message: text or message, integer, or 4-byte float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


_CHARACTERS = "".join(chr(0x100 + b) for b in range(256))


def _mapped(raw: bytes) -> str:
    return charmap_decode(raw, "strict", _CHARACTERS)[0]


def model_of(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model; pieces stand in order of rank, the unknown piece comes last."""
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary lacks {len(missing)} single bytes, so it cannot encode every text")
    pieces = b"".join(
        _field(1, _field(1, _mapped(token).encode()) + _field(2, float(-rank)) + _field(3, 1))
        for token, rank in sorted(ranks.items(), key=lambda x: x[1])
    )
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    none = (1 << 64) - 1  # -1 as a varint
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks)) + _field(41, none) + _field(42, none) + _field(43, none)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + unknown + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, model: bytes, ranks: list[int], tokens: list[bytes], pattern: str) -> None:
        self.sp = sentencepiece.SentencePieceProcessor()
        self.sp.LoadFromSerializedProto(model)
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.whole = dict(zip(tokens, ranks, strict=True))
        self.bytes_of = dict(zip(ranks, tokens, strict=True))
        self.written = dict(zip(ranks, map(str, ranks), strict=True))
        self.forget()

    @classmethod
    def of(cls, ranks: dict[bytes, int], pattern: str) -> Codec:
        order = sorted(ranks.items(), key=lambda x: x[1])
        return cls(model_of(ranks), [r for _, r in order], [t for t, _ in order], pattern)

    def _learn(self, parts: set[str]) -> None:
        """Makes the ids of all these pre-tokens known."""
        new = parts.difference(self.known)
        if not new:
            return
        if len(self.known) + len(new) > MEMORY // 2:  # what was used since the last change of generation is kept, the rest waits in ``older``
            self.older, self.known = self.known, {p: self.known[p] for p in parts.intersection(self.known)}
        known, older, rest = self.known, self.older, []
        for p in new:
            ids = older.get(p)
            if ids is not None:
                known[p] = ids
                continue
            raw = p.encode("utf-8", "replace")
            rank = self.whole.get(raw)
            if rank is None:
                rest.append((p, raw))
            else:
                known[p] = (rank,)
        found = self.sp.encode([_mapped(raw) for _, raw in rest], out_type=int, num_threads=1) if rest else []
        of = self.ranks.__getitem__
        for (p, _), ids in zip(rest, found, strict=True):
            known[p] = tuple(map(of, ids))

    def encode_all(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of each text in order. New pre-tokens of several texts, about ``AT_ONCE`` characters, are encoded together."""
        waiting, held = [], 0

        def encoded() -> Iterator[list[int]]:
            self._learn(set().union(*waiting))
            of = self.known.__getitem__
            for parts in waiting:
                yield list(chain.from_iterable(map(of, parts)))

        for text in texts:
            waiting.append(self.split.findall(text))
            held += len(text)
            if held >= AT_ONCE:
                yield from encoded()
                waiting, held = [], 0
        yield from encoded()

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def forget(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def digest(self, ids: list[int]) -> str:
        """SHA-256 of the decimal ids joined by commas."""
        return hashlib.sha256(",".join(map(self.written.__getitem__, ids)).encode()).hexdigest()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODECS: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    """The codec of a broadcast vocabulary, made once per worker process."""
    name, ranks, pattern = shared.value
    if name not in _CODECS:
        _CODECS[name] = Codec.of(ranks, pattern)
    return _CODECS[name]


def shared_vocabulary(docs: DataFrame, ranks_path: str, pattern: str):
    """The vocabulary (bounded by its file) and the split pattern, broadcast."""
    ship_package(docs.sparkSession)
    ranks = read_ranks(ranks_path)
    name = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    return docs.sparkSession.sparkContext.broadcast((name, ranks, pattern))


def encode_ids(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The token ids themselves: ``id_col, ids array<int>``."""
    shared = shared_vocabulary(docs, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for b in slices(batches):
            ids = list(codec.encode_all(t or "" for t in b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])
        codec.forget()

    rows = docs.select(id_col, F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, ids array<int>")


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes of stored ids: ``id_col, decoded binary``; null ids decode to no bytes."""
    shared = shared_vocabulary(encoded, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for b in slices(batches):
            raw = [codec.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], [id_col, "decoded"])

    rows = encoded.select(id_col, ids_col)
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, decodes its ids and returns ``id_col, n_tokens, ids_sha256, decoded_sha256`` (lowercase
    hex of the decimal ids joined by commas, and of the decoded bytes)."""
    shared = shared_vocabulary(docs, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for b in slices(batches):
            out = []
            for ids in codec.encode_all(t or "" for t in b.column(1).to_pylist()):
                out.append((len(ids), codec.digest(ids), hashlib.sha256(codec.decode(ids)).hexdigest()))
            n, a, d = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        codec.forget()

    rows = docs.select(id_col, F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, {SCHEMA}")
