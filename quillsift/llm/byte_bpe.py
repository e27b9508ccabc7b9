"""Byte-level BPE through a sentencepiece model that is serialised from the vocabulary.

The ranks of a byte-level vocabulary become the pieces of a sentencepiece BPE model: every byte of a
token is mapped to one character, the score of a piece is its negative rank, normalisation is the
identity. Nothing is trained. Texts are cut into pre-tokens by the pattern of the vocabulary, pre-tokens
are encoded by the model, ids are decoded by the inverse mapping.

Defined results: a null or empty text has no ids; equal texts have equal ids; rows are never merged, so
repeated rows give repeated results; an empty table gives an empty table. Other columns of the input are
kept by encode() and decode(), which refuse an output name that is taken.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_field

#: Pre-tokens in each of two generations of the cache of a Python worker, the longest that is kept there, rows that are
#: worked on at once, and characters of a text that are cut at once. They bound memory and change no result.
CACHE, LONGEST, ROWS, PIECE = 150_000, 64, 128, 1 << 19
UNKNOWN = ""


def byte_characters() -> list[str]:
    """The usual printable stand-in of every byte: itself if it is printable Latin-1, else the next of U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = itertools.count(256)
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _message(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The protocol buffer of a sentencepiece BPE model: piece 0 is the unknown piece, piece r + 1 has the r-th smallest rank."""
    characters = byte_characters()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _message(1, _message(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _number(3, kind))

    pieces = [piece(UNKNOWN, 0.0, 2)]
    pieces += (piece("".join(characters[b] for b in token), float(-rank), 1) for token, rank in sorted(ranks.items(), key=lambda x: x[1]))
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, 0) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    normaliser = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _message(2, trainer) + _message(3, normaliser)


class Codec:
    """Texts to ids and back, for one vocabulary file and pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.code = "H" if max(ranks.values()) < 1 << 16 else "I"
        self.ids = [-1, *sorted(ranks.values())]
        self.whole = {token: array(self.code, [rank]).tobytes() for token, rank in ranks.items()}
        self.to_characters = dict(enumerate(byte_characters()))
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.words = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """Enters words that are not in the cache, from the older generation or by the model."""
        cache, old, rest, mapped = self.cache, self.old, [], []
        for w in words:
            found = old.get(w)
            if found is None:
                raw = w.encode("utf-8", "surrogatepass")
                found = self.whole.get(raw)
                if found is None:
                    rest.append(w)
                    mapped.append(raw.decode("latin-1").translate(self.to_characters))
                    continue
            cache[w] = found
        rank, code = self.ids.__getitem__, self.code
        for w, found in zip(rest, self.model.encode(mapped, out_type=int, num_threads=1), strict=True):
            cache[w] = array(code, map(rank, found)).tobytes()

    def forget(self) -> None:
        self.cache, self.old = {}, {}

    def coded(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as machine words of self.code. New pre-tokens of many texts go to the model at once,
        for a call of it starts a thread."""
        group, size = [], 0
        for text in texts:
            own = text or ""
            if size + len(own) > PIECE:
                yield from self._encode(group)
                group, size = [], 0
            if len(own) > PIECE:
                yield b"".join(itertools.chain.from_iterable(self._encode([part]) for part in self._parts(own)))
            else:
                group.append(own)
                size += len(own)
        yield from self._encode(group)

    def values(self, coded: bytes) -> list[int]:
        return memoryview(coded).cast(self.code).tolist()

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Each distinct pre-token is encoded once while it is remembered."""
        return map(self.values, self.coded(texts))

    def _parts(self, text: str) -> Iterator[str]:
        """Long texts in parts, cut before single spaces between two characters that are not white space: a pattern of
        this family never lets a token run over these."""
        at = 0
        while at < len(text):
            stop = min(len(text), at + PIECE)
            while stop < len(text) and not (text[stop] == " " and not text[stop - 1].isspace() and not text[stop + 1 : stop + 2].isspace() and stop + 1 < len(text)):
                stop += 1
            yield text[at:stop]
            at = stop

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE:
            self.old, self.cache = self.cache, {}
        split = list(map(self.words, texts))
        missing = sorted(set(itertools.chain.from_iterable(split)).difference(self.cache))
        self._learn(missing)
        found = [b"".join(map(self.cache.__getitem__, words)) for words in split]
        for w in missing:
            if len(w) > LONGEST:
                del self.cache[w]
        return found

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _slices(batches):
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def _check_free(df: DataFrame, name: str) -> None:
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the input has a column {name}")


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the ids of each text as array<int> and, where `decoded` is given, the bytes that these decode to."""
    _check_free(docs, out)
    if decoded:
        _check_free(docs, decoded)
    at = docs.columns.index(text)
    fields = [T.StructField(out, T.ArrayType(T.IntegerType()))]
    if decoded:
        fields.append(T.StructField(decoded, T.BinaryType()))

    def run(batches):
        own = codec(path, pattern)
        for batch in _slices(batches):
            coded = list(own.coded(batch.column(at).to_pylist()))
            flat = np.frombuffer(b"".join(coded), own.code).astype(np.int32)
            ends = np.cumsum([0, *map(len, coded)]) // np.dtype(own.code).itemsize
            arrays = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]
            if decoded:
                arrays.append(pa.array((own.decode(own.values(x)) for x in coded), pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *(f.name for f in fields)])
        own.forget()  # the worker goes on to other stages

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with the bytes of each row's ids; null ids give null."""
    _check_free(encoded, out)
    at = encoded.columns.index(ids)

    def run(batches):
        own = codec(path, pattern)
        for batch in _slices(batches):
            found = pa.array([None if x is None else own.decode(x) for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, out])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out, T.BinaryType())]))


def digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the number of its ids and the SHA-256 of ids and decoded bytes; ids do not leave the worker."""
    schema = T.StructType([id_field(docs, doc_id), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        own = codec(path, pattern)
        decimal = {i: str(i) for i in own.tokens}
        for batch in _slices(batches):
            n, of_ids, of_bytes = [], [], []
            for ids in own.encode(batch.column(1).to_pylist()):
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], schema.names)

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, schema)
