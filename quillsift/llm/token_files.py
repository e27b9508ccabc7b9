"""Token ids in binary files, coded by a static range asymmetric numeral system.

One table of frequencies, counted over all documents and scaled to 2**SCALE, is shared by all files. Files
follow each other in ascending order of the ids of their documents. A file is a row of independent blocks of
whole documents; the ids of a block are dealt to interleaved lanes whose states are coded together. A block
starts with its lane states, document index and checksum; the footer lists the checkpoints (offset, tokens
before), so any block can be decoded alone and readers share a file by byte ranges. Writers commit through a
manifest: files of failed attempts are never read.

Encoding uses the tokenizers library as loaded, special tokens in a text included. Where its file normalises by
NFC, white space to spaces and lower case and splits between letters and punctuation, distinct pieces between spaces
and line feeds, which such a file never joins, are encoded once and remembered; any other file encodes whole texts.

Defined results: a null or empty text has only the end id; documents of equal id follow each other in the
order of a hash of their texts; null ids come first; an empty table gives no rows. Only id and text are used.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from tokenizers import Tokenizer

from . import files
from .common import delete, id_field, shared_dir

#: Bits of the frequency scale, most lanes, ids of a block, bytes of a reader's range.
SCALE, LANES, BLOCK, RANGE = 20, 1024, 1 << 19, 32 << 20
#: Remembered pieces in each of two generations, and characters that are split at once.
PIECES, PIECE = 1_000_000, 1 << 20
#: Punctuation that is cut from the end of a piece; characters before which a text is not lower-cased here.
TAIL = ".,;:!?*#$%&"
COMPOSED = re.compile("[^\\x00-\u024f]|\u0130")
#: A letter or digit that stays one, alone, in NFC and in lower case, so that punctuation behind it is split from it.
PLAIN = frozenset(c for c in map(chr, range(0x250)) if c.isalnum() and unicodedata.normalize("NFC", c) == c and len(c.lower()) == 1 and unicodedata.category(c.lower())[0] in "LN")
#: A word that normalisation leaves as it is and splitting keeps whole, and the characters that stand for its bytes.
WORD = re.compile("[" + "".join(sorted(c for c in PLAIN if c.isalpha() and c == c.lower())) + "]+")
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: 0x100 + n for n, b in enumerate(b for b in range(0x100) if b not in _SHOWN)}
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
MAGIC, HEAD = b"QSRANS1\n", struct.Struct("<IQIIII")
LOW = np.uint64(1 << 31)


class Pieces(dict):
    """Pieces to their ids; an unknown piece whose core ends in a PLAIN character is the core and the punctuation
    behind it, which the library always splits apart, and both are remembered as pieces; any other unknown piece is
    encoded whole."""

    def __init__(self, library: Tokenizer, code: str):
        self.library, self.tokenize, self.code, self.old = library, library.model.tokenize, code, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            core = piece.rstrip(TAIL)
            if len(core) < len(piece) and core and core[-1] in PLAIN:
                found = self[core] + self[piece[len(core) :]]
            elif WORD.fullmatch(piece):  # one word as it is, so the model alone gives its ids
                found = array(self.code, [t.id for t in self.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTES))]).tobytes()
            else:
                found = array(self.code, self.library.encode(piece, add_special_tokens=False).ids).tobytes()
        self[piece] = found
        return found

    def age(self) -> None:
        """Pieces become the older generation, whose pieces are kept only if they are met again."""
        if len(self) > PIECES:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Texts to ids in the machine's byte order through the library, end id included.

    Pieces between spaces and line feeds are looked up. Where a text has only characters that need no composing,
    it is lower-cased first, as the library would, unless that makes a special token."""

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        parts = json.loads(self.library.to_str(pretty=False))
        split = ((parts["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex", "")
        self.special = [t["content"] for t in parts["added_tokens"]]
        self.by_piece = (parts["normalizer"] or {}).get("normalizers") == NORMALIZERS and split.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.by_piece &= not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"[ \n]", t["content"]) or t["content"][-1:] in TAIL for t in parts["added_tokens"])
        self.type = np.dtype("u2" if self.library.get_vocab_size() <= 1 << 16 else "u4")
        self.end = np.array([end], self.type).tobytes()
        self.pieces = Pieces(self.library, "H" if self.type.itemsize == 2 else "I")

    def _part(self, text: str) -> bytes:
        if not self.by_piece:
            return array(self.pieces.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if text.isascii() or not COMPOSED.search(text):
            low = text.lower()
            if not any(t in low for t in self.special):
                text = low
        self.pieces.age()
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))

    def encode(self, text: str | None) -> bytes:
        text, at, parts = text or "", 0, []
        while at < len(text):
            stop = text.find(" ", at + PIECE) if self.by_piece else -1
            stop = len(text) if stop < 0 else stop
            parts.append(self._part(text[at:stop]))
            at = stop
        return b"".join(parts) + self.end


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end: int) -> Encoder:
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = Encoder(path, end)
    return _ENCODERS[path, end]


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies of 2**SCALE in all, at least 1 for each id that occurs."""
    if not counts.sum():
        return np.zeros(len(counts), np.uint64)
    some = counts > 0
    if some.sum() > 1 << SCALE:
        raise ValueError("more ids than frequencies")
    f = np.where(some, np.maximum(1, counts * ((1 << SCALE) / counts.sum())).astype(np.int64), 0)
    order = np.argsort(-f, kind="stable")
    while excess := int(f.sum()) - (1 << SCALE):
        if excess < 0:
            f[order[0]] -= excess
        else:
            cut = np.minimum(f[order] - 1, excess).clip(0)
            cut = np.minimum(cut, np.maximum(1, f[order] // 8))
            cut = np.minimum(cut, np.maximum(0, excess - (np.cumsum(cut) - cut)))
            f[order] -= cut
    return f.astype(np.uint64)


class Table:
    def __init__(self, f: np.ndarray):
        self.f = f.astype(np.uint64)
        self.base = np.concatenate([[0], np.cumsum(self.f)[:-1]]).astype(np.uint64) if len(f) else self.f
        self.symbol = np.repeat(np.arange(len(f), dtype=np.uint32), f.astype(np.int64))

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lane states, 32-bit words) that decode() turns into ids again."""
        lanes = max(1, min(LANES, len(ids) // 64))
        state, words = np.full(lanes, LOW, np.uint64), []
        f, base = self.f[ids], self.base[ids]
        limit = f << np.uint64(63 - SCALE)
        for row in range((len(ids) - 1) // lanes, -1, -1):
            own = slice(row * lanes, min(len(ids), (row + 1) * lanes))
            x = state[: own.stop - own.start]
            full = x >= limit[own]
            if full.any():
                words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
                x = np.where(full, x >> np.uint64(32), x)
            q, r = np.divmod(x, f[own])
            state[: len(x)] = (q << np.uint64(SCALE)) + r + base[own]
        return state, np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")

    def decode(self, state: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        state, lanes, ids, at = state.copy(), len(state), np.empty(n, np.uint32), 0
        words, mask = words.astype(np.uint64), np.uint64((1 << SCALE) - 1)
        for start in range(0, n, lanes):
            x = state[: min(lanes, n - start)]
            slot = x & mask
            s = self.symbol[slot.astype(np.int64)]
            ids[start : start + len(x)] = s
            x = self.f[s] * (x >> np.uint64(SCALE)) + slot - self.base[s]
            low = np.flatnonzero(x < LOW)
            if len(low):
                x[low] = x[low] << np.uint64(32) | words[at : at + len(low)]
                at += len(low)
            state[: len(x)] = x
        if at != len(words) or not (state == LOW).all():
            raise ValueError("a block does not end where its states began")
        return ids


def save_table(folder: str, f: np.ndarray) -> None:
    raw = f.astype("<u4").tobytes()
    files.put(folder, "_table", struct.pack("<I", zlib.crc32(raw)) + zlib.compress(raw))


_TABLES: dict[str, Table] = {}


def load_table(folder: str) -> Table:
    if folder not in _TABLES:
        data = files.get(folder, "_table")
        raw = zlib.decompress(data[4:])
        if zlib.crc32(raw) != struct.unpack("<I", data[:4])[0]:
            raise ValueError("the frequency table is damaged")
        _TABLES.clear()
        _TABLES[folder] = Table(np.frombuffer(raw, "<u4"))
    return _TABLES[folder]


def pack_block(table: Table, docs: pa.Array, sizes: list[int], ids: np.ndarray) -> bytes:
    index = io.BytesIO()
    with pa.ipc.new_stream(index, pa.schema([("doc", docs.type), ("n", pa.int64())])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([docs, pa.array(sizes, pa.int64())], ["doc", "n"]))
    state, words = table.encode(ids)
    body = index.getvalue() + state.astype("<u8").tobytes() + words.tobytes()
    return HEAD.pack(len(sizes), len(ids), len(state), len(words), len(index.getvalue()), zlib.crc32(body)) + body


def unpack_block(table: Table, data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(documents, their sizes, all ids)."""
    docs, n, lanes, words, index, crc = HEAD.unpack_from(data)
    body = memoryview(data)[HEAD.size :]
    if zlib.crc32(body) != crc:
        raise ValueError("a block is damaged")
    batch = pa.ipc.open_stream(pa.py_buffer(body[:index])).read_next_batch()
    state = np.frombuffer(body[index : index + 8 * lanes], "<u8").astype(np.uint64)
    ids = table.decode(state, np.frombuffer(body[index + 8 * lanes :], "<u4", count=words), n)
    return batch.column(0), batch.column(1).to_numpy(), ids


class Done(WriterCommitMessage):
    def __init__(self, entry: dict | None):
        self.entry = entry


class TokenWriter(DataSourceArrowWriter):
    """Rows (row, doc_id, ids) in order of row; a file for each run of rows of one staged partition."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.type = options["path"], np.dtype(options["id_width"])

    def write(self, iterator):
        table, made, out = load_table(self.folder), [], None
        docs, sizes, ids, held, tokens, points, offset, run, entry = [], [], [], 0, 0, [], 0, None, {}

        def flush():
            nonlocal docs, sizes, ids, held, tokens, offset
            data = pack_block(table, pa.concat_arrays(docs), sizes, np.concatenate(ids))
            points.append([offset, len(data), tokens])
            out.write(data)
            offset, tokens = offset + len(data), tokens + held
            docs, sizes, ids, held = [], [], [], 0

        def close():
            flush()
            footer = json.dumps(points).encode()
            out.write(footer + struct.pack("<I", len(footer)) + MAGIC)
            out.close()
            made.append(entry | {"tokens": tokens, "bytes": offset, "footer": len(footer) + 4 + len(MAGIC)})

        for batch in iterator:
            for i, (row, raw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
                if run != row >> 33:
                    if out is not None:
                        close()
                    run, points, offset, tokens = row >> 33, [], len(MAGIC), 0
                    name, out = files.create(self.folder, f"part-{run:06d}")
                    entry = {"first": row, "name": name}
                    out.write(MAGIC)
                found = np.frombuffer(raw.as_py(), self.type)
                if held and held + len(found) > BLOCK:
                    flush()
                docs.append(batch.column(1).slice(i, 1))
                sizes.append(len(found))
                ids.append(found)
                held += len(found)
        if out is not None:
            close()
        return Done({"made": made})

    def commit(self, messages):
        files.commit(self.folder, sorted((e for m in messages if m for e in m.entry["made"]), key=lambda e: e["first"]))

    def abort(self, messages):
        files.remove(self.folder, [e["name"] for m in messages if m for e in m.entry["made"]])


class Range(InputPartition):
    def __init__(self, entry: dict, before: int, start: int, stop: int):
        self.entry, self.before, self.start, self.stop = entry, before, start, stop


class TokenReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.folder, self.digest = options["path"], "ids_crc32" in schema.names
        self.names = schema.names

    def partitions(self):
        found, before = [], 0
        for entry in files.manifest(self.folder):
            found += [Range(entry, before, at, at + RANGE) for at in range(0, entry["bytes"], RANGE)]
            before += entry["tokens"]
        return found or [Range({}, 0, 0, 0)]

    def read(self, partition):
        entry = partition.entry
        if not entry:
            return
        table, (system, path) = load_table(self.folder), files.at(self.folder)
        with system.open_input_file(f"{path}/{entry['name']}") as f:
            footer = f.read_at(entry["footer"], entry["bytes"])
            for offset, size, before in json.loads(footer[: -4 - len(MAGIC)]):
                if not partition.start <= offset < partition.stop:
                    continue
                docs, sizes, ids = unpack_block(table, f.read_at(size, offset))
                ends = np.cumsum(sizes)
                start = partition.before + before + ends - sizes
                parts = [ids[a:b] for a, b in zip(ends - sizes, ends, strict=True)]
                if self.digest:
                    last = pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([docs, pa.array(start, pa.int64()), pa.array(sizes, pa.int64()), last], self.names)


class TokenFiles(DataSource):
    """Options: path (folder URI), id_type (DDL of the id), view (ids or digest), for writing id_width (of the given ids)."""

    @classmethod
    def name(cls):
        return "quillsift_tokens"

    def schema(self):
        last = "ids_crc32 long" if self.options.get("view") == "digest" else "ids array<int>"
        return f"doc_id {self.options.get('id_type', 'long')}, start long, n_tokens long, {last}"

    def reader(self, schema):
        return TokenReader(schema, dict(self.options))

    def writer(self, schema, overwrite):
        return TokenWriter(dict(self.options))


def stage(docs: DataFrame, folder: str, tokenizer: str, end: int, doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, ids as bytes) in ascending order of the documents, written to folder: texts are encoded once."""
    order = ["doc_id", F.xxhash64("text")]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("ids", T.BinaryType())])

    def run(batches):
        own = encoder(tokenizer, end)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(map(own.encode, part.column(2).to_pylist()), pa.binary())], schema.names)

    rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, schema).write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(schema).parquet(folder)


def count(staged: DataFrame, kind: str) -> np.ndarray:
    """Occurrences of each id in all documents; at most one number for each entry of the vocabulary is collected."""

    def run(batches):
        total = np.zeros(1, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 256):  # counts of a text alone would be as long as the vocabulary
                own = np.bincount(np.frombuffer(b"".join(batch.column(0).slice(at, 256).to_pylist()), kind))
                if len(own) > len(total):
                    own[: len(total)] += total
                    total = own.astype(np.int64)
                else:
                    total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])

    rows = staged.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(max([0, *(r.id for r in rows)]) + 1, np.int64)
    for r in rows:
        total[r.id] = r.n
    return total


def write(docs: DataFrame, folder: str, tokenizer: str, end: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes every text and writes the ids in ascending order of the documents."""
    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    kind = Encoder(tokenizer, end).type.str
    draft = shared_dir(spark, "token-stage")
    staged = stage(docs, draft, tokenizer, end, doc_id, text)
    save_table(folder, scaled(count(staged, kind)))
    staged.write.format("quillsift_tokens").mode("append").option("id_width", kind).save(folder)
    delete(spark, draft)


def read(spark: SparkSession, folder: str, id_type: str = "long", view: str = "ids") -> DataFrame:
    spark.dataSource.register(TokenFiles)
    return spark.read.format("quillsift_tokens").option("id_type", id_type).option("view", view).load(folder)


def digests(docs: DataFrame, tokenizer: str, end: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from files that are written to the shared folder and read back."""
    folder = shared_dir(docs.sparkSession, "tokens")
    write(docs, folder, tokenizer, end, doc_id, text)
    return read(docs.sparkSession, folder, id_field(docs, doc_id).dataType.simpleString(), "digest").withColumnRenamed("doc_id", doc_id)
