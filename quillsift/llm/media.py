"""Media columns: payloads kept as images in archives, read through a data source of byte ranges.

A payload becomes the 8-bit samples of a lossless PNG of 64 RGB pixels a row, whose private chunk keeps the
unpadded length. Images are members of uncompressed zip archives, rolled at ARCHIVE bytes or MEMBERS
members. The reader plans byte ranges over the archives of a folder; a range owns the members whose headers
begin in it, which the archive's directory tells. Members are streamed in Arrow batches of bounded size and
each is read by its own offset, checked by its CRC and, if that fails, read again from a newly opened file.
Writers commit through a manifest, so archives of failed attempts are never read.

Defined results: a null text is empty, an empty payload is one row of spaces; equal texts give equal images;
repeated rows are members of their own; an empty table gives no rows. A member that stays unreadable fails
the query, or with mode `permissive` has a null image and its error. Only id and text are used.
"""

from __future__ import annotations

import hashlib
import os
import struct
import time
import zipfile
import zlib
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from . import files
from .common import id_field, shared_dir
from .token_files import Done

#: Bytes of an image row; bytes and members of an archive; bytes of a range and of a batch; readings of a member.
ROW, ARCHIVE, MEMBERS, RANGE, BATCH, TRIES = 192, 128 << 20, 50_000, 32 << 20, 8 << 20, 4
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def padded(raw: bytes) -> bytes:
    return raw + b" " * (max(1, -(-len(raw) // ROW)) * ROW - len(raw))


def to_image(raw: bytes) -> bytes:
    """The PNG of a payload; level 1 is enough for text and fixes the bytes."""
    payload = padded(raw)
    rows = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"unPd", struct.pack(">Q", len(raw))) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_image(image: bytes) -> tuple[int, bytes]:
    """(unpadded length, payload) of a PNG that to_image made; damage raises ValueError."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, n, data, height = 8, None, [], 0
    while at < len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            height = struct.unpack_from(">I", body, 4)[0]
        elif kind == b"unPd":
            n = struct.unpack(">Q", body)[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, ROW + 1)
    if n is None or rows[:, 0].any():
        raise ValueError("not an image of a payload")
    return n, rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Size, mean of each channel, and samples in eight bins of brightness."""
    samples = np.frombuffer(payload, np.uint8)
    means = samples.reshape(-1, 3).mean(axis=0)
    bins = np.bincount(samples >> 5, minlength=8)
    return f"{ROW // 3}x{len(samples) // ROW};" + ",".join(f"{m:.3f}" for m in means) + ";" + ",".join(map(str, bins.tolist()))


def read_member(system, path: str, offset: int, size: int, crc: int, tries: int = TRIES, wait: float = 0.2) -> bytes:
    """The bytes of a member, which begin behind its local header at offset; each try opens the archive anew."""
    error = None
    for n in range(tries):
        try:
            with system.open_input_file(path) as f:
                head = f.read_at(30, offset)
                if head[:4] != b"PK\x03\x04":
                    raise OSError("no member begins here")
                name, extra = struct.unpack_from("<HH", head, 26)
                data = f.read_at(size, offset + 30 + name + extra)
            if len(data) != size or zlib.crc32(data) != crc:
                raise OSError("the member is damaged")
            return data
        except (OSError, struct.error) as e:
            error = e
            time.sleep(wait * 2**n if n + 1 < tries else 0)
    raise OSError(f"{path} at {offset}: {error}")


class MediaWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]

    def write(self, iterator):
        part, made, archive, out, name, size, n = TaskContext.get().partitionId(), [], None, None, None, 0, 0

        def close():
            archive.close()
            out.close()
            made.append({"part": part, "name": name})

        for batch in iterator:
            for key, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if archive is None or size > ARCHIVE or n >= MEMBERS:
                    if archive is not None:
                        close()
                    name, out = files.create(self.folder, f"part-{part:06d}")
                    archive, size, n = zipfile.ZipFile(out, "w"), 0, 0
                data = media.as_py()
                info = zipfile.ZipInfo(f"{n}/" + ("null" if key is None else "id-" + quote(key, safe="")) + ".png")
                archive.writestr(info, data)
                size, n = size + len(data), n + 1
        if archive is not None:
            close()
        return Done({"made": made})

    def commit(self, messages):
        files.commit(self.folder, [e for m in messages if m for e in m.entry["made"]])

    def abort(self, messages):
        files.remove(self.folder, [e["name"] for m in messages if m for e in m.entry["made"]])


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class MediaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.permissive = options["path"], options.get("mode") == "permissive"

    def partitions(self):
        """Byte ranges of the committed archives, or of all zip files of a folder without a manifest."""
        system, path = files.at(self.folder)
        try:
            paths = [f"{path}/{e['name']}" for e in files.manifest(self.folder)]
        except FileNotFoundError:
            from pyarrow import fs

            paths = [i.path for i in system.get_file_info(fs.FileSelector(path, recursive=True)) if i.path.endswith(".zip")]
        sizes = {i.path: i.size for i in system.get_file_info(sorted(paths))} if paths else {}
        return [Range(p, at, at + RANGE) for p, size in sizes.items() for at in range(0, size, RANGE)] or [Range("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        system, _ = files.at(self.folder)
        with system.open_input_file(partition.path) as f, zipfile.ZipFile(f) as archive:
            own = sorted((i.header_offset, i.filename, i.compress_size, i.CRC, i.compress_type) for i in archive.infolist() if partition.start <= i.header_offset < partition.stop and not i.is_dir())
        rows, held = [], 0
        for offset, name, size, crc, kind in own:
            media, error = None, None
            try:
                if kind != zipfile.ZIP_STORED:
                    raise OSError(f"{name} is compressed by method {kind}")
                media = read_member(system, partition.path, offset, size, crc)
            except OSError as e:
                if not self.permissive:
                    raise
                error = str(e)
            rows.append((os.path.basename(partition.path), name, offset, media, error))
            held += size
            if held > BATCH:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["archive", "member", "offset", "media", "error"])


class MediaArchives(DataSource):
    """Options: path (folder URI), mode (`permissive` keeps unreadable members as rows)."""

    @classmethod
    def name(cls):
        return "quillsift_media"

    def schema(self):
        return "archive string, member string, offset long, media binary, error string"

    def reader(self, schema):
        return MediaReader(dict(self.options))

    def writer(self, schema, overwrite):
        return MediaWriter(dict(self.options))


def write(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Stores every text as an image in archives under folder."""
    docs.sparkSession.dataSource.register(MediaArchives)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                images = [to_image(x.as_py() or b"") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(images, pa.binary())], ["key", "media"])

    rows = docs.select(F.col(doc_id).cast("string").alias("key"), F.col(text).cast("binary").alias("raw"))
    rows.mapInArrow(run, "key string, media binary").write.format("quillsift_media").mode("append").save(folder)


def read(spark: SparkSession, folder: str, mode: str = "failfast") -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("quillsift_media").option("mode", mode).load(folder)


def describe(media: DataFrame, field: T.StructField) -> DataFrame:
    """Features of read images, named by the id in the member's name."""
    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = "key string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for batch in batches:
            rows = []
            for name, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                image = image.as_py()
                n, payload = from_image(image)
                key = name.rsplit("/", 1)[-1].removesuffix(".png")
                key = None if key == "null" else unquote(key.removeprefix("id-"))
                rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i in (1, 2, 4, 5) else pa.string()) for i, c in enumerate(zip(*rows, strict=True))], names)

    found = media.select("member", "media").where("media IS NOT NULL").mapInArrow(run, schema)
    return found.select(F.col("key").cast(field.dataType).alias(field.name), *names[1:])


def stored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text written to archives in the shared folder, read back and described."""
    folder = shared_dir(docs.sparkSession, "media")
    write(docs, folder, doc_id, text)
    return describe(read(docs.sparkSession, folder), id_field(docs, doc_id))
