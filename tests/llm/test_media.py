import hashlib
import zipfile
import zlib

import pytest

from quillsift.llm import files, media

TEXTS = [None, "", "a", "x" * 191, "x" * 192, "x" * 193, "é" * 500, "trailing   ", "end" + " " * 189, "long " * 40_000]


def test_image_round_trip_and_damage():
    for text in TEXTS:
        raw = (text or "").encode()
        n, payload = media.from_image(media.to_image(raw))
        assert n == len(raw) and len(payload) % 192 == 0 and payload[:n] == raw and not payload[n:].strip(b" ")
    bad = bytearray(media.to_image(b"abc"))
    bad[50] ^= 1
    with pytest.raises(ValueError):
        media.from_image(bytes(bad))


def test_rows_read_back_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(media, "MEMBERS", 3)
    monkeypatch.setattr(media, "RANGE", 300)
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(2, "a", 1), (None, "a", 1), (-5, "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media int").repartition(3)
    got = media.stored(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _, _ in rows)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        payload = media.padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.feature == media.feature(payload)
        assert r.media_bytes == len(media.to_image(raw)) and r.media_sha256 == hashlib.sha256(media.to_image(raw)).hexdigest()
    assert media.stored(df.limit(0)).count() == 0


def test_string_ids_survive(spark):
    df = spark.createDataFrame([("a/b é.png", "x"), ("", "y"), ("null", "z")], "doc_id string, text string")
    assert sorted(r.doc_id for r in media.stored(df).collect()) == ["", "a/b é.png", "null"]


def test_members_are_retried_alone(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("0/id-1.png", media.to_image(b"one"))
        z.writestr("1/id-2.png", media.to_image(b"two"))
    system, folder = files.at(f"file://{tmp_path}")
    with zipfile.ZipFile(path) as z:
        first, second = z.infolist()
    opened = []

    class Flaky:
        def open_input_file(self, p):
            opened.append(p)
            if len(opened) < 3:
                raise OSError("gone")
            return system.open_input_file(p)

    data = media.read_member(Flaky(), f"{folder}/a.zip", second.header_offset, second.compress_size, second.CRC, wait=0)
    assert media.from_image(data)[0] == 3 and len(opened) == 3
    with pytest.raises(OSError):
        media.read_member(system, f"{folder}/a.zip", first.header_offset, first.compress_size, first.CRC ^ 1, wait=0)


def test_foreign_folder_and_permissive_mode(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("0/id-1.png", media.to_image(b"one"))
        z.writestr("1/id-2.png", media.to_image(b"two" * 99))
    data = bytearray((tmp_path / "a.zip").read_bytes())
    data[60] ^= 255
    (tmp_path / "a.zip").write_bytes(data)
    rows = sorted(media.read(spark, f"file://{tmp_path}", "permissive").collect(), key=lambda r: r.offset)
    assert [r.media is None for r in rows] == [True, False] and "damaged" in rows[0].error
    with pytest.raises(Exception, match="damaged"):
        media.read(spark, f"file://{tmp_path}").collect()
