import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from quillsift.llm import files, token_files

PATH = P.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n", "a b", "A  b\nC", "don't é́ ́x", "\x1c x\x85y\xa0z", "<|endoftext|> q", "日本 🙂", "w" * 3000, "1 22 333"]


def library():
    return Tokenizer.from_file(PATH)


def texts():
    r = random.Random(6)
    return ODD + [" ".join(r.choice(["the", "of", "Zug", "é", "x.", "12", "\n", ""]) for _ in range(r.randint(0, 300))) for _ in range(120)]


def equal_to_library(texts):
    own, lib = token_files.encoder(PATH, 2), library()
    for text, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.encode(text), own.type).tolist() == [*e.ids, 2], ascii(text)


def test_every_character_beside_every_mark_gives_the_library_s_ids():
    """Each code point before and after the punctuation that pieces are cut at, and alone between letters."""
    points = [chr(c) for c in (*range(0x0, 0xD800), *range(0xE000, 0x11000), *range(0x1D400, 0x1D800, 7), *range(0x1F300, 0x1F700, 5))]
    shapes = ["{c}.", "ac{c}.b", "{c} x", "a{c}:;!?,", ".{c}"]
    for at in range(0, len(points), 20_000):
        for shape in shapes:
            equal_to_library([shape.replace("{c}", c) for c in points[at : at + 20_000]])


def test_random_texts_give_the_library_s_ids():
    r = random.Random(12)
    odd = ["İ", "é", "e\u0301", "\u0958", "क़", "Σ", "ς", "ﬁ", "ß", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>.", "'s", "'LL", ".", "...", ",", "!", "?!", ":", ";", " ", "  ", "\n", "\t", "\u00a0", "\u200b", "\u0307", "日本", "٣", "½", "²", "x", "Abc", "12", "🙂", "\x00", "_", "-"]
    equal_to_library(["".join(r.choice(odd) for _ in range(r.randint(1, 12))) for _ in range(30_000)])


def test_a_file_of_another_kind_encodes_whole_texts(tmp_path):
    import json

    parts = json.load(open(PATH))
    parts["normalizer"] = {"type": "NFC"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(parts))
    own, lib = token_files.Encoder(str(path), 2), Tokenizer.from_file(str(path))
    for text in ("The End. Of", "İ... x", "a  b\nC"):
        assert np.frombuffer(own.encode(text), own.type).tolist() == [*lib.encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("lanes,n", [(1024, 1), (1024, 70_000), (4, 1000), (7, 1001)])
def test_coder_round_trip(monkeypatch, lanes, n):
    monkeypatch.setattr(token_files, "LANES", lanes)
    ids = (np.random.default_rng(n).pareto(0.6, n) * 3).astype(np.int64) % 49_408
    table = token_files.Table(token_files.scaled(np.bincount(ids, minlength=49_408)))
    assert int(table.f.sum()) == 1 << token_files.SCALE
    state, words = table.encode(ids)
    assert np.array_equal(table.decode(state, words, n), ids)


def test_table_of_one_and_of_many_rare_ids():
    assert token_files.scaled(np.array([0, 5])).tolist() == [0, 1 << token_files.SCALE]
    f = token_files.scaled(np.concatenate([np.ones(40_000, np.int64), [10**12]]))
    assert f.min() == 1 and f.sum() == 1 << token_files.SCALE


def test_damage_is_found():
    import pyarrow as pa

    table = token_files.Table(token_files.scaled(np.array([3, 1])))
    data = token_files.pack_block(table, pa.array([7]), [4], np.array([0, 1, 0, 0]))
    assert token_files.unpack_block(table, data)[2].tolist() == [0, 1, 0, 0]
    with pytest.raises(ValueError):
        token_files.unpack_block(table, data[:-1] + bytes([data[-1] ^ 1]))


def test_files_give_back_what_the_library_encodes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_files, "BLOCK", 2000)
    monkeypatch.setattr(token_files, "RANGE", 4000)
    rows = [(3 * i - 20, t, 0) for i, t in enumerate(texts())]
    rows += [rows[5], (None, "null id", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)
    folder = f"file://{tmp_path}/ids"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    token_files.write(df, folder, PATH, 2)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files.manifest(folder)) > 1
    own = library()
    want = {i: own.encode(t or "", add_special_tokens=False).ids + [2] for i, t, _ in rows}
    got = sorted(token_files.read(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _, _ in rows), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r.ids == want[r.doc_id] and r.start == at and r.n_tokens == len(r.ids)
        at += len(r.ids)
    for r in token_files.digests(df, PATH, 2).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id], "<u4").tobytes())
    assert token_files.digests(df.limit(0), PATH, 2).count() == 0


def test_a_known_word_before_new_marks_asks_the_library_for_the_marks_alone():
    own, asked = token_files.Encoder(PATH, 2), []
    library = own.library

    class Library:
        def encode(self, text, **more):
            asked.append(text)
            return library.encode(text, **more)

    own.pieces.library = Library()
    text = "ouat heerth*** ouat*** Zug$$$ zug$$$, 12%&# heerth# é*"
    assert np.frombuffer(own.encode(text), own.type).tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]
    assert sorted(asked) == sorted(["#", "$$$", "$$$,", "%&#", "***", "*", "12"])
    equal_to_library(["<|endoftext|>* q", "a<|endoftext|>$", "x*̸", "'s* don't%", "İ#", "½&", "=$", "a*b* c", "*", "é$$"])


def test_counts_over_many_rows(spark):
    ids = [np.random.default_rng(i).integers(0, 40 + i, i % 7).astype("<u2") for i in range(700)]
    staged = spark.createDataFrame([(bytearray(x.tobytes()),) for x in ids], "ids binary").repartition(2)
    want = np.bincount(np.concatenate(ids))
    assert token_files.count(staged, "<u2").tolist() == want.tolist()
