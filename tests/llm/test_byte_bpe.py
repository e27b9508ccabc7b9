import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from quillsift.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "  a", "a  b", "a \nb", "a\n b", "don't stop", "x" * 5000, "é ü ñ", "​　日本 語", "1234 5 6", "\x1c a\x1d", "a b c", "tab\tx y", "trailing ", "🙂 🙂🙂", " the", "the the the"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def texts():
    r = random.Random(3)
    letters = ["a", "th", "e", " ", "\n", "é", "1", ".", "'s", "ß", "  ", "𝄞", "́", "-"]
    return ODD + ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(400)]


def test_same_ids_as_the_library_and_round_trip(library):
    own = byte_bpe.Codec(PATH, P.PATTERN)
    for text, ids in zip(texts(), own.encode(texts()), strict=True):
        assert ids == library.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()


def test_long_texts_in_parts(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECE", 9)
    own = byte_bpe.Codec(PATH, P.PATTERN)
    for text, ids in zip(texts(), own.encode(texts()), strict=True):
        assert ids == library.encode_ordinary(text), repr(text)


def test_digests_of_null_repeated_and_extra_columns(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "the cat", "y"), (3, "the cat", "y"), (None, "dog", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r[0], r[1], r[2], r[3]) for r in byte_bpe.digests(df, PATH, P.PATTERN).collect()}
    want = set()
    for i, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == want
    assert byte_bpe.digests(df.limit(0), PATH, P.PATTERN).count() == 0


def test_columns_go_through_encode_and_decode(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    both = byte_bpe.decode(byte_bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).orderBy("doc_id").collect()
    assert bytes(both[0].decoded) == b"a b" and both[1].ids == []
    one = byte_bpe.encode(df, PATH, P.PATTERN, decoded="raw").orderBy("doc_id").collect()
    assert [bytes(r.raw) for r in one] == [b"a b", b""]
    with pytest.raises(ValueError):
        byte_bpe.encode(df, PATH, P.PATTERN, out="TEXT")


def test_the_model_is_asked_once_for_many_texts_and_for_no_word_it_remembers(library, monkeypatch):
    own, asked = byte_bpe.Codec(PATH, P.PATTERN), []

    class Model:
        def encode(self, words, **more):
            asked.append(list(words))
            return model.encode(words, **more)

    model, own.model = own.model, Model()
    monkeypatch.setattr(byte_bpe, "CACHE", 100)
    assert list(own.encode(texts())) == [library.encode_ordinary(t) for t in texts()]
    assert len(asked) == 1  # 418 texts
    assert all(len(w) <= byte_bpe.LONGEST for w in own.cache) and any(len(w) > byte_bpe.LONGEST for w in asked[0])
    short = [t for t in texts() if all(len(w) <= byte_bpe.LONGEST for w in own.words(t))]
    assert list(own.encode(short)) == [library.encode_ordinary(t) for t in short]  # from the older generation
    assert len(own.old) > 100 and not any(asked[1:])
