import random
import zlib

import numpy as np

from quillsift.llm import langid

SYLLABLES = {"en": ["the", "ing", "wh", "sh", "er"], "de": ["sch", "ung", "ö", "ein", "tz"], "es": ["ción", "ñ", "que", "rr", "ado"]}


def text(lang, r, n=40):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def rows(n=300):
    r = random.Random(1)
    return [(i, text(lang := r.choice(sorted(SYLLABLES)), r, r.randint(3, 60)), lang) for i in range(n)]


def test_counts_are_of_all_grams_in_any_block(monkeypatch):
    whole = langid.counts("Ab é1 zzz ß")
    assert whole.sum() == 11 + 10 + 9
    monkeypatch.setattr(langid, "BLOCK", 3)
    assert np.array_equal(langid.counts("Ab é1 zzz ß"), whole)
    assert np.array_equal(langid.counts("AB É1 ZZZ ß"), whole)


def test_held_out_accuracy_and_defined_cases(spark):
    data = rows()
    extra = [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !", "de"), (1003, data[0][1], None), (None, data[0][1], "zz"), (1003, data[0][1], None)]
    df = spark.createDataFrame([(*x, 1.0) for x in data + extra], "doc_id long, text string, lang string, score double").repartition(3)
    model = langid.fit(df)
    assert model.labels == ["de", "en", "es"] or "de" in model.labels
    got = langid.predict(df, model).collect()
    assert len(got) == len(data) + len(extra)
    truth = {i: lang for i, _, lang in data}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1000, 1001, 1002))
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id in (1003, None, 0)}) == 1
    kept = langid.accepted(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} >= {i for i, t, _ in data if len(t) > 60}
    assert not {1000, 1001, 1002} & {r.doc_id for r in kept.collect()}


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert [tuple(r) for r in langid.predict(df, model).collect()][0][2:] == ("und", 0.0)
    assert langid.predict(df.limit(0), model).count() == 0


def test_temperature_softens_false_certainty():
    logits = [np.array([4.0, 0.0])] * 10
    assert langid.temperature(logits, [0] * 7 + [1] * 3) > 2
    assert langid.temperature([], []) == 1.0


def test_a_sample_without_errors_does_not_make_scores_certain():
    logits = [np.array([4.0, 0.0])] * 50 + [np.array([0.0, 4.0])] * 50
    heat = langid.temperature(logits, [0] * 50 + [1] * 50)
    assert 0.5 < 1 / (1 + np.exp(-4 / heat)) < 0.999


def test_many_labels_and_floods_of_one_row(spark):
    r = random.Random(2)
    data = [(i, f"{chr(0x4E00 + i % 300) * 3} " * r.randint(2, 5), f"l{i % 300}") for i in range(1800)]
    data += [(5000, "the same row again", "flood")] * 3000
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(df)
    assert len(model.labels) > 256 and "l7" in model.labels and model.predict(chr(0x4E00 + 7) * 9)[0] == "l7"


def test_a_very_long_text_is_read_whole(spark):
    r = random.Random(3)
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.predict(text("de", r, 5) + " " + text("es", r, 400_000))[0] == "es"
