import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillsift.llm import suffix_tree as st


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def corpus():
    r = random.Random(8)
    out = []
    for _ in range(200):
        words = []
        while len(words) < r.randint(0, 60):
            words += r.choice([["New", "york", "city"], ["the", "end"], ["é"], [f"rare{r.randint(0, 400)}"], ["of", "the", "x"]])
        out.append(" ".join(words))
    return out + [None, "", "never seen at all", "\tNEW york"]


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 1


@pytest.fixture(scope="module")
def result(spark):
    old = st.CONTEXT, st.FOLLOWER
    st.CONTEXT, st.FOLLOWER = 5e-3, 5e-4
    rows = [(i, t, 0.0) for i, t in enumerate(corpus())] + [(3, corpus()[3], 0.0), (None, "new york", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)
    both = df.select("doc_id", st.held_out("doc_id").alias("held_out"), df.text.cast("binary").alias("raw"))
    train = both.where("NOT held_out").select("raw")
    words = st.cut(st.vocabulary(train), "test")
    model = st.fit(train, words)
    got = st.scored(both, "doc_id", words, model).collect()
    whole = st.score(df).collect()
    empty = st.score(df.limit(0)).count()
    st.CONTEXT, st.FOLLOWER = old
    assert sorted(map(str, got)) == sorted(map(str, whole)) and empty == 0
    return rows, model, got


def test_base_columns_equal_brute_force(result):
    rows, _, got = result
    c = Counter(t for i, text, _ in rows if not held(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    texts = {i: t for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        own = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(own), sum(c[t] > 0 for t in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own))


def test_scores_equal_a_direct_reading_of_the_tree(result):
    rows, model, got = result
    assert len(model.states[0]) and len(model.states[1])
    c = Counter(t for i, text, _ in rows if not held(i) for t in tokens(text))
    whole = model.total + 0.5 * (model.distinct + 1)
    number = lambda t: st.END if t is None else model.words.get(t.encode(), st.RARE)
    explicit = [dict(zip(codes.tolist(), n.tolist(), strict=True)) for codes, n in model.followers]
    index = [{s: i for i, s in enumerate(states.tolist())} for states in model.states]

    def p(own, at):
        value, w = (c[own[at]] + 0.5) / whole, number(own[at])
        before = [number(t) for t in own[max(0, at - 2) : at]]
        for depth in (0, 1):
            if len(before) <= depth or st.RARE in before[-depth - 1 :]:
                break
            code = before[-1] if depth == 0 else before[-2] * model.size + before[-1]
            if code not in index[depth]:
                break
            s = index[depth][code]
            rest = model.rests[depth][s]
            found = explicit[depth].get(s * model.size + w, 0) if w != st.RARE else 0
            value = (found + rest * value) / (model.sums[depth][s] + rest)
        return value

    texts = {i: t for i, t, _ in rows}
    for r in got:
        own = tokens(texts[r.doc_id])
        assert r.score == pytest.approx(sum(math.log10(p(own, at)) for at in range(len(own))))
    long_held = [r for r in got if r.held_out and r.n_tokens > 10]
    assert np.mean([r.score - r.base_score for r in long_held]) > 1


def test_states_are_distributions_and_their_parents_stay(result):
    _, model, _ = result
    assert set((model.states[1] % model.size).tolist()) <= set(model.states[0].tolist())
    rare = 1 - model.p0[1:].sum()
    for a in model.states[0][:20].tolist():
        p = [model.probabilities(np.array([a, w]))[1] for w in range(1, model.size)]
        assert sum(p) + model.probabilities(np.array([a, st.RARE]))[1] * rare == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert {(r.n_tokens, r.n_known, r.base_score, r.score) for r in st.score(df).collect()} == {(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)}
