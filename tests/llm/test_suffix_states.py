"""The whole tree against one that plain counts give."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quillsift.llm import suffix_states as ss
from quillsift.llm import suffix_tree as st


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 1


def corpus():
    r = random.Random(3)
    once = [" ".join(f"w{n}x{k}" for k in range(12)) for n in range(30)]
    out = [" ".join(r.choice(["New york city", "the end", "é", f"rare{r.randint(0, 99)}", "of the x", "long" * 20 + " tail"]) for _ in range(r.randint(0, 40))) for _ in range(150)]
    return out + once + once + [None, "", "never seen at all", "\tNEW york"]


def brute(rows):
    train = [tokens(t) for i, t in rows if not held(i)]
    c1 = Counter(w for t in train for w in t)
    n, v = sum(c1.values()), len(c1)
    p0 = lambda w: (c1[w] + 0.5) / (n + 0.5 * (v + 1))
    follow = defaultdict(Counter)
    for t in train:
        for d in (1, 2):
            for at in range(d, len(t)):
                follow[tuple(t[at - d : at])][t[at]] += 1
    states = {}

    def p(own, at):
        value = p0(own[at])
        for d in (1, 2):
            s = tuple(own[at - d : at]) if at >= d else None
            if s not in states:
                break
            f = follow[s]
            value = (f[own[at]] + len(f) * value) / (f.total() + len(f))
        return value

    for d in (1, 2):
        for s in [s for s in follow if len(s) == d and follow[s].total() >= 2 and (d == 1 or s[1:] in states)]:
            f, gain = follow[s], 0.0
            for w, c in f.items():
                parent = p([*s[1:], w], d - 1)
                gain += c * math.log((c + len(f) * parent) / (f.total() + len(f)) / parent)
            if gain > st.GAIN * len(f) and gain > st.DIVERGENCE * f.total():
                states[s] = True
    return states, lambda text: (sum(math.log10(p0(w)) for w in tokens(text)), sum(math.log10(p(tokens(text), at)) for at in range(len(tokens(text))))), c1, n


def test_every_context_and_follower_counts(spark, monkeypatch):
    monkeypatch.setattr(ss, "TOKENS", 400)
    rows = [*enumerate(corpus()), (3, corpus()[3]), (None, "new york city")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    states, scored, c1, n = brute(rows)
    assert sum(len(s) == 2 for s in states) > 10 and any("longlong" in s[0] for s in states)
    got = st.score(df).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        own = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(own), sum(c1[w] > 0 for w in own), n)
        assert (r.base_score, r.score) == pytest.approx(scored(texts[r.doc_id]))
    assert st.score(df.limit(0)).count() == 0


def test_packed_numbers():
    import numpy as np

    for a in ([], [0], [0, 255, 256], [2**64 - 1, 1]):
        assert ss._unpack(ss._pack(np.array(a, np.uint64))).tolist() == a
    signed = np.array([0, -1, 5, -(2**40)])
    assert ss._unsigned(ss._unpack(ss._pack(ss._signed(signed)))).tolist() == signed.tolist()
