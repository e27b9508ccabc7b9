import itertools
import random

import numpy as np

import corpus_pipeline
from quillsift.llm import resemblance as rs
from quillsift.llm import simhash


def groups():
    """Texts of 40 to 400 words, each with copies in which more and more words are replaced."""
    r = random.Random(3)
    word = lambda: f"w{r.randint(0, 5000)}"
    out = []
    for n in (40, 60, 120, 150, 190, 400):
        base = [word() for _ in range(n)]
        for changes in range(0, n // 25 + 3):
            own = list(base)
            for at in r.sample(range(n), changes):
                own[at] = word()
            out.append(" ".join(own))
    return out + ["one two", "One  two", "", None, " ".join(word() for _ in range(80))]


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pairs_of_five_word_similarity_are_linked(spark):
    texts = groups()
    label = list(range(len(texts)))
    fps = [simhash.fingerprint((t or "").encode()) for t in texts]
    missed = 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets(texts[i]), sets(texts[j])
        close, alike = (fps[i] ^ fps[j]).bit_count() <= 3, bool(a | b) and len(a & b) >= 0.8 * len(a | b)
        missed += alike and not close
        if close or alike:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    assert missed > 5  # which fingerprints alone leave apart
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string").repartition(3)
    want = sorted({x for x in label}) + [None]
    assert sorted((r.doc_id for r in corpus_pipeline.near_copies(spark, df, None).collect()), key=lambda x: (x is None, x)) == want
    assert rs.one_of_each(df.limit(0)).count() == 0


def test_a_crowd_and_its_neighbours(spark):
    r = random.Random(5)
    base = [f"w{r.randint(0, 5000)}" for _ in range(200)]
    rows = []
    for i in range(300):
        own = list(base)
        own[r.randrange(200)] = f"x{i}"
        rows.append((f"d{i:03}", " ".join(own)))
    rows += [("e", " ".join(base[:110] + ["y"] * 90)), ("f", rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    assert sorted(r.doc_id for r in rs.one_of_each(df).collect()) == ["d000", "e"]


def test_prefixes_lose_no_pair_under_any_order():
    r = random.Random(8)
    hashes = [r.getrandbits(64) for _ in range(90)]
    for trial in range(400):
        rng = np.random.default_rng(trial)
        counts = rng.integers(0, 4, rs.SLOTS).astype(np.uint32)
        n = r.randint(1, 60)
        a = set(r.sample(hashes, n))
        b = set(a)
        for _ in range(r.randint(0, 1 + n // 5)):
            b.add(r.choice(hashes)) if r.random() < 0.5 or len(b) == 1 else b.remove(r.choice(sorted(b)))
        if len(a & b) < 0.8 * len(a | b):
            continue
        p, q = (rs.prefix(np.array(sorted(x), np.uint64), counts).tolist() for x in (a, b))
        shared = [x for x in p if x in q]
        assert shared
        # the room that is left after the first shared shingle is enough, as the join demands
        room = min(len(a) - p.index(shared[0]), len(b) - q.index(shared[0]))
        assert room * 1.8 + 1e-6 >= 0.8 * (len(a) + len(b))


def test_a_common_passage_links_nothing(spark):
    r = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([*passage, *(f"u{r.randint(0, 10**6)}" for _ in range(40))])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rs.one_of_each(df).count() == 200
