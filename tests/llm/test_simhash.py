import random
import re

import numpy as np
import xxhash

from quillsift.llm import components, simhash


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """pairs of id and fingerprint."""
    label = [i for i, _ in pairs]
    changed = True
    while changed:
        changed = False
        for a in range(len(pairs)):
            for b in range(len(pairs)):
                if (pairs[a][1] ^ pairs[b][1]).bit_count() <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_fingerprint_by_definition(monkeypatch):
    texts = [None, "", " \n", "One", "one two", "A b c", "É x é X y z w", "a b c a b c a b c", " ".join(f"w{i % 37}" for i in range(500))]
    for block in (1 << 20, 7):
        monkeypatch.setattr(simhash, "BLOCK", block)
        for text in texts:
            assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text), text


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "COMPARE", 64)
    r = random.Random(5)
    base = [" ".join(r.choice("abcdefghij") * r.randint(1, 3) for _ in range(r.randint(0, 80))) for _ in range(60)]
    texts = base + [t + " tail" for t in base[:25]] + base[:15] + [None, "", "\t"]
    rows = [(i * 3 + 1, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(3)
    got = {row[0]: (row[1], row[2]) for row in simhash.components(df).collect()}
    pairs = [(i, brute_fingerprint(t)) for i, t, _ in rows]
    for (i, fp), label in zip(pairs, brute_components(pairs), strict=True):
        assert got[i] == (f"{fp:016x}", label)


def test_links_of_crowds_are_whole(spark, monkeypatch):
    monkeypatch.setattr(simhash, "COMPARE", 256)
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**64, 8, dtype=np.uint64)
    fps = set()
    for c in centres:
        for _ in range(60):
            x = int(c)
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)], "doc_id long, fp long")
    for blocks in (2, 4):
        got = {r.doc_id: r.component_id for r in simhash.of_fingerprints(df, "doc_id", 3, blocks).collect()}
        assert [got[i] for i in range(len(fps))] == brute_components(list(enumerate(fps)))


def test_stars_of_paths_and_none(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(40, 50), (50, 40), (7, 7)], "u long, v long")
    got = {(r.u, r.v) for r in components.stars(edges).collect()}
    assert got == {(i, 0) for i in range(1, 21)} | {(50, 40)}
    assert components.stars(edges.limit(0)).count() == 0


def test_one_of_each_keeps_clean_null_and_one_of_repeats(spark):
    rows = [(4, "a b c d"), (2, "a b c d"), (2, "a b c d"), (9, "quite other words here"), (None, "a b c d"), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id) for r in simhash.one_of_each(df).collect())
    assert got == [(False, 2), (False, 7), (False, 9), (True, None)]
    assert simhash.one_of_each(df).columns == ["doc_id", "text"]
    assert simhash.components(df.limit(0)).count() == 0


def test_one_task_links_few_edges_as_rounds_do_and_in_two_writes(spark, monkeypatch):
    r = random.Random(4)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 500)] + [(7, 7)]
    written, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df, tag: written.append(tag) or cut(df, tag))
    for kind, name in (("long", lambda x: x), ("string", lambda x: f"d{x}é")):
        edges = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], f"u {kind}, v {kind}").repartition(3)
        written.clear()
        own = components.stars(edges)
        assert len(written) <= 2 and own.dtypes == edges.dtypes
        with monkeypatch.context() as m:
            m.setattr(components, "ALONE", 0)
            assert sorted(own.collect()) == sorted(components.stars(edges).collect())
    assert components.stars(edges.limit(0)).count() == 0
