import hashlib
import random
import re

import pytest

from quillsift.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    w, hit, own = words(text), set(), set()
    for item, t in items:
        v = words(t)
        k = min(window, len(v))
        for a in range(len(v) - k + 1 if v else 0):
            for p in range(len(w) - k + 1):
                if w[p : p + k] == v[a : a + k]:
                    hit.update(range(p, p + k))
                    own.update([] if item is None else [str(item)])
    size, at = longest(w, items, window)
    return len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit), size, at


def longest(w, items, window):
    """(words, first word) of the longest run of words that an item has too, if it holds a window."""
    best = (0, -1)
    for _, t in items:
        v = words(t)
        k = min(window, len(v))
        for a in range(len(v)):
            for p in range(len(w)):
                n = 0
                while a + n < len(v) and p + n < len(w) and v[a + n] == w[p + n]:
                    n += 1
                if k and n >= k:
                    best = min(best, (-n, p)) if best[0] else (-n, p)
    return -best[0], best[1]


def fixture():
    r = random.Random(2)
    text = lambda n: " ".join(r.choice(["a", "b", "C", "é", "d1", "x-y", "zz", "ß."]) for _ in range(n))
    items = [(i, text(r.randint(8, 25))) for i in range(12)] + [(20, "only, three Words"), (21, "solo"), (22, ""), (23, None), (None, text(12)), (24, "...")]
    items.append((30, items[0][1]))
    docs = [text(r.randint(0, 200)) for _ in range(40)]
    docs += [f"{docs[i]} {items[i % 12][1].upper()} {docs[i + 1]}" for i in range(15)]
    docs += [None, "", "solo", "only three", "x only three WORDS y", "only three words " * 3, items[-2][1] or ""]
    return docs, items


@pytest.mark.parametrize("limit", [32 << 20, 300])
def test_report_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(dc, "ITEM_BYTES", limit)
    docs, items = fixture()
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)] + [(0, docs[0], "again")], "doc_id long, text string, n_hit string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.report(table, bench).collect()
    assert len(got) == len(docs) + 1
    for row in got:
        assert tuple(row)[1:] == brute(docs[row.doc_id], items), row


def test_small_shards_and_blocks_change_nothing(monkeypatch):
    docs, items = fixture()
    raws = [None if t is None else t.encode() for t in docs]
    finder = dc.Finder([(None if i is None else str(i), None if t is None else t.encode()) for i, t in items])
    whole = [(n, c.tolist(), o, x) for n, c, o, x in finder.judge(raws)]
    monkeypatch.setattr(dc, "SHARD", 30)
    monkeypatch.setattr(dc, "BLOCK", 11)
    assert [(n, c.tolist(), o, x) for n, c, o, x in finder.judge(raws)] == whole


def test_clean_keeps_clean_rows_and_columns(spark):
    docs, items = fixture()
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.clean(table, bench)
    assert got.columns == table.columns
    assert {r.doc_id for r in got.collect()} == {i for i, t in enumerate(docs) if not brute(t, items)[4]}
    assert dc.clean(table, bench.limit(0)).count() == len(docs)
    assert dc.report(table.limit(0), bench).count() == 0


def test_longest_matches(spark):
    passage = " ".join(f"w{i}" for i in range(14))
    docs = spark.createDataFrame([(1, f"x {passage} y"), (2, " ".join(passage.split()[:9]))], "doc_id long, text string")
    bench = spark.createDataFrame([("q", passage)], "item_id string, text string")
    assert [tuple(r) for r in dc.matches(docs, bench).collect()] == [(1, "q", 1, 14)]


def test_a_match_follows_one_place_of_the_benchmark(spark):
    """Windows that occur twice in an item go on differently; a run may not hop from one place to the other."""
    common = " ".join(f"c{i}" for i in range(12))
    bench = spark.createDataFrame([("q", f"{common} left one two {common} right three four")], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"x {common} left one y"), (2, f"{common} right"), (3, f"one two {common} left"), (4, "w " * 300_000 + common)], "doc_id long, text string")
    got = {r.doc_id: (r.n_longest, r.longest_at) for r in dc.report(docs, bench).collect()}
    assert got == {1: (14, 1), 2: (13, 0), 3: (14, 0), 4: (12, 300_000)}
    spans = sorted(tuple(r) for r in dc.matches(docs, bench).where("doc_id = 3").collect())
    assert spans == [(3, "q", 0, 14), (3, "q", 2, 13)]
