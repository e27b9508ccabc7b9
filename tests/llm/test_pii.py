import hashlib
import random
import re

from quillsift.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, v):
    digits = [int(c) for c in v if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        twice = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    spans = [(k, m.start(), m.end()) for k, e in BASE.items() for m in re.finditer(e, text or "") if valid(k, m[0])]
    return [sum(s[0] == k for s in spans) for k in BASE], ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def texts():
    r = random.Random(4)
    bits = ["a@b.c", "x_y@d-e.f.g", "@", "1.2.3.4", "256.1.1.1", "001.002.003.0255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "+1 (269) 555-3296", "+12", "+1234567890123456", "é", "𝄞", " ", ".", "-", "+", "7", "_z@q.r", "a@b.c_d@e.f", "\n", "tok=9a8b7c6d"]
    out = ["".join(r.choice(bits) for _ in range(r.randint(1, 25))) for _ in range(300)]
    return out + [None, "", "9" * 30_000, "a" * 60_000 + "@", "a." * 20_000 + "@b", ("1.2.3.4 " * 1500).strip(), "+1" + " " * 20_000]


def test_seeds_equal_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    rows += [rows[0], (None, "me@here.org", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    got = pii.report(df).collect()
    assert len(got) == len(rows)
    for row in got:
        text = "me@here.org" if row.doc_id is None else rows[row.doc_id][1]
        counts, listed = brute(text)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == counts, (text or "")[:200]
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) <= set(row.spans.split(",")) | {""}
    assert pii.report(df.limit(0)).count() == 0


def test_contexts_find_unseen_identifiers_and_leave_others(spark):
    docs = [f"word here reach me at: user{i}@mail{i}.example.org today" for i in range(6)]
    docs += ["please reach me at: someone4711[at]mail now", "the year 2024 was long", "again someone4711[at]mail alone", "only words"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(df).collect()}
    at = docs[6].index("someone")
    assert spans[6] == f"email:{at}:{at + 19}"[: len(spans[6])] and spans[6].startswith(f"email:{at}:")
    assert spans[8].startswith("email:6:") and spans[7] == "" and spans[9] == ""
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[6] == "please reach me at: [EMAIL] now" and clean[7] == docs[7] and clean[0] == "word here reach me at: [EMAIL] today"


def test_redacted_text_keeps_columns_rows_and_clean_texts(spark):
    docs = [(1, "mail a@b.co or +1 (269) 555-3296, ok", "x"), (2, "clean 12 text", "y"), (3, None, "z"), (4, "𝄞 a@b.co", None), (4, "𝄞 a@b.co", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, _key string")
    got = pii.redact(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == [(1, "mail [EMAIL] or [PHONE], ok"), (2, "clean 12 text"), (3, None), (4, "𝄞 [EMAIL]"), (4, "𝄞 [EMAIL]")]


def test_copies_of_a_text_do_not_weaken_its_contexts(spark):
    docs = [f"word here reach me at: user{i}@mail{i}.example.org today" for i in range(6) for _ in range(1000)]
    docs += ["please reach me at: someone4711[at]mail now"] * 3 + ["the year 2024 was long"] * 1000
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert all(spans[i].startswith("email:20:") for i in range(6000, 6003)) and spans[6003] == ""
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[6002] == "please reach me at: [EMAIL] now" and clean[6003] == docs[6003]


def test_learned_identifiers_teach_further_contexts(spark):
    mail = [f"u{i}@m{i}.example.org" for i in range(3)]
    hops = [[f"{c}{i}4711[at]mail" for i in range(3)] for c in "xyz"]
    contexts = ["reach me at:", "write letters to:", "ask kindly for:", "never mind about:"]
    docs = [f"{c} {inst} today" for c, known, new in zip(contexts, [mail, *hops], [*hops, ["w4711[at]mail"]], strict=True) for inst in known + new]
    docs += ["the year 2024 was long", "the year 2025 was long", "the year 2026 was long"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert [i for i in spans if not spans[i].startswith("email:")] == [i for i, d in enumerate(docs) if d.startswith("the year")]


def planted(seed=1):
    """(text, its span, whether no base expression can see it): each kind has contexts before and behind it, and odd spellings of its identifiers beside the usual ones."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    luhn = lambda c: next(c + k for k in "0123456789" if valid("card", c + k))
    usual = {
        "email": lambda: f"u{d(4)}@m{d(3)}.example.org", "ip": lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)), "card": lambda: luhn(d(15)), "phone": lambda: f"+49{d(9)}",
        "secret": lambda: hashlib.sha1(d(9).encode()).hexdigest(),
    }
    odd = {
        "email": lambda: f"u{d(4)}(at)m{d(3)}.example.org", "ip": lambda: f"fe80::{d(2)}a:{d(3)}", "card": lambda: ".".join(d(4) for _ in range(4)), "phone": lambda: f"0{d(3)}/{d(6)}",
        "secret": lambda: hashlib.sha1(d(9).encode()).hexdigest().upper(),
    }
    before = {"email": ["mail me:", "reach us at"], "ip": ["from host", "server address"], "card": ["card number", "charged to:"], "phone": ["call me:", "dial"], "secret": ["token =", "api key"]}
    behind = {"email": "is my mailbox", "ip": "refused connections", "card": "was declined", "phone": "rings forever", "secret": "grants access"}
    filler = lambda: " ".join(r.choice(["the", "house", "of", "2024", "stood", "at", "well-known", "number", "4.0", "from", "me:"]) for _ in range(r.randint(3, 20)))
    rows = []
    for _ in range(900):
        kind = r.choice(list(usual))
        unseen = r.random() < 0.25
        value = (odd if unseen else usual)[kind]()
        left = filler() + " " + (r.choice(before[kind]) + " " if r.random() < 0.8 else "")
        right = " " + behind[kind] if not left.rstrip().endswith(tuple(before[kind])) else " " + filler()
        span = f"{kind}:{len(left)}:{len(left) + len(value)}"
        rows.append((left + value + right, span, unseen))
    return rows + [(filler(), "", False) for _ in range(600)]


def test_planted_unseen_identifiers_are_found(spark):
    rows = planted()
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(rows)], "doc_id long, text string").repartition(4)
    found = {r.doc_id: {x for x in r.spans.split(",") if x} for r in pii.report(df).collect()}
    wanted = hits = false = 0
    for i, (text, span, unseen) in enumerate(rows):
        base = set(brute(text)[1].split(","))
        wanted, hits = wanted + unseen, hits + (unseen and span in found[i])
        false += len(found[i] - {span} - base)
    assert wanted > 150 and hits >= 0.9 * wanted and false <= 0.01 * hits, (wanted, hits, false)


def test_long_words_beside_identifiers_and_columns_with_clashing_names(spark):
    rows = [(i, "x" * 3000 + f" u{i}@m{i}.example.org ok", "a", "b") for i in range(4)] + [(9, "x" * 3000 + " u99(at)m ok", "a", "b"), (10, "x" * 2999 + "y u98(at)m no", "a", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _cands string, words string")
    spans = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert spans[9] == "email:3001:3009" and spans[10] == ""
    assert pii.redact(df).where("doc_id = 9").first().text.endswith("x [EMAIL] ok")


def test_identifiers_without_any_pattern(spark):
    df = spark.createDataFrame([(1, "a b@c.de f"), (2, "v1.2 g"), (3, "h +49123456789"), (4, "only 2024-x")], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert spans == {1: "email:2:8", 2: "", 3: "phone:2:14", 4: ""}
