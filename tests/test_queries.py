"""Every registered query of the library against its SQL twin, on the smallest tables."""

import math
import os

import pytest

from quillsift.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "documents pages labels conversations benchmark events".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are absent")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) and not math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    want = sorted(repr([plain(row[columns.index(c)]) for c in sorted(columns)]) for row in found.fetchall())
    assert sorted(df.columns) == sorted(columns)
    got = sorted(repr([plain(row[c]) for c in sorted(columns)]) for row in df.collect())
    assert got == want


def test_segments_cover_every_block_once(spark):
    from pyspark.sql import functions as F

    from quillsift.operators import segmenter
    from quillsift.sources import markdown

    blocks = markdown.read(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    rows = segmenter.segments(blocks).groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("text", r"\s+", ""))).alias("n"), F.max("tokens_est").alias("most"))
    want = blocks.select("doc_id", F.length(F.regexp_replace(F.array_join(F.transform("blocks", lambda b: b["text"]), ""), r"\s+", "")).alias("n"))
    both = rows.join(want.withColumnRenamed("n", "m"), "doc_id").collect()
    assert len(both) == 200 and all(r.n >= r.m for r in both)


def test_feature_slots_are_checksums(spark):
    import zlib

    from pyspark.sql import functions as F

    from quillsift.functions import text

    words = ["w:the", "b:é ü", "n:len0", ""]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.feature_slot(F.col("w")).alias("s")).collect()
    assert all(r.s == zlib.crc32(r.w.encode()) % 16384 for r in rows)


def test_status_stream_and_landing_folder(spark, tmp_path):
    from quillsift.streaming import feed

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# T\n\nbody")
    (tmp_path / "in" / "b.bin").write_bytes(b"x")
    for _ in range(2):
        feed.write_once(feed.landing(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.format, r.error is None) for r in rows) == [("bin", False), ("md", True)]
    events = [(1, 0, "a"), (1, 1, "a"), (1, 2, "b"), (2, 0, "a"), (1, 3, "a")]
    schema = "key long, at long, status string"
    spark.createDataFrame(events, schema).write.parquet(str(tmp_path / "events"))
    changes = feed.status_changes(spark.readStream.schema(schema).parquet(str(tmp_path / "events")), "key", "at", "status")
    changes.writeStream.format("memory").queryName("changes").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("changes").collect()) == [(1, 0, "a"), (1, 2, "b"), (1, 3, "a"), (2, 0, "a")]


def test_classifier_learns_and_survives_a_round_trip(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillsift.operators import classifier

    rows = [(i, f"submit the report number {i}" if i % 2 else f"history of theory {i}", "task" if i % 2 else "background") for i in range(40)]
    s = spark.createDataFrame(rows, "doc_id long, text string, gold string").select(
        "doc_id", F.lit(1).alias("seq"), "text", F.lit("unknown").alias("zone"), F.lit(0.3).alias("confidence"), F.lit("heuristic").alias("method"), "gold",
        *(F.expr("cast(array() as array<string>)").alias(c) for c in ("signals", "flags", "heading_path")),
    )
    keys = ["doc_id", "seq"]
    vectors = classifier.features(classifier.tokens(s), keys).persist()
    weights, bias = classifier.fit(vectors, s.select(*keys, F.col("gold").alias("zone")), keys)
    classifier.save(weights, bias, str(tmp_path / "model"))
    weights, bias = classifier.load(spark, str(tmp_path / "model"))
    out = classifier.gate(s, classifier.best(classifier.probabilities(vectors, weights, bias, keys), keys), keys).collect()
    assert sum(r.zone == r.gold for r in out) >= 38 and all(r.method == "distilled" for r in out if r.changed)
    with pytest.raises(ValueError):
        classifier.load(spark, str(tmp_path / "model"), version=2)


def test_judge_is_asked_in_batches_and_cannot_say_hidden(spark):
    from pyspark.sql import functions as F

    from quillsift.operators import judge

    class Fake:
        def ask(self, system, user):
            return None if "Document title: two" in user else {"labels": [{"id": "s1", "zone": "task", "confidence": "high"}, {"id": "s2", "zone": "hidden", "confidence": "high"}]}

    none = [F.expr("cast(array() as array<string>)").alias(c) for c in ("signals", "heading_path", "flags")]
    s = spark.createDataFrame([(d, q, f"s{q}", "body & more", 3, "unknown", 0.3, "heuristic") for d in ("one", "two") for q in (1, 2)], "doc_id string, seq int, segment_id string, text string, tokens_est int, zone string, confidence double, method string").select("*", *none)
    titles = s.select("doc_id", F.col("doc_id").alias("title")).distinct()
    prompts = judge.prompts(judge.eligible(s), titles)
    replies = judge.ask(prompts, Fake(), "system")
    answered = judge.batches(s).join(replies.select("doc_id", "batch").distinct(), ["doc_id", "batch"])
    got = {(r.doc_id, r.seq): (r.zone, r.signals) for r in judge.merge(s, replies, answered).collect()}
    assert got[("one", 1)] == ("task", ["llm:high"]) and got[("one", 2)] == ("unknown", ["llm:missing_or_duplicate_id"])
    assert got[("two", 1)] == ("unknown", [])


def twin(name, tables):
    """Rows of a query's SQL over tables of rows, the columns by name."""
    import duckdb

    con = duckdb.connect()
    for table, df in tables.items():
        frame = df.toPandas()  # noqa: F841
        con.execute(f"CREATE TABLE {table} AS SELECT * FROM frame")
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    return sorted(repr([plain(row[columns.index(c)]) for c in sorted(columns)]) for row in found.fetchall())


def rows_of(df):
    return sorted(repr([plain(row[c]) for c in sorted(df.columns)]) for row in df.collect())


@pytest.fixture(scope="module")
def odd_pages(spark, tmp_path_factory):
    heads = ["a &lt;b&gt; &amp;amp; c", "cut&amp;&amp", "token = &quot;73ab9", "&copy; &#65; &amp &lt", "&amp;lt; \ue000 x"]
    page = "<html><head><title>{0}</title></head><body><h1>{0}</h1><!-- ad &amp; {0} --><ul><li><a href='/?a=1&amp;b'>{0}</a></li></ul><p>x</p></body></html>"
    rows = [(i, "u", page.format(h)) for i, h in enumerate(heads)] + [(90, "u", "<p>no title</p>"), (91, "u", None)]
    folder = str(tmp_path_factory.mktemp("odd"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.write.parquet(f"{folder}/pages.parquet")
    return folder, df


def test_titles_decode_the_references_of_their_twin(spark, odd_pages):
    assert rows_of(QUERIES["page_titles_meta"](spark, odd_pages[0])) == twin("page_titles_meta", {"pages": odd_pages[1]})


def test_blocks_decode_the_references_of_their_twin(spark, odd_pages):
    assert rows_of(QUERIES["html_blocks"](spark, odd_pages[0])) == twin("html_blocks", {"pages": odd_pages[1]})


def test_zones_of_odd_texts_equal_their_twin(spark, tmp_path):
    import random

    r = random.Random(5)
    ends = ["Testü den", "È$$$ a", "due tomorrow", "due to", "a must", " ", "- - a", "- b", "• c", "A. b", "A.\x0bb", "Maſk", "tasK 3", "taſk 3", "ınstall it", "İnclude", "must", "submit.", "is a",
            "\r", "end. Use", "for example", "é.", "www.x", "x = 1", "(c) 2020", "émust", "```", "``` x", "[a](b)", "...... 5", "\t", "abc.", "Ünlist", "- [a](b)", "[1] q", "key: v", "٣", "return x;", "{% é %}", "Schedule", "In general,"]
    rows = [(i, "\n".join(" ".join(r.choice(ends) for _ in range(r.choice((1, 2, 3, 8, 30)))) for _ in range(r.randint(1, 9)))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(QUERIES["zone_rules"](spark, str(tmp_path))) == twin("zone_rules", {"documents": df})
