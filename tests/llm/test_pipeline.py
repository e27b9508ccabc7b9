import hashlib
import math
import os

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from quillsift.llm import byte_bpe, decontaminate, queries

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are absent")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_keep_columns_and_whole_rows(spark, documents, tmp_path_factory):
    rows = [(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "12 34", None, "s", 5)]
    docs = documents.unionByName(spark.createDataFrame(rows, documents.schema)).unionByName(documents.limit(3))
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('p')}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        if name == "language":
            assert {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in out.select("doc_id").collect()} >= {10**6, 10**6 + 1, 10**6 + 2}
        elif name == "near_copies":
            found = [r.doc_id for r in out.select("doc_id").collect()]
            assert len(found) == len(set(found)) <= docs.select("text").distinct().count()
        elif name == "benchmark":
            report = decontaminate.report(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("NOT contaminated")
            assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in report.collect())
        elif name == "personal_data":
            assert out.count() == docs.count() and out.where("text rlike '[A-Za-z0-9]@[a-z]+[.]'").count() == 0
            assert out.where("n_chars <> length(text)").count() == 0
        else:
            library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path(corpus_pipeline.VOCABULARY)), special_tokens={})
            texts = {r.doc_id: r.text for r in docs.collect()}
            for r in out.collect():
                assert r.ids == library.encode_ordinary(texts[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
            continue
        assert out.columns == documents.columns
        docs = out


def test_empty_documents_go_through(spark, documents, tmp_path):
    docs = documents.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_twin(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet{'' if os.path.isfile(f'{SF}/{t}.parquet') else '/*.parquet'}'")
    df = queries.queries()[name](spark, SF)
    found = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    plain = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    want = sorted(repr([plain(row[columns.index(c)]) for c in sorted(columns)]) for row in found.fetchall())
    assert sorted(repr([plain(row[c]) for c in sorted(columns)]) for row in df.collect()) == want
