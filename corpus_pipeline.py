"""Five stages from raw documents to token ids, each written as Parquet and read again before the next.

Rejected by language, reduced to one document of each group of near copies, cleared of benchmark passages,
redacted, and encoded. Every stage takes (spark, docs, sf_dir); all but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quillsift.llm import byte_bpe, decontaminate, langid, pii, resemblance
from quillsift.llm.common import read, shared_dir

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def language(spark, docs, sf_dir):
    """Documents whose language is known; those without letters or without a likely language go."""
    return langid.accepted(docs, langid.fit(docs))


def near_copies(spark, docs, sf_dir):
    """One document of each group whose fingerprints are linked, or whose five-word similarity is 0.8 or more."""
    return resemblance.one_of_each(docs)


def benchmark(spark, docs, sf_dir):
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark, docs, sf_dir):
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    redacted = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return redacted
    return redacted.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast(docs.schema["n_chars"].dataType))


def tokens(spark, docs, sf_dir):
    """doc_id, token ids, their number, and the SHA-256 of the bytes that they decode to."""
    path = public_tokenizers.path(VOCABULARY)
    both = byte_bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN, decoded="decoded")
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("personal_data", personal_data), ("tokens", tokens)]
#: Language, fingerprints, contexts and token ids are beyond SQL; tests hold the run against its operators' brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
