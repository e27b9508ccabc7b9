"""The registered queries of the subpackage, one opN_<name> for each operator, and the pipeline."""

from __future__ import annotations

import public_tokenizers

from . import byte_bpe, chat, decontaminate, html_text, langid, media, pii, simhash, suffix_tree, token_files
from .common import read


def op1_media(spark, sf_dir):
    return media.stored(read(spark, sf_dir, "documents"))


def op2_langid(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op3_simhash(spark, sf_dir):
    return simhash.components(read(spark, sf_dir, "documents"))


def op4_token_files(spark, sf_dir):
    return token_files.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def op5_suffix_tree(spark, sf_dir):
    return suffix_tree.score(read(spark, sf_dir, "documents"))


def op6_html_text(spark, sf_dir):
    return html_text.main_text(read(spark, sf_dir, "pages"))


def op7_decontaminate(spark, sf_dir):
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_chat(spark, sf_dir):
    return chat.rotate(read(spark, sf_dir, "conversations"))


def op9_pii(spark, sf_dir):
    return pii.report(read(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op10_byte_bpe(spark, sf_dir):
    return byte_bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def queries():
    return {"op1_media": op1_media, "op2_langid": op2_langid, "op3_simhash": op3_simhash, "op4_token_files": op4_token_files, "op5_suffix_tree": op5_suffix_tree, "op6_html_text": op6_html_text, "op7_decontaminate": op7_decontaminate, "op8_chat": op8_chat, "op9_pii": op9_pii, "op10_byte_bpe": op10_byte_bpe, "pipeline": pipeline}


def oracle_sql():
    return {"op7_decontaminate": decontaminate.ORACLE, "op8_chat": chat.ORACLE}
