"""The registered queries of this subpackage: name to (query, SQL that gives the same rows or None)."""

from __future__ import annotations

from corpusloom.llm import bpe, chat, crf, lexical, licenses, merkle, mixing, ppm, pstable, simhash, toxicity, warc, winnow
from corpusloom.llm.common import bound_batches, table


def op1_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_ppm(spark, sf_dir):
    bound_batches(spark)
    return ppm.held_out_scores(table(spark, sf_dir, "documents"))


def op3_chat(spark, sf_dir):
    return chat.digests(table(spark, sf_dir, "conversations"))


def op4_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_quality(spark, sf_dir):
    return crf.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_winnowing(spark, sf_dir):
    return winnow.edit_report(table(spark, sf_dir, "documents"))


def op10_pstable(spark, sf_dir):
    return pstable.near_duplicates(table(spark, sf_dir, "embeddings"))


def byte_bpe_path() -> str:
    """The vocabulary file of the test machine; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe(spark, sf_dir):
    bound_batches(spark)
    return bpe.round_trip(table(spark, sf_dir, "documents"), byte_bpe_path())


def op11_lexical(spark, sf_dir):
    return lexical.rank_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_warc": (op1_warc, warc.SQL),
    "op2_ppm": (op2_ppm, None),
    "op3_chat": (op3_chat, chat.SQL),
    "op4_licenses": (op4_licenses, None),
    "op5_quality": (op5_quality, None),
    "op6_mixing": (op6_mixing, mixing.SQL),
    "op7_simhash": (op7_simhash, None),
    "op8_bpe": (op8_bpe, None),
    "op9_winnowing": (op9_winnowing, None),
    "op10_pstable": (op10_pstable, pstable.SQL),
    "op11_lexical": (op11_lexical, lexical.SQL),
    "op12_toxicity": (op12_toxicity, None),
    "op13_merkle": (op13_merkle, merkle.SQL),
}
