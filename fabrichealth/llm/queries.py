"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabrichealth.llm import bitplanes, decontaminate, interpolation, lexical, licenses, neardup, negatives, packing, perspectives, quality, secrets, toxicity, urls
from fabrichealth.llm.common import crc_mod, table


def op1_deleted_interpolation(spark, sf_dir):
    return interpolation.score(table(spark, sf_dir, "documents"))


def op2_perspectives(spark, sf_dir):
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


def op3_secret_forest(spark, sf_dir):
    return secrets.findings(table(spark, sf_dir, "documents"))


def op4_chosen_path(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_risk_controlled(spark, sf_dir):
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bit_planes(spark, sf_dir):
    return bitplanes.query(spark, table(spark, sf_dir, "documents"))


def op7_noisy_or(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(crc_mod("doc_id", 4) != 2).select("doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    first = ["doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")]
    return scored.select(*first, *(c for c in scored.columns if c not in ("doc_id", "score")))


def op8_cgk_windows(spark, sf_dir):
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_host_words(spark, sf_dir):
    return urls.query(table(spark, sf_dir, "pages"))


def op10_best_fit(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_diagonal_voting(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op12_shared_lists(spark, sf_dir):
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_document_trie(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries():
    return {
        f.__name__: f
        for f in (op1_deleted_interpolation, op2_perspectives, op3_secret_forest, op4_chosen_path, op5_risk_controlled, op6_bit_planes, op7_noisy_or, op8_cgk_windows, op9_host_words, op10_best_fit, op11_diagonal_voting, op12_shared_lists, op13_document_trie)
    }


def oracle_sql():
    return {"op2_perspectives": perspectives.ORACLE, "op5_risk_controlled": quality.oracle(), "op11_diagonal_voting": licenses.oracle(), "op12_shared_lists": negatives.ORACLE, "op13_document_trie": lexical.ORACLE}
