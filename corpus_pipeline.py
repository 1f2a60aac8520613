"""The corpus pipeline: quality rules, near-dedup, benchmark decontamination, secret scan, best-fit packing."""

from __future__ import annotations

from fabrichealth.llm import decontaminate, neardup, packing, quality, secrets
from fabrichealth.llm.common import shared_dir, table


def quality_rules(spark, docs, sf_dir):
    """Documents that the rules reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark, docs, sf_dir):
    """The document of the smallest doc_id of each group of near copies stays."""
    return neardup.keep_first(docs, neardup.Join(percent=80))


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark, docs, sf_dir):
    """Every document stays; its secrets are replaced."""
    return secrets.redact(docs)


def best_fit_packing(spark, docs, sf_dir):
    """Pieces with their ids and their place in sequences."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: The near-duplicate join, the forest and the tokenizer can't be written in SQL; tests hold run() against a
#: brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
