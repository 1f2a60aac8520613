"""run() against the operators' brute-force versions, stage by stage."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("fabrichealth.llm")


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from fabrichealth.llm import decontaminate, quality
    from tests.llm.test_operators import brute_components, plain_best_fit

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    kept = docs.join(quality.judged(docs, labels).filter("kept").select("doc_id"), "doc_id")
    rows = [(r.doc_id, r.text, r.lang) for r in kept.collect()]
    roots = set(brute_components(rows, 80).values())
    index = decontaminate.Index([(r.item_id, r.text.encode()) for r in bench.collect()], decontaminate.Search())
    left = [(i, t) for i, t, _ in rows if i in roots]
    leaks = {left[k][0] for k, *_ in index.matches([t.encode() for _, t in left])}
    out = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == roots - leaks
    lengths = [r.length for r in out.select("length").collect()]
    assert out.select("sequence_id").distinct().count() == plain_best_fit(lengths, 2048)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_stages_keep_the_columns_and_all_rows_of_clean_documents(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("text", F.concat(F.lit("kept whole "), "doc_id", F.lit(" one two three four five six seven eight nine")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_near_dedup_meets_brute_force_at_80_percent(spark, sf_dir):
    import random

    import corpus_pipeline
    from tests.llm.test_operators import brute_components

    rnd, rows = random.Random(8), []
    for k in range(20):  # pairs of 100 words that share a similarity between 0.80 and 0.85, and one a little below
        words = [f"w{rnd.randrange(10**6)}" for _ in range(100)]
        rows += [(2 * k, " ".join(words), "en"), (2 * k + 1, " ".join([*words[: 90 if k else 89], *(f"new{k}x{j}" for j in range(10 if k else 11))]), "en")]
    wanted = {i for i, root in brute_components(rows, 80).items() if i == root}
    assert len(wanted) == 21 and len(set(brute_components(rows).values())) == 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()} == wanted
