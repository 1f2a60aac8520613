"""What earlier bounds left out: long words, short benchmark items, repeated ids of labelled texts."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("fabrichealth.llm")

from fabrichealth.llm import decontaminate, toxicity, urls  # noqa: E402


def test_segmentation_equals_all_splits():
    rnd = random.Random(3)
    counts = {"a": 9, "ab": 30, "abc": 4, "cab": 12, "b": 1, "bcbc": 7, "ccccc": 3}
    total = sum(counts.values())
    cost = lambda w: math.log(counts[w] / total) if w in counts else math.log(0.1 / total) - 2.3 * len(w)
    split = urls.Segmenter(counts)
    for _ in range(300):
        text = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 11)))
        best = max(sum(cost(text[a:b]) for a, b in zip((0, *cuts), (*cuts, len(text)))) for k in range(len(text)) for cuts in itertools.combinations(range(1, len(text)), k))
        found = split.split(text)
        assert "".join(found) == text and math.isclose(sum(map(cost, found)), best)


def test_words_of_any_length_are_known_and_found(spark):
    long = "donaudampfschifffahrtsgesellschaftskapitaen"
    assert len(long) > 40
    pages = [(i, f"http://x{i}.com/{long}haus", f"<p>{long} haus</p>") for i in range(3)] + [(9, "http://q.com/" + "z" * 300, "<p>a</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    words = urls.counted(urls.html_words(df), "word")
    assert {r.word: r.n for r in words.collect()} == {long: 3, "haus": 3, "a": 1}
    tokens = {r.page_id: r.tokens.split() for r in urls.verdicts(df, words).collect()}
    assert tokens[0][-2:] == [f"p:{long}", "p:haus"] and tokens[9][-1] == "p:" + "z" * 300


def test_short_items_are_found_where_they_stand(spark):
    items = [(1, "Quux!"), (2, "alpha beta"), (3, "one two three four"), (4, ""), (5, None), (6, "alpha beta")]
    docs = [(1, "say quux now"), (2, "alpha, beta"), (3, "beta alpha"), (4, "zero one two three four five"), (5, "one two three five"), (6, None), (7, "alpha"), (8, "beta")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance, r.first_word) for r in decontaminate.find(d, b).collect()}
    assert got == {(1, 1, 0, 1), (2, 2, 0, 0), (2, 6, 0, 0), (4, 3, 0, 1)}  # not over the border of two documents
    assert {r.doc_id for r in decontaminate.clean(d, b).collect()} == {3, 5, 6, 7, 8}


def test_repeated_ids_give_one_model(spark):
    bad = "you utter idiot go away"
    rows = [(i, f"{bad} {i}" if i % 3 == 0 else f"a kind word about number {i}", int(i % 3 == 0)) for i in range(120)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    twice = [(i, t) for i, t, _ in rows] + [(i, "zzz other text") for i in range(0, 120, 2)]
    models = [toxicity.train(spark.createDataFrame(part, "doc_id long, text string").repartition(n), labels) for part, n in ((twice, 1), (twice[::-1], 7))]
    assert models[0] == models[1] and models[0][1]


def test_noisy_or_fit_lowers_the_loss_of_its_labels(spark):
    """The loss of the fitted model, by the plain formula of noisy-or, is far below that of the prior alone."""
    rows = [(i, "Fine day. You idiot! Bye." if i % 4 == 0 else "Fine day. Good bye friend.", int(i % 4 == 0)) for i in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}

    def plain(text):
        bias, weights = model
        none = 1.0
        for a, b in toxicity.sentences(text):
            words = {w for w in toxicity._word.findall(text[a:b].lower())}
            none *= 1 - 1 / (1 + math.exp(-(bias + sum(weights.get(f, 0.0) for w in words for f in toxicity.features(w)))))
        return 1 - none

    assert all(math.isclose(score[i], plain(t), abs_tol=1e-9) for i, t, _ in rows)
    loss = -sum(math.log(max(1e-12, score[i] if y else 1 - score[i])) for i, _, y in rows) / len(rows)
    assert loss < 0.3 * -(0.25 * math.log(0.25) + 0.75 * math.log(0.75))
    found = toxicity.locate(docs, model, 0.5).filter(F.col("doc_id") == 0).collect()
    assert [r.text.strip() for r in found] == ["You idiot"]
