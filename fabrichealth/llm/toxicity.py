"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels.

A sentence's probability is a logistic function of its distinct words, each with its stems (beginnings of 3 to
8 letters, so that inflected forms share a weight); a document's is 1 - prod(1 - p) over
its sentences. The words' weights are fitted to document labels alone by gradient descent on the likelihood,
so the sentences that carry the label are found without sentence labels.

The fit takes a bounded sample of labelled documents, ``sample`` per class at most, those with the smallest
hashes; classes are weighted back to their shares among all labelled documents. Everything is scored.

Null or empty texts have no sentence: score 0. Null labels are ignored; without labelled documents every
score is 0. Repeated rows are scored one by one. Extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_sentence = re.compile(r"[^.!?\n]+")
_word = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Fit:
    sample: int = 6_000
    least_documents: int = 4
    rounds: int = 120
    rate: float = 0.08
    sparsity: float = 2e-5
    seed: int = 11


def features(word: str) -> list[str]:
    """A word as a whole and its beginnings."""
    return [word + "$", *(word[:n] for n in range(3, min(8, len(word)) + 1))]


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the stretches between sentence ends and line ends that hold a word."""
    return [m.span() for m in _sentence.finditer(text) if _word.search(m.group())]


def fit(texts: list[str], labels: list[int], weights: list[float], how: Fit) -> tuple[float, dict[str, float]]:
    """The bias and the words' weights."""
    import numpy as np

    codes: dict[str, int] = {}
    seen, words, sizes, counts = [], [], [], []
    for text in texts:
        n, own = 0, set()
        for a, b in sentences(text):
            found = {codes.setdefault(w, len(codes)) for w in _word.findall(text[a:b].lower())}
            words += found
            own |= found
            sizes.append(len(found))
            n += 1
        counts.append(n)
        seen.append(np.fromiter(own, np.int64, len(own)))
    if not words:
        return -20.0, {}
    names: dict[str, int] = {}
    pairs = [(k, names.setdefault(f, len(names))) for word, k in codes.items() for f in features(word)]
    of_word, feature = np.array(pairs).T
    first = np.searchsorted(of_word, np.arange(len(codes) + 1))
    documents = np.zeros(len(names), np.int64)
    for own in seen:
        documents[np.unique(np.concatenate([feature[first[k] : first[k + 1]] for k in own.tolist()]))] += 1
    index = np.cumsum(documents >= how.least_documents) - 1
    use = documents[feature] >= how.least_documents
    of_word, feature = of_word[use], index[feature[use]]
    n_features = int((documents >= how.least_documents).sum())
    words, sentence = np.array(words), np.repeat(np.arange(len(sizes)), sizes)
    n_sentences = len(sizes)
    document = np.repeat(np.arange(len(counts)), counts)
    y, c = np.array(labels, float), np.array(weights, float)
    c = c / c.sum()
    w, bias = np.zeros(n_features), -5.0
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for step in range(1, how.rounds + 1):
        each = np.bincount(of_word, weights=w[feature], minlength=len(codes))
        z = bias + np.bincount(sentence, weights=each[words], minlength=n_sentences)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(document, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y))
        whole = np.clip(-np.expm1(none), 1e-9, 1 - 1e-9)
        g = ((whole - y) / whole * c)[document] * p
        by_word = np.bincount(words, weights=g[sentence], minlength=len(codes))
        gw, gb = np.bincount(feature, weights=by_word[of_word], minlength=n_features), g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, b = 1 - 0.9**step, 1 - 0.99**step
        scale = how.rate / (np.sqrt(v / b) + 1e-6)
        w = w - scale * m / a
        w = np.sign(w) * np.maximum(np.abs(w) - scale * how.sparsity, 0)
        bias -= how.rate * (mb / a) / (np.sqrt(vb / b) + 1e-6)
    return float(bias), {f: float(w[index[k]]) for f, k in names.items() if documents[k] >= how.least_documents and abs(w[index[k]]) > 1e-3}


def train(docs: DataFrame, labelled: DataFrame, how: Fit = Fit()) -> tuple[float, dict[str, float]]:
    """Fit on ``labelled(doc_id, toxic)``; the sample's texts are read and fitted in one task, whose size the sample bounds."""
    named = labelled.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = dict(named.groupBy("toxic").count().collect())
    if not totals.get(1) or not totals.get(0):
        return -20.0, {}
    parts = [named.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.sample) for k in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    # of a repeated doc_id the smallest text counts, so the same tables give the same model
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def run(batches):
        import json

        import pyarrow as pa

        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["doc_id"])
        if rows:
            n = [sum(r["toxic"] == k for r in rows) for k in (0, 1)]
            bias, weights = fit([r["text"] for r in rows], [r["toxic"] for r in rows], [totals[r["toxic"]] / n[r["toxic"]] for r in rows], how)
            yield pa.RecordBatch.from_pylist([{"model": json.dumps([bias, weights])}])

    import json

    found = texts.repartition(1).mapInArrow(run, "model string").collect()
    return tuple(json.loads(found[0][0])) if found else (-20.0, {})


_weights: dict[str, float] = {}
_model: list = [None]


def _weight(word: str, weights: dict[str, float]) -> float:
    """A word's weight, remembered in the worker."""
    if _model[0] is not weights or len(_weights) > 500_000:
        _weights.clear()
        _model[0] = weights
    found = _weights[word] = sum(weights[f] for f in features(word) if f in weights)
    return found


def _scores(text: str, bias: float, weights: dict[str, float]) -> list[tuple[int, int, float]]:
    from math import exp

    out = []
    if _model[0] is not weights:
        _weights.clear()
        _model[0] = weights
    for a, b in sentences(text):
        z = bias + sum(_weights[w] if w in _weights else _weight(w, weights) for w in set(_word.findall(text[a:b].lower())))
        out.append((a, b, 1 / (1 + exp(-max(-60.0, min(60.0, z))))))
    return out


def score(docs: DataFrame, model: tuple[float, dict[str, float]]) -> DataFrame:
    """doc_id, score, n_sentences and the sentence of the highest probability: its place, span and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        bias, weights = shared.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                none, worst = 1.0, (0.0, -1, None, None)
                found = _scores(text or "", bias, weights)
                for k, (a, b, p) in enumerate(found):
                    none *= 1 - p
                    if p > worst[0]:
                        worst = (p, k, a, b)
                rows.append((doc_id, 1 - none, len(found), *worst))
            if rows:
                kinds = (pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "score", "n_sentences", "worst_score", "worst_sentence", "worst_start", "worst_end"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, n_sentences long, worst_score double, worst_sentence long, worst_start long, worst_end long")


def locate(docs: DataFrame, model: tuple[float, dict[str, float]], least: float = 0.3) -> DataFrame:
    """doc_id, sentence, start, end, score and text of every sentence of at least that probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        bias, weights = shared.value
        for batch in batches:
            rows = [(d, k, a, b, p, t[a:b]) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) if t for k, (a, b, p) in enumerate(_scores(t, bias, weights)) if p >= least]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "sentence", "start", "end", "score", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sentence long, start long, end long, score double, text string")
